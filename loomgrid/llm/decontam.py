"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are a candidate pair when they share a seed, a run of `min_match` equal tokens. Seeds
also bound what tiling can reach: every tile is a chain of seeds, so an item whose tokens under shared seeds are fewer
than the threshold asks for needs no tiling. For the rest, greedy string tiling marks the longest match that doesn't
overlap an earlier one, again and again, matches being found by running Karp-Rabin hashes of falling search length. The
share of the item's tokens that are marked is its coverage, whatever their order in the document, so passages whose
sentences were reordered count in full. Pairs of at least `threshold` coverage are reported.

Where the benchmark is small (its bytes are summed first, against `broadcast_bytes`) the seeds of the items go to every worker and documents are joined with them as they are
read, without a shuffle. Beyond that size the seeds of both sides are joined by hash in Spark, and texts meet only for
the candidate pairs. Both ways give the same rows.

Defined results: tokens are lower-case words without punctuation; a null or empty text, or one with fewer than
`min_match` tokens, matches nothing; a null id of a document is kept in `find`, items of null id are ignored; items of
equal id are separate items whose best coverage counts; repeated rows are judged one by one; tiles of equal length go to
the item's earlier position, then the document's; an empty table gives an empty table; other columns are ignored by
`find` and kept by `clean`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import arrow_map, pick, words

MIN_MATCH, THRESHOLD, BROADCAST_BYTES = 4, 0.5, 4 << 20
#: Where the search for long matches begins.
SEARCH = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def rolled(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k ids, by Horner's rule over all runs at once."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    ids = ids.astype(np.uint64)
    for j in range(k):
        h = h * MULTIPLIER + ids[j : j + n]
        h ^= h >> np.uint64(29)
    return h


def running(tokens: list[int], s: int, base: int = 1_000_003, mod: int = (1 << 61) - 1) -> Iterator[int]:
    """Karp-Rabin hashes of the runs of s tokens, each from the one before."""
    top, h = pow(base, s - 1, mod), 0
    for i, x in enumerate(tokens):
        if i >= s:
            h = (h - tokens[i - s] * top) % mod
        h = (h * base + x) % mod
        if i >= s - 1:
            yield h


def tiles(item: list[int], doc: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) by running Karp-Rabin greedy string tiling."""
    a, b, out, s = [False] * len(item), [False] * len(doc), [], min(max(SEARCH, min_match), max(len(item), min_match))

    def scan(s: int) -> tuple[int, list[tuple[int, int, int]]]:
        table: dict[int, list[int]] = {}
        for i, h in enumerate(running(item, s)):
            if not any(a[i : i + s]):
                table.setdefault(h, []).append(i)
        longest, found = 0, []
        for j, h in enumerate(running(doc, s) if table else ()):
            if h not in table or any(b[j : j + s]):
                continue
            for i in table[h]:
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k >= s:
                    if k > 2 * s:
                        return k, []
                    found.append((k, i, j))
                    longest = max(longest, k)
        return longest, found

    while True:
        longest, found = scan(s)
        if longest > 2 * s:
            s = longest
            continue
        # whole matches are marked longest first; one that a mark has cut is looked for anew when its rest is long enough for this length
        again = False
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if any(a[i : i + k]) or any(b[j : j + k]):
                free = max(map(len, "".join("01"[not (x or y)] for x, y in zip(a[i : i + k], b[j : j + k])).split("0")))
                again |= free >= s
                continue
            a[i : i + k] = b[j : j + k] = [True] * k
            out.append((i, j, k))
        if again:
            continue
        if s <= min_match:
            return out
        s = max(min_match, s // 2)


class Index:
    """Items by seed. Token ids are given to the benchmark's words alone; any other word is 0."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = MIN_MATCH):
        self.k, self.ids, self.items = min_match, {}, []
        for d, t in items:
            self.items.append((d, np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(t or "")], np.int64)))
        seeds = [(rolled(x, min_match), n) for n, (_, x) in enumerate(self.items)]
        h = np.concatenate([s for s, _ in seeds] or [np.empty(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.of = np.concatenate([np.full(len(s), n) for s, n in seeds] or [np.empty(0, int)])[order]
        self.at = np.concatenate([np.arange(len(s)) for s, _ in seeds] or [np.empty(0, int)])[order]

    def __call__(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, float, int, int, int]]:
        """(item_id, coverage, matched, item_tokens, tiles) of the items that the text covers."""
        w = words(text) if text else []
        if len(w) < self.k or not len(self.hashes):
            return []
        doc = np.fromiter(map(self.ids.get, w, repeat(0)), np.int64, len(w))
        known = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(doc, self.k).all(axis=1))
        if not len(known):
            return []
        h = rolled(doc, self.k)[known]
        left, right = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        if not (right > left).any():
            return []
        here = np.zeros(len(doc), bool)
        shared: dict[int, set[int]] = {}
        for p, x, y in zip(known[right > left].tolist(), left[right > left].tolist(), right[right > left].tolist()):
            here[p : p + self.k] = True
            for e in range(x, y):
                shared.setdefault(int(self.of[e]), set()).add(int(self.at[e]))
        best: dict[int, tuple] = {}
        part = None
        for n, starts in shared.items():
            item_id, item = self.items[n]
            reach = np.zeros(len(item), bool)
            for j in range(self.k):
                reach[np.fromiter(starts, int) + j] = True
            if reach.sum() < threshold * len(item):
                continue
            if part is None:  # the tokens under seeds; a gap between them matches nothing
                edge = np.flatnonzero(np.diff(here.astype(np.int8)) == -1) + 1
                filled = doc.copy()
                filled[~here] = -1
                keep = here.copy()
                keep[edge] = True
                part = filled[keep].tolist()
            got = tiles(item.tolist(), part, self.k)
            matched = sum(k for _, _, k in got)
            row = (item_id, matched / len(item), matched, len(item), len(got))
            if row[1] >= threshold and row[1:] > best.get(item_id, (0, 0.0))[1:]:
                best[item_id] = row
        return [best[k] for k in sorted(best)]


SCHEMA = "doc_id long, item_id long, coverage double, matched long, item_tokens long, tiles long"


def found(rows: list[tuple]) -> dict:
    return dict(zip(("doc_id", "item_id", "coverage", "matched", "item_tokens", "tiles"), zip(*rows) if rows else ((),) * 6))


def prepared(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, int]:
    """(item_id, text) of the usable items, and the bytes of their texts."""
    items = pick(benchmark, item_id=benchmark[item_id].cast("long"), text=benchmark[item_text].cast("string")).filter("item_id is not null and text is not null")
    return items, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row for each document and item that it covers."""
    items, held = prepared(benchmark, item_id, item_text)
    texts = pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string")).filter("text is not null")
    if held > broadcast_bytes:
        return joined(texts, items, min_match, threshold)
    index = Index([(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()], min_match)

    def run(batch: pa.RecordBatch) -> dict:
        return found([(d, *x) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for x in index(t, threshold)])

    return arrow_map(texts, run, SCHEMA)


def seeds(df: DataFrame, key: str, min_match: int) -> DataFrame:
    """(key, seed), each once a row of df."""

    def run(batch: pa.RecordBatch) -> dict:
        keys, out = [], []
        for d, t in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
            ids = np.array([xxhash.xxh3_64_intdigest(w) for w in words(t or "")], np.uint64)
            h = np.unique(rolled(ids, min_match))
            keys.append(np.full(len(h), d))
            out.append(h.view(np.int64))
        return {key: np.concatenate(keys), "seed": np.concatenate(out)}

    return arrow_map(df, run, f"{key} long, seed long")


def joined(texts: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """The way for a benchmark too large to broadcast: seeds meet by hash, then texts by candidate pair.

    A key of its own is given to each text and item, so that null and repeated ids stay apart.
    """
    keyed = lambda df, name, *c: df.withColumn(name, F.xxhash64(*c))
    docs, tests = keyed(texts, "doc_key", "text"), keyed(items, "item_key", "item_id", "text")
    distinct = docs.select("doc_key", "text").dropDuplicates(["doc_key"])
    pairs = seeds(distinct, "doc_key", min_match).join(seeds(tests, "item_key", min_match), "seed").select("doc_key", "item_key").distinct()
    both = pairs.join(distinct, "doc_key").join(pick(tests, item_key="item_key", item_id="item_id", item_text="text").dropDuplicates(["item_key"]), "item_key")

    def run(batch: pa.RecordBatch) -> dict:
        c = [batch.column(x).to_pylist() for x in ("doc_key", "item_id", "item_text", "text")]
        return found([(d, *x) for d, i, it, t in zip(*c) for x in Index([(i, it)], min_match)(t, threshold)])

    got = arrow_map(both, run, SCHEMA)
    best = got.groupBy(F.col("doc_id").alias("doc_key"), "item_id").agg(F.max(F.struct("coverage", "matched", "item_tokens", "tiles")).alias("m"))
    return docs.select("doc_id", "doc_key").join(best, "doc_key").select("doc_id", "item_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that cover no item, with all their columns. Judged by text alone, so null and repeated ids are no matter."""
    items, held = prepared(benchmark, item_id, item_text)
    text = docs[text_col].cast("string")
    if held > broadcast_bytes:
        texts = docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")).filter("text is not null").dropDuplicates(["doc_id"])
        dirty = joined(texts, items, min_match, threshold).select(F.col("doc_id").alias("__key")).distinct()
        return docs.join(dirty, F.xxhash64(text) == dirty["__key"], "left_anti")
    index = Index([(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()], min_match)

    @F.arrow_udf("boolean")
    def covers(texts: pa.Array) -> pa.Array:
        return pa.array([bool(index(t, threshold)) for t in texts.to_pylist()], pa.bool_())

    return docs.filter(text.isNull() | ~covers(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
