"""Variable-capacity best-fit packing of documents into training sequences.

A sequence costs its tokens, what attention adds to each as the sequence grows, and an overhead. Permitted lengths are
optimised jointly: pieces come largest first; each goes to the open bin that it fills best; where none can take it, the length is
opened whose cost per token is least, over the tokens that would really fill it: the piece and, largest first, those of the pieces
still to come that fit. At last each bin is downsized to the smallest permitted length that holds its contents. The same is done
with openings held to at least each single length, and the plan of least total cost is kept, so no fixed length does better.
A document longer than the largest length is cut into pieces of that length and a rest.

Documents are dealt to shards by a hash of their id and length, about SHARD documents a shard, and each shard is packed by itself: what
is left open at the end is a bin or two a shard, whatever the size of the table. Only ids and lengths are shuffled. Documents
alike in id and length are counted before they are dealt, and dealt by SHARD at a time, so that null ids or one id in many rows fill no shard.

Defined results: a null, blank or empty text has no tokens and takes no place, so it has no row; a null id is packed as
any other; repeated rows are packed once each (pieces of rows of one id can't be told apart); ties between pieces go by
id and piece, ties between bins by the older bin, ties between lengths to the shorter, between plans to the freer; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import arrow_map, pick

#: Permitted lengths; what a sequence costs besides its tokens; the length at which attention costs as much as all else a token (6 times a width of 4096).
CAPACITIES, OVERHEAD, ATTENTION = (512, 1024, 2048, 4096), 32, 24576
#: Documents that are packed together, about.
SHARD = 4096


def cost(capacity: int, overhead: int = OVERHEAD, attention: float = ATTENTION) -> float:
    return capacity * (1 + capacity / attention) + overhead


class Coming:
    """The pieces still to come, by size: how far they would fill a bin, largest first."""

    def __init__(self, sizes: list[int]):
        """sizes: largest first."""
        self.sizes, self.counts, self.first = [], [], {}  # distinct sizes, least first; how many of each
        for s in reversed(sizes):
            if not self.sizes or self.sizes[-1] != s:
                self.first[s] = len(self.sizes)
                self.sizes.append(s)
                self.counts.append(0)
            self.counts[-1] += 1

    def take(self, size: int) -> None:
        """A piece of the largest size that is left has come."""
        self.counts[self.first[size]] -= 1

    def fill(self, room: int) -> int:
        """Tokens that a room would get. Sizes above the largest left have a count of 0."""
        got, k = 0, bisect_right(self.sizes, room) - 1
        while k >= 0 and room:
            n = min(self.counts[k], room // self.sizes[k])
            got += n * self.sizes[k]
            room -= n * self.sizes[k]
            k = min(k - 1, bisect_right(self.sizes, room) - 1)
        return got


def planned(order: list[int], capacities: tuple[int, ...], price: dict[int, float], least: int = 0) -> tuple[float, list[tuple[int, int]], list[int]]:
    """Total cost; (bin, offset) of each size of `order`, which come largest first; what each bin holds. Bins are opened at `least` or more, where a length is so long.

    Open bins are kept as sorted (room, bin), so that the tightest bin is found by bisection.
    """
    room, filled, where, coming = [], [], [], Coming(order)
    for s in order:
        coming.take(s)
        k = bisect_left(room, (s, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            fit = [c for c in capacities if c >= max(s, least)]
            free = fit[0] if len(fit) == 1 or least else min(fit, key=lambda c: (price[c] / (s + coming.fill(c - s)), c))
            b = len(filled)
            filled.append(0)
        where.append((b, filled[b]))
        filled[b] += s
        if free > s:
            insort(room, (free - s, b))
    return sum(price[capacities[bisect_left(capacities, x)]] for x in filled), where, filled


def best_fit(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: float = ATTENTION) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) of each size, in the order of `sizes`, by the plan of least cost. Sizes are from 1 to the largest capacity."""
    capacities = tuple(sorted(set(capacities)))
    price = {c: cost(c, overhead, attention) for c in capacities}
    at = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    order = [sizes[i] for i in at]
    _, where, filled = min((planned(order, capacities, price, least) for least in (0, *capacities)), key=lambda p: p[0])
    out = [(0, 0, 0)] * len(sizes)
    for i, (b, offset) in zip(at, where):
        out[i] = (b, capacities[bisect_left(capacities, filled[b])], offset)
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens: white-space separated words and one mark of the text's end; 0 for a text without words."""

    def run(batch: pa.RecordBatch) -> dict:
        n = [len(t.split()) if t else 0 for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "tokens": [x and x + 1 for x in n]}

    return arrow_map(pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string")), run, "doc_id long, tokens long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: float = ATTENTION, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start, tokens, shard, bin, capacity, bin_offset: a row a piece. length: tokens of a document, if not its words."""
    most = max(capacities)
    sized = word_counts(docs, id_col, text_col) if length is None else pick(docs, doc_id=docs[id_col].cast("long"), tokens=length.cast("long"))
    sized = sized.filter("tokens > 0")
    shards = max(1, -(-docs.count() // shard))  # from the files' footers, without reading texts

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["n"])].sort_values(["doc_id", "tokens"], kind="stable")
        rows = [(d, k, k * most, min(most, t - k * most)) for d, t in zip(pdf["doc_id"].astype("Int64"), pdf["tokens"]) for k in range(-(-t // most))]
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "tokens"])
        out["shard"] = pdf["shard"].iloc[0]
        got = best_fit(out["tokens"].tolist(), capacities, overhead, attention)
        out[["bin", "capacity", "bin_offset"]] = got
        return out

    # documents alike in id and length are one row with a count, and one row for each `shard` of them
    alike = sized.groupBy("doc_id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    parts = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / shard))))
    parts = parts.withColumn("n", F.least(F.lit(shard).cast("long"), F.col("n") - F.col("part") * shard))
    dealt = parts.select("doc_id", "tokens", "n", F.pmod(F.xxhash64("doc_id", "tokens", "part"), F.lit(shards)).cast("long").alias("shard"))
    return dealt.groupBy("shard").applyInPandas(one, "doc_id long, piece long, start long, tokens long, shard long, bin long, capacity long, bin_offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
