"""Perplexity under a class-based bigram model whose classes are found by exchange clustering.

All words of the corpus are counted, and every word has a class and a count of its own. The VOCABULARY most frequent ones are the
words that exchange clustering moves among CLASSES classes: one task sweeps over the counts of their bigrams, moving each word to the class
that raises the likelihood of the class bigrams most, until few words move. Meanwhile all other words are OTHER, a word in a class
of its own, as is the text's edge. Then each of the others goes to the class under which its own neighbours, over the whole corpus, are
likeliest. At last class bigrams are counted over the whole corpus, with the classes of all its words.

Words beyond the most frequent ones are too many for a worker's memory. So texts are coded by slices: a slice holds numbers of its own
and the list of the words that they stand for. Words with their neighbours' classes are shuffled once on the word, and what is found of each goes
back to the slices that hold it by a second shuffle.

P(word | before) = P(class | class before) * P(word | class). Class transitions are smoothed towards the classes' own
shares by a Dirichlet prior; emissions are the words' shares of their class, plus ADDED. The class OTHER is left to words that weren't
counted. The perplexity of a text is over its words and its closing edge.

`fit` and `scores` are the model of the most frequent words alone, which fits in memory and can score other texts: there all
other words stay OTHER and share its class evenly with one that wasn't counted.

Defined results: a null or empty text, or one without words, has 0 words, and null log-probability and perplexity; a null id is scored
and kept; repeated rows are counted and scored one by one; ties in frequency go to the word first in byte order, ties
between classes to the lower class, and a word stays unless another class is better; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import arrow_map, cut, pick, slices, whole, words

VOCABULARY, CLASSES, SWEEPS, MOVED, PRIOR, ADDED = 4096, 64, 8, 0.002, 10.0, 0.5
#: Rows of a slice at most, beside the bytes that bound it; bytes of words with their neighbours that are judged at a time, about.
SLICE_ROWS, TOGETHER = 10_000, 32 << 20


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(m: np.ndarray, fixed: int = 2, classes: int = CLASSES, sweeps: int = SWEEPS, moved: float = MOVED) -> np.ndarray:
    """The class of each word of the bigram counts m; the last `fixed` words keep classes of their own."""
    v = len(m) - fixed
    k = max(1, min(classes, v)) if v else 0
    of = np.r_[np.arange(v) % max(k, 1), k + np.arange(fixed)].astype(np.int64)
    total = k + fixed
    one = np.zeros((len(m), total))
    one[np.arange(len(m)), of] = 1
    right, left = np.empty((len(m), total)), np.empty((len(m), total))  # of a word: counts of the classes behind it, and before it
    for c in range(total):
        own = np.flatnonzero(of == c)
        right[:, c], left[:, c] = m[:, own].sum(axis=1), m[own].sum(axis=0)
    g = one.T @ right
    out_of, into = m.sum(axis=1).astype(float), m.sum(axis=0).astype(float)
    n_out, n_in = np.bincount(of, out_of, total)[:k], np.bincount(of, into, total)[:k]
    for _ in range(sweeps if k > 1 else 0):
        changes = 0
        for w in range(v):
            a, s = of[w], float(m[w, w])
            l, r = right[w].copy(), left[w].copy()
            l[a] -= s
            r[a] -= s
            g[a] -= l
            g[:, a] -= r
            g[a, a] -= s
            n_out[a] -= out_of[w]
            n_in[a] -= into[w]
            h = xlogx(g)
            row, col = xlogx(g[:k] + l).sum(axis=1) - h[:k].sum(axis=1), xlogx(g[:, :k] + r[:, None]).sum(axis=0) - h[:, :k].sum(axis=0)
            d, e = np.diag(g)[:k], np.diag(h)[:k]
            both = xlogx(d + l[:k] + r[:k] + s) - e - (xlogx(d + l[:k]) - e) - (xlogx(d + r[:k]) - e)
            gain = row + col + both - (xlogx(n_out + out_of[w]) - xlogx(n_out)) - (xlogx(n_in + into[w]) - xlogx(n_in))
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            g[b] += l
            g[:, b] += r
            g[b, b] += s
            n_out[b] += out_of[w]
            n_in[b] += into[w]
            if b != a:
                changes += 1
                of[w] = b
                right[:, a] -= m[:, w]
                right[:, b] += m[:, w]
                left[:, a] -= m[w]
                left[:, b] += m[w]
        if changes <= moved * v:
            break
    return of


def transitions(g: np.ndarray) -> np.ndarray:
    """Log-probability of each class behind each class."""
    into = g.sum(axis=0)
    share = (into + ADDED) / (into.sum() + ADDED * len(g))
    return np.log((g + PRIOR * share) / (g.sum(axis=1, keepdims=True) + PRIOR))


class Model:
    """Ids: 0 up to the vocabulary's size for its words, then OTHER and the edge."""

    def __init__(self, vocabulary: list[tuple[bytes, int]], other_tokens: int, other_types: int, of: np.ndarray, g: np.ndarray):
        self.ids = {w: k for k, (w, _) in enumerate(vocabulary)}
        self.other, self.edge, self.of = len(vocabulary), len(vocabulary) + 1, of
        counts = np.array([n for _, n in vocabulary], float)
        total = np.bincount(of[: self.other], counts, minlength=len(g)) if len(counts) else np.zeros(len(g))
        size = np.bincount(of[: self.other], minlength=len(g)) if len(counts) else np.zeros(len(g))
        own = of[: self.other]
        self.emit = np.log(np.r_[(counts + ADDED) / (total[own] + ADDED * size[own]), 1 / (other_types + 1), 1.0])
        self.next = transitions(g)

    def sequence(self, text: str | None) -> np.ndarray:
        """Ids of the text's words between two edges; empty for a text without words."""
        return sequence(self.ids, text)

    def __call__(self, text: str | None) -> tuple[int, float | None, float | None]:
        s = self.sequence(text)
        if not len(s):
            return 0, None, None
        c = self.of[s]
        total = float(self.next[c[:-1], c[1:]].sum() + self.emit[s[1:]].sum())
        return len(s) - 2, total, float(np.exp(min(700.0, -total / (len(s) - 1))))


def sequence(ids: dict[bytes, int], text: str | None) -> np.ndarray:
    w = words(text) if text else []
    if not w:
        return np.empty(0, np.int64)
    out = np.full(len(w) + 2, len(ids) + 1, np.int64)
    out[1:-1] = np.fromiter(map(ids.get, w, repeat(len(ids))), np.int64, len(w))
    return out


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n of all words: counted by slices, then by task, then by a shuffle on the word."""

    def run(batch: pa.RecordBatch) -> dict:
        c = Counter()
        for t in batch.column("text").to_pylist():
            c.update(words(t))
        return {"word": list(c), "n": list(c.values())}

    return arrow_map(pick(docs, text=docs[text_col].cast("string")).filter("text is not null"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def clustered(bigrams: DataFrame, size: int, classes: int, sweeps: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Class of each word, counts of class bigrams, from pair, n: one task, over a table of at most size squared places."""

    def cluster(batches):
        m = np.zeros(size * size, np.int64)
        for batch in batches:
            m[batch.column("pair").to_numpy()] += batch.column("n").to_numpy()
        m = m.reshape(size, size)
        of = exchange(m, 2, classes, sweeps)
        one = np.zeros((size, int(of.max()) + 1))
        one[np.arange(size), of] = 1
        g = np.stack([one.T @ m[of == c].sum(axis=0) for c in range(one.shape[1])])
        yield pa.RecordBatch.from_arrays([pa.array([of.astype("<i8").tobytes()], pa.binary()), pa.array([g.astype("<f8").tobytes()], pa.binary())], ["classes", "counts"])

    row = bigrams.repartition(1).mapInArrow(cluster, "classes binary, counts binary").first()
    if row is None:
        return None
    of = np.frombuffer(row["classes"], "<i8")
    return of, np.frombuffer(row["counts"], "<f8").reshape(int(of.max()) + 1, -1)


def fit(docs: DataFrame, text_col: str = "text", vocabulary: int = VOCABULARY, classes: int = CLASSES, sweeps: int = SWEEPS) -> Model:
    unigrams = cut(counted(docs, text_col))
    types, tokens = unigrams.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = [(bytes(r["word"]), r["n"]) for r in unigrams.orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    ids, size = {w: k for k, (w, _) in enumerate(top)}, len(top) + 2

    def pairs(batch: pa.RecordBatch) -> dict:
        parts = [s[:-1] * size + s[1:] for t in batch.column("text").to_pylist() if len(s := sequence(ids, t))]
        keys, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64),) * 2
        return {"pair": keys, "n": n}

    bigrams = arrow_map(pick(docs, text=docs[text_col].cast("string")).filter("text is not null"), pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))

    row = clustered(bigrams, size, classes, sweeps)
    if row is None:  # no documents
        return Model([], 0, 0, np.arange(2), np.zeros((2, 2)))
    of, g = row
    return Model(top, tokens - sum(n for _, n in top), types - len(top), of, g)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob, perplexity of every document: a map without a shuffle."""

    def run(batch: pa.RecordBatch) -> dict:
        n, p, x = zip(*(model(t) for t in batch.column("text").to_pylist()))
        return {"doc_id": batch.column("doc_id"), "n_words": n, "log_prob": p, "perplexity": x}

    return arrow_map(pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string")), run, "doc_id long, n_words long, log_prob double, perplexity double")


class Numbers(dict):
    """Words to numbers; a new word gets the next one."""

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        return n


def pack(x: np.ndarray | bytes) -> bytes:
    return pa.compress(x if isinstance(x, bytes) else x.tobytes(), "zstd", asbytes=True)


def unpack(x: bytes, size: int) -> bytes:
    return pa.decompress(x, size, "zstd", asbytes=True)


#: What is found of a word in a slice: its number among the slice's own words, its class, its count, and whether this row counts it.
FOUND = np.dtype([("place", "<i4"), ("class", "<u2"), ("n", "<i8"), ("counts", "?")])


def sealed(row: dict[str, pa.Array]) -> bytes:
    """One row in one value, so that a shuffle and the way to Python carry two columns, whatever a slice holds."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(list(row.values()), list(row))
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(x: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(x).read_next_batch()


def coded(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """slice, data of doc_id, text: the texts' words as numbers, an edge before, between and behind the texts that have words.

    Numbers are those of ids, then those of the slice's other words, `own` of them, joined by spaces in `words`; the last is the edge.
    """
    from pyspark import TaskContext

    def run(batches):
        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, rows=SLICE_ROWS):
                numbers, rows = Numbers(ids), []
                for t in part.column("text").to_pylist():
                    w = words(t) if t else []
                    rows.append(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)))
                edge = np.full(1, len(numbers), np.int32)
                flat = np.concatenate([edge, *(x for r in rows if len(r) for x in (r, edge))])
                own = b" ".join(list(numbers)[len(ids) :])
                row = {
                    "own": pa.array([len(numbers) - len(ids)], pa.int32()),
                    "size": pa.array([len(own)], pa.int64()),
                    "words": pa.array([pack(own)], pa.binary()),
                    "length": pa.array([len(flat)], pa.int64()),
                    "flat": pa.array([pack(flat)], pa.binary()),
                    "doc_ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "lengths": pa.array([[len(r) for r in rows]], pa.list_(pa.int32())),
                }
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([sealed(row)], pa.binary())], ["slice", "data"])
                k += 1

    return docs.mapInArrow(run, "slice long, data binary")


def read(row: pa.RecordBatch) -> tuple[int, np.ndarray]:
    """Of a slice the number of its own words, and its numbers."""
    own, length, flat = (row.column(c)[0].as_py() for c in ("own", "length", "flat"))
    return own, np.frombuffer(unpack(flat, 4 * length), np.int32)


def neighbours(slices_: DataFrame, of: np.ndarray) -> DataFrame:
    """word, slice, place, around: of each of a slice's own words the classes before and behind it, as pairs of <u2, wherever it stands."""
    frequent = len(of) - 2

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist()):
                row = opened(data)
                own, flat = read(row)
                if not own:
                    continue
                c = np.r_[of[:frequent], np.full(own, of[frequent]), of[frequent + 1]].astype("<u2")[flat]
                at = np.flatnonzero((flat >= frequent) & (flat < frequent + own))
                place = flat[at] - frequent
                at = at[np.argsort(place, kind="stable")]
                around = np.stack([c[at - 1], c[at + 1]], axis=1)
                offsets = np.r_[0, 4 * np.cumsum(np.bincount(place, minlength=own))].astype(np.int32)
                around = pa.Array.from_buffers(pa.binary(), own, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(around.tobytes())])
                own_words = unpack(row.column("words")[0].as_py(), row.column("size")[0].as_py()).split(b" ")
                yield pa.RecordBatch.from_arrays([pa.array(own_words, pa.binary()), pa.array(np.full(own, k)), pa.array(np.arange(own, dtype=np.int32)), around], ["word", "slice", "place", "around"])

    return slices_.mapInArrow(run, "word binary, slice long, place int, around binary")


def assigned(around: DataFrame, g: np.ndarray) -> DataFrame:
    """slice, data: each word in the likeliest class for its neighbours; data are rows of FOUND, of as many words of the slice as one table held."""
    k, total = len(g) - 2, len(g)
    # a class's likelihood of what is before its words and behind them, by classes
    behind, before = transitions(g)[:k], transitions(g.T)[:k]

    def judged(table: pa.Table) -> pa.RecordBatch:
        w = table.column("word").combine_chunks()
        new = np.r_[True, pc.not_equal(w[1:], w[:-1]).to_numpy(zero_copy_only=False)]
        word = np.cumsum(new) - 1
        data = table.column("around").to_pylist()
        pairs = np.frombuffer(b"".join(data), "<u2").reshape(-1, 2).astype(np.int64)
        owner = np.repeat(word, [len(x) // 4 for x in data])
        of, n = np.empty(word[-1] + 1, np.int32), np.bincount(owner)
        for first in range(0, len(of), 1 << 14):
            some = slice(*np.searchsorted(owner, [first, first + (1 << 14)]))
            rows = min(len(of) - first, 1 << 14)
            base = (owner[some] - first) * total
            l, r = (np.bincount(base + pairs[some, side], minlength=rows * total).reshape(rows, total) for side in (0, 1))
            of[first : first + rows] = np.argmax(l @ before.T + r @ behind.T, axis=1)
        out = np.empty(len(word), FOUND)
        out["place"], out["class"], out["n"], out["counts"] = table.column("place").to_numpy(), of[word], n[word], new
        keys = table.column("slice").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        offsets = (np.r_[starts, len(keys)] * FOUND.itemsize).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys[starts]), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[order].tobytes())])], ["slice", "data"])

    def run(batches):
        held, size = [], 0
        for table in whole(batches, "word"):
            held.append(table)
            size += table.nbytes
            if size > TOGETHER:
                yield judged(pa.concat_tables(held))
                held, size = [], 0
        if held:
            yield judged(pa.concat_tables(held))

    return around.repartition("word").sortWithinPartitions("word").mapInArrow(run, "slice long, data binary")


def classified(slices_: DataFrame, found: DataFrame, of: np.ndarray, counts: np.ndarray) -> DataFrame:
    """A row a slice: the classes of its words, by text the sum of the logarithms of its words' counts, and what the slice adds to the
    counts of class bigrams, and to the tokens and types of each class."""
    frequent, total = len(of) - 2, int(of.max()) + 1
    rows = slices_.select("slice", F.lit(True).alias("whole"), "data").union(found.select("slice", F.lit(False), "data"))

    def run(batches):
        for table in whole(batches, "slice"):
            keys = table.column("slice").to_numpy()
            data, head = table.column("data").combine_chunks(), table.column("whole").to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                h = a + int(np.flatnonzero(head[a:b])[0])
                row = opened(data[h].as_py())
                own, flat = read(row)
                rest = np.frombuffer(b"".join(data.slice(a, h - a).to_pylist() + data.slice(h + 1, b - h - 1).to_pylist()), FOUND)
                rest = rest[np.argsort(rest["place"])]
                assert np.array_equal(rest["place"], np.arange(own)), "a word's class is missing"
                lengths = row.column("lengths")[0].values.to_numpy().astype(np.int64)
                tail, n = rest["class"].astype(np.int64), rest["n"]
                c = np.r_[of[:frequent], tail, of[frequent + 1]].astype(np.int64)[flat]
                g = np.bincount(c[:-1] * total + c[1:], minlength=total * total)
                mine = rest["counts"]
                tokens = np.bincount(tail[mine], n[mine], total) if own else np.zeros(total)
                types = np.bincount(tail[mine], minlength=total) if own else np.zeros(total)
                sums = np.zeros(len(lengths))
                if (some := lengths > 0).any():
                    logs = np.r_[np.log(counts + ADDED), np.log(n + ADDED), 0.0][flat]
                    sums[some] = np.add.reduceat(logs, firsts(lengths[some]) + 1)
                added = np.r_[g, tokens, types].astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids"), row.column("lengths"), pa.array([sums.tolist()], pa.list_(pa.float64())), row.column("length"), pa.array([pack(c.astype("<u2"))], pa.binary()), pa.array([added], pa.binary())],
                    ["doc_ids", "lengths", "sums", "length", "classes", "added"],
                )

    return rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "doc_ids array<long>, lengths array<int>, sums array<double>, length long, classes binary, added binary")


def firsts(lengths: np.ndarray) -> np.ndarray:
    """Where the edges before texts of such lengths are."""
    return np.cumsum(lengths + 1) - (lengths + 1)


def added(rows: DataFrame) -> np.ndarray | None:
    """The sum of what the slices add."""

    def run(batches):
        total = 0
        for batch in batches:
            for x in batch.column("added").to_pylist():
                total = total + np.frombuffer(x, "<f8")
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["added"])

    row = rows.select("added").mapInArrow(run, "added binary").repartition(1).mapInArrow(run, "added binary").first()
    return None if row is None else np.frombuffer(row["added"], "<f8")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, n_words, log_prob, perplexity of every document, under the model of all words of all documents. vocabulary: words that are moved by exchange."""
    top = [(bytes(r["word"]), r["n"]) for r in counted(docs, text_col).orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    counts, size = np.array([n for _, n in top], float), len(top) + 2
    texts = cut(coded(pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string")), {w: k for k, (w, _) in enumerate(top)}))

    def pairs(batches):
        for batch in batches:
            for own, flat in map(read, map(opened, batch.column("data").to_pylist())):
                s = np.r_[np.arange(size - 2), np.full(own, size - 2), size - 1][flat]
                keys, n = np.unique(s[:-1] * size + s[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    row = clustered(texts.select("data").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), size, classes, sweeps)
    of, g = row or (np.arange(2), np.zeros((2, 2)))
    rows = cut(classified(texts, assigned(neighbours(texts, of), g), of, counts))
    k, sums = len(g), added(rows)
    if sums is None:  # no documents
        sums = np.zeros(k * k + 2 * k)
    tokens, types = (sums[k * k + j * k : k * k + (j + 1) * k] + np.bincount(of[:-2], x, k) for j, x in ((0, counts), (1, np.ones(size - 2))))
    # of a class without words the share is 1, as of the edge's and of OTHER's
    step = transitions(sums[: k * k].reshape(k, k)) - np.where(types > 0, np.log(np.maximum(tokens + ADDED * types, ADDED)), 0.0)

    def run(batches):
        for batch in batches:
            for ids, lengths, logs, length, c in zip(*(batch.column(x).to_pylist() for x in ("doc_ids", "lengths", "sums", "length", "classes"))):
                lengths, p = np.array(lengths, np.int64), np.array(logs)
                c = np.frombuffer(unpack(c, 2 * length), "<u2")
                some = lengths > 0
                if some.any():
                    p[some] += np.add.reduceat(step[c[:-1], c[1:]], firsts(lengths[some]))
                x = np.exp(np.minimum(700.0, -p / (lengths + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths), pa.array(p, mask=~some), pa.array(x, mask=~some)], ["doc_id", "n_words", "log_prob", "perplexity"])

    return rows.select("doc_ids", "lengths", "sums", "length", "classes").mapInArrow(run, "doc_id long, n_words long, log_prob double, perplexity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
