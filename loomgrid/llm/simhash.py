"""Near-duplicates by SimHash and an exact pigeonring search.

A document's hash has 256 bits: each bit is the majority over its distinct words' hashes. The bits are laid on a ring of
`distance` + 1 parts. If two hashes differ in at most `distance` bits, which is fewer than there are parts, then from some part on
the first k parts differ in fewer than k bits, for every k: the first agrees in full, the first two differ in one bit at most, and so on.
Documents meet by a shuffle on the bits and place of each part. Where they meet, the next one or two parts say who is compared with whom:
rows whose bits there differ by no more than that allows. Whoever is compared must keep to it over 64 bits, and then
pass the full Hamming check. So every pair within the distance is found, whatever its differences (tests: against brute force).

Equal hashes are folded before the search, so a text that is copied a million times is one row. Within a set of more than SMALL documents that meet, the links
that are kept are a spanning forest of all links found among them, and rows that links connect are compared as one, so large groups of near copies cost links in proportion to
their size and no partner is dropped: groups are the connected components of all links.

Defined results: a null or empty text, or one without words, has no hash and no group; a row of null id is in no group, and `keep_one` keeps it unless told
to judge such rows too (`null_ids`, as the pipeline does: documents with an id stay before them); in a tie between the halves of a bit's votes it is 0; repeated rows share one id and so one place in the result; the document of the least id stays for its group; an
empty table gives an empty table; other columns are ignored by `groups` and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgrid.llm.common import arrow_map, cut, drop, pick, whole, words

BITS, SEGMENTS, JOINED, DISTANCE, RINGS = 256, 32, 3, 36, 2
#: Words whose hashes a Python worker remembers.
KNOWN = 150_000
#: Sets of documents that meet, up to this size, are compared pair by pair, many sets at once.
SMALL = 4
#: Sets of documents that meet of more than this are compared by many tasks, in blocks of so many.
BLOCK = 1 << 18
#: Sets up to the first size are compared pair by pair, up to the second by one part more, beyond it by two.
DIRECT, SHALLOW = 32, 3000
#: Rows alike in all parts that are looked at are compared pair by pair up to this many, beyond it link by link.
DENSE = 128
#: Pairs that are compared at once.
PAIRS = 1 << 20
#: Ids of documents to drop go to every worker up to this many; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def rings(n: int = RINGS) -> np.ndarray:
    """For each ring, which of the bits stands where: in order, then fixed permutations."""
    return np.stack([np.arange(BITS) if k == 0 else np.random.default_rng(k).permutation(BITS) for k in range(n)])


class Hasher:
    """Texts to hashes; remembers words."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.bits = np.zeros((KNOWN, BITS // 8), np.uint8)

    def row(self, w: bytes) -> int:
        k = self.at.get(w)
        if k is None:
            k = self.at[w] = len(self.at)
            self.bits[k] = np.frombuffer(xxhash.xxh3_128_digest(w, seed=0) + xxhash.xxh3_128_digest(w, seed=1), np.uint8)
        return k

    def __call__(self, text: str | None) -> bytes | None:
        distinct = set(words(text)) if text else None
        if not distinct:
            return None
        if len(self.at) + len(distinct) > KNOWN:
            self.at.clear()
            if len(distinct) > KNOWN:
                self.bits = np.zeros((len(distinct), BITS // 8), np.uint8)
        have = list(map(self.at.get, distinct))
        if None in have:
            have = [self.row(w) for w in distinct]
        votes = np.zeros(BITS, np.int64)
        rows = np.array(have)
        for k in range(0, len(rows), 255):  # so many votes fit in a byte
            votes += np.add.reduce(np.unpackbits(self.bits[rows[k : k + 255]], axis=1), axis=0, dtype=np.uint8)
        return np.packbits(2 * votes > len(rows)).tobytes()


def hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = False) -> DataFrame:
    """doc_id, hash of the documents that have an id, or of all; a hash is null where there are no words. A map without a shuffle."""
    made: list[Hasher] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Hasher())
        return {"doc_id": batch.column("doc_id"), "hash": [made[0](t) for t in batch.column("text").to_pylist()]}

    kept = pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string"))
    return arrow_map(kept if null_ids else kept.filter("doc_id is not null"), run, "doc_id long, hash binary")


def chains(packed: np.ndarray, n: int = RINGS, joined: int = JOINED) -> np.ndarray:
    """Ring and place of each chain of `joined` segments, then their bits. The search doesn't use them, since a near pair need not share any; tests make such pairs."""
    bits, out = np.unpackbits(packed, axis=1), []
    for r, order in enumerate(rings(n)):
        ring = np.packbits(bits[:, order], axis=1).astype(np.int64)
        chain = sum(np.roll(ring, -j, axis=1) << (8 * j) for j in range(joined))
        out.append(chain + ((np.arange(SEGMENTS) + r * SEGMENTS) << (8 * joined)))
    return np.concatenate(out, axis=1)


def passes(d: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which rows of differences, in bits by segment or word, are of a near pair."""
    return np.flatnonzero(d.sum(axis=1, dtype=np.int64) <= distance)


def near(one: np.ndarray, others: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which of the other hashes are within the distance."""
    return passes(np.bitwise_count(np.ascontiguousarray(others).view(np.uint64) ^ np.ascontiguousarray(one).view(np.uint64)), distance)


def forest(packed: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect whatever is connected by near pairs: each row is compared with all that no link has reached."""
    left, out = np.lexsort(packed.T[::-1]), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(packed[i], packed[left], distance)
            if len(hit):
                out += [(i, j) for j in left[hit]]
                queue += left[hit].tolist()
                left = np.delete(left, hit)
    return out


def bridges(left: np.ndarray, right: np.ndarray, distance: int = DISTANCE, once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of near pairs between two blocks that connect whatever any of their near pairs connect: at most as many as there are rows.

    With `once` it is one pair, which is enough where each block is connected in itself.
    """
    i, j, of = [], [], np.arange(len(right))  # of: which part of the right block each row is of, so far
    for k in range(len(left)):
        hit = near(left[k], right, distance)
        if len(hit):
            if once:
                return np.array([k]), hit[:1]
            parts, first = np.unique(of[hit], return_index=True)
            i.append(np.full(len(first), k))
            j.append(hit[first])
            if len(parts) > 1:
                of[np.isin(of, parts)] = parts[0]
    return (np.concatenate(i), np.concatenate(j)) if i else (np.empty(0, np.int64),) * 2


def begins(distance: int = DISTANCE) -> list[int]:
    """Where on the ring each part begins; there is one part more than bits that may differ."""
    if not 0 <= distance < BITS:
        raise ValueError(f"a distance must be from 0 to {BITS - 1}")
    return [k * BITS // (distance + 1) for k in range(distance + 1)]


def window(packed: np.ndarray, start: int) -> np.ndarray:
    """The 64 bits of each hash from a place of the ring on."""
    ring = np.ascontiguousarray(packed).view(">u8").astype(np.uint64)
    k, off = divmod(start, 64)
    return ring[:, k] << np.uint64(off) | ring[:, (k + 1) % 4] >> np.uint64(64 - off) if off else ring[:, k]


def parts(packed: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """The keys of each hash: which part, then its bits (of a longer part the first 32)."""
    at = [*begins(distance), BITS]
    return np.stack([(window(packed, a) >> np.uint64(64 - min(32, b - a))).astype(np.int64) + (k << 32) for k, (a, b) in enumerate(zip(at, at[1:]))], axis=1)


@cache
def flips(widths: tuple[int, ...]) -> list[int]:
    """The ways in which two rows that agree in a part may differ in the next ones: in one bit of the first, in two of the first two."""
    out = [0]
    for k, width in enumerate(widths, 1):
        own = [sum(1 << b for b in c) for n in range(k + 1) for c in combinations(range(width), n)]
        out = [m << width | x for m in out for x in own if m.bit_count() + x.bit_count() <= k]
    return sorted(out)


def runs(start: np.ndarray, count: np.ndarray):
    """Whose it is, and the number: start, start + 1, ... of each, `count` of them; about PAIRS at a time."""
    ends = np.cumsum(count)
    k = 0
    while k < len(start):
        last = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        n = count[k:last]
        own = np.repeat(np.arange(k, last), n)
        if len(own):
            yield own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n - start[k:last], n)
        k = last


def linked(packed: np.ndarray, part: int, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Places of links among hashes that agree in a part.

    They connect whatever is connected by near pairs that from this part on keep to the pigeonring's bounds.
    """
    n, at = len(packed), begins(distance)
    ahead = [(at[(part + k) % len(at)] - at[part]) % BITS for k in range(1, len(at))] + [BITS]  # where the next parts begin
    bits = window(packed, at[part])
    key, widths = np.zeros(n, np.int64), []
    for a, b in zip(ahead, ahead[1:][: 0 if n <= DIRECT else 1 if n <= SHALLOW else 2]):
        b = min(b, a + 7)
        if b > 64:
            break
        widths.append(b - a)
        key = key << (b - a) | (bits << np.uint64(a) >> np.uint64(64 - b + a)).astype(np.int64)
    in_full = [b for b in ahead if b <= 64]
    budget, bits = max(len(in_full) - 1, 0), bits >> np.uint64(64 - in_full[-1] if in_full else 0)

    words = np.ascontiguousarray(packed).view(np.uint64)
    rows, of, found = np.arange(n), np.arange(n), []  # of: which connected set each row is of, so far

    def sort(order):
        nonlocal rows, of, key, bits, words
        rows, of, key, bits, words = (x[order] for x in (rows, of, key, bits, words))

    def join(i, j):
        """Keeps of these near pairs what connects."""
        nonlocal of
        while True:
            a, b = of[i], of[j]
            some = np.flatnonzero(a != b)
            if not len(some):
                return
            i, j, a, b = i[some], j[some], a[some], b[some]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            found.append((rows[i[first]], rows[j[first]]))
            root = np.arange(n)
            root[high] = np.minimum(a, b)[first]
            while (root[root] != root).any():
                root = root[root]
            of = root[of]

    def test(i, j):
        some = np.flatnonzero(np.bitwise_count(bits[i] ^ bits[j]) <= budget)
        if len(some):
            i, j = i[some], j[some]
            some = passes(np.bitwise_count(words[i] ^ words[j]), distance)
            join(i[some], j[some])

    sort(np.argsort(key, kind="stable"))
    # rows with the same key
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, n])
    ends = np.repeat(first + size, size)
    few = np.flatnonzero(np.repeat(size <= DENSE, size))
    for own, j in runs(few + 1, ends[few] - few - 1):
        test(few[own], j)
    for k in np.flatnonzero(size > DENSE):
        if tree := forest(words[first[k] : first[k] + size[k]].view(np.uint8), distance):
            join(*(first[k] + np.array(tree).T))
    # rows that a link connects, and that have the same key, go on as one
    sort(np.lexsort((of, key)))
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
    size = np.diff(np.r_[first, n])
    keys = key[first]
    table = np.searchsorted(keys, np.arange((1 << sum(widths)) + 1))
    for flip in flips(tuple(widths))[1:]:
        mine = np.flatnonzero(keys & (1 << (flip.bit_length() - 1)) == 0)
        low, high = table[keys[mine] ^ flip], table[(keys[mine] ^ flip) + 1]
        some = np.flatnonzero(high > low)
        mine, low, high = mine[some], low[some], high[some]
        for own, theirs in runs(low, high - low):
            own = mine[own]
            if len(keys) == n:
                test(own, theirs)
                continue
            some = np.flatnonzero(of[first[own]] != of[first[theirs]])
            own, theirs = own[some], theirs[some]
            area = size[own] * size[theirs]
            some = np.flatnonzero(area <= DENSE * DENSE)
            for k, x in runs(np.zeros(len(some), np.int64), area[some]):
                k = some[k]
                test(first[own[k]] + x // size[theirs[k]], first[theirs[k]] + x % size[theirs[k]])
            for k in np.flatnonzero(area > DENSE * DENSE):
                a, b = sorted((own[k], theirs[k]), key=lambda g: size[g])
                if of[first[a]] != of[first[b]]:
                    i, j = bridges(*(words[first[g] : first[g] + size[g]].view(np.uint8) for g in (a, b)), distance, once=True)
                    join(first[a] + i, first[b] + j)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct hashes, which connect whatever is connected by pairs within the distance.

    A set of more than `block` documents that meet is not compared where it meets: each two of its blocks
    are shuffled again and compared by as many tasks.
    """

    def spread(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                packed = np.frombuffer(b"".join(part.column("hash").to_pylist()), np.uint8).reshape(-1, BITS // 8)
                keys = parts(packed, distance)
                at = np.repeat(np.arange(len(packed)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), part.column("hash").take(pa.array(at))], ["key", "hash"])

    def meet(batches):
        """Links of sets of up to `block`; of a larger one each hash, with each pair of blocks that it belongs to, for the second shuffle."""
        held, at = [], None  # the batches that end with key `at`, and so may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            first = int(np.searchsorted(keys, at, "right")) if at is not None else 0
            if first < len(keys) or at is None:
                last = int(np.searchsorted(keys, keys[-1]))
                yield from within(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held, at = [batch.slice(last)], keys[-1]
            else:
                held.append(batch)
        if held:
            yield from within(pa.Table.from_batches(held))

    def compare(batches):
        """Of each pair of blocks the links among their rows."""
        for table in whole(batches, "task"):
            tasks, part = table.column("task").to_numpy(), table.column("part").to_numpy()
            every = table.column("a").to_pylist()
            packed = np.frombuffer(b"".join(every), np.uint8).reshape(-1, BITS // 8)
            starts = np.flatnonzero(np.r_[True, tasks[1:] != tasks[:-1]])
            for start, end in zip(starts, [*starts[1:], len(tasks)]):
                found = linked(packed[start:end], int(part[start]), distance)
                if len(found[0]):
                    pairs = [pa.array(every, pa.binary()).take(pa.array(start + x)) for x in found]
                    yield pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    def split(key: int, hashes: pa.Array):
        """Rows for the second shuffle: of n blocks each hash goes to n - 1 pairs of blocks."""
        n = -(-len(hashes) // block)
        for x in range(n):
            own = hashes.slice(x * block, block)
            for y in range(n):
                if x != y:
                    task = xxhash.xxh3_64_intdigest(f"{key}:{min(x, y)}:{max(x, y)}") >> 1
                    k = len(own)
                    yield pa.RecordBatch.from_arrays([own, pa.nulls(k, pa.binary()), pa.array(np.full(k, task)), pa.array(np.full(k, key >> 32, np.int32))], ["a", "b", "task", "part"])

    def within(table: pa.Table):
        keys = table.column("key").to_numpy()
        if len(keys) < 2:
            return
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        some = np.repeat(sizes > 1, sizes)
        if not some.any():
            return
        every = table.column("hash").filter(pa.array(some)).to_pylist()
        packed = np.frombuffer(b"".join(every), np.uint8).reshape(-1, BITS // 8)
        sizes = sizes[sizes > 1]
        at = np.cumsum(sizes) - sizes
        met = keys[some][at]
        i, j = [], []
        for size in range(2, SMALL + 1):  # all sets of a size at once, pair by pair
            first = at[sizes == size]
            for x in range(size):
                for y in range(x + 1, size):
                    for k in range(0, len(first), 1 << 14):
                        some = first[k : k + (1 << 14)]
                        hit = some[passes(np.bitwise_count(packed[some + x] ^ packed[some + y]), distance)]
                        i.append(hit + x)
                        j.append(hit + y)
        hot = sizes > block
        for start, size, key in zip(at[hot].tolist(), sizes[hot].tolist(), met[hot].tolist()):
            yield from split(key, pa.array(every[start : start + size], pa.binary()))
        between = (sizes > SMALL) & ~hot
        for start, size, key in zip(at[between].tolist(), sizes[between].tolist(), met[between].tolist()):
            x, y = linked(packed[start : start + size], key >> 32, distance)
            i.append(x + start)
            j.append(y + start)
        if i:
            pairs = (pa.array(every, pa.binary()).take(pa.array(np.concatenate(x))) for x in (i, j))
            pairs, k = list(pairs), sum(map(len, i))
            yield pa.RecordBatch.from_arrays([*pairs, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())], ["a", "b", "task", "part"])

    spreaded = nodes.select("hash").mapInArrow(spread, "key long, hash binary")
    met = cut(spreaded.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a binary, b binary, task long, part int"))
    found = met.filter("task is null").select("a", "b")
    if met.filter("task is not null").take(1):
        hot = met.filter("task is not null").select("task", "part", "a")
        found = found.union(hot.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "a binary, b binary"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every linked node, by alternating large-star and small-star.

    Each round is checkpointed; rounds end when the links, all pointing at their least node, no longer change.
    """
    edges = cut(edges.filter("a <> b"))
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        w = W.partitionBy("a")
        large = both.withColumn("m", F.least("a", F.min("b").over(w))).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # large-star links run from the greater to the lesser; small-star joins a node's lesser neighbours to the least of them
        small = large.withColumn("m", F.min("b").over(w))
        small = small.select("a", F.col("m").alias("b")).union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        before, edges = edges, cut(small)
        drop(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def placed(known: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, hash, root of every row of hashes() that has a hash; rows of one root are one group."""
    known = known.filter("hash is not null")
    nodes = cut(known.select("hash").distinct())
    roots = components(links(nodes, distance)).withColumnRenamed("node", "hash")
    drop(nodes)
    return known.join(roots, "hash", "left").select("doc_id", "hash", F.coalesce("root", "hash").alias("root"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, group_id, group_size: every document that has near-duplicates, with the document that stays for it."""
    all_ = placed(cut(hashes(docs, id_col, text_col)), distance).select("doc_id", "root").distinct()
    sizes = all_.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    return all_.join(sizes, "root").select("doc_id", "group_id", "group_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, null_ids: bool = False) -> DataFrame:
    """The documents without those that another one stays for, with all their columns.

    Ids that occur in several rows are looked at by text: of rows alike in id and hash one stays. With `null_ids` so are
    rows of null id; without it they all stay.
    """
    id_ = docs[id_col].cast("long")
    known = cut(hashes(docs, id_col, text_col, null_ids))
    all_ = placed(known, distance)
    stay = all_.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")).alias("s"))
    stay = cut(stay.select(F.col("s.doc_id").alias("id"), F.col("s.hash").alias("hash")))
    # an id that occurs once goes unless it stays for a group; ids of several rows go here and come back below
    counts = known.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n"), F.count("hash").alias("hashed"))
    gone = counts.join(stay.select(F.col("id").alias("__id")).distinct().withColumn("stays", F.lit(True)), "__id", "left")
    gone = cut(gone.filter("n > 1 or hashed > 0 and stays is null").select("__id", "n"))
    drop(known)
    once = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, id_ == gone["__id"], "left_anti")
    again = gone.filter("n > 1 or __id is null").select("__id")
    if not again.take(1):
        return once
    # the few ids of several rows: one row of each (id, hash) that stays; rows without a hash stay
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    rows = docs.join(again, id_ == again["__id"], "left_semi").select(row)
    if again.filter("__id is null").take(1):
        once, rows = once.filter(id_.isNotNull()), rows.union(docs.filter(id_.isNull()).select(row))
    made: list[Hasher] = []

    @F.arrow_udf("binary")
    def hashed(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Hasher())
        return pa.array([made[0](t) for t in texts.to_pylist()], pa.binary())

    rows = rows.select("row", F.col("row").getField(id_col).cast("long").alias("id"), hashed(F.col("row").getField(text_col).cast("string")).alias("hash"))
    first = rows.filter("hash is not null").withColumn("n", F.row_number().over(W.partitionBy("id", "hash").orderBy("id"))).filter("n = 1")
    stays = stay.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"))
    first = first.join(stays, (first["hash"] == stays["__hash"]) & first["id"].eqNullSafe(stays["__id"]), "left_semi").select("row")
    return once.unionByName(first.union(rows.filter("hash is null").select("row")).select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
