import random
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm import simhash as S
from loomgrid.llm.common import words

FOLDER = "/root/testdata/sf0.001"


def slow_hash(text):
    votes = [0] * 256
    w = set(words(text))
    for x in w:
        b = np.unpackbits(np.frombuffer(xxhash.xxh3_128_digest(x, seed=0) + xxhash.xxh3_128_digest(x, seed=1), np.uint8))
        votes = [v + int(y) for v, y in zip(votes, b)]
    return np.packbits([2 * v > len(w) for v in votes]).tobytes() if w else None


def test_hash_is_the_majority():
    h = S.Hasher()
    for t in ["one", "a b", "the river ran past the mill", " ".join(map(str, range(700))), "", "...", None]:
        assert h(t) == (slow_hash(t) if t else None)


@settings(deadline=None, max_examples=200)
@given(st.sets(st.integers(0, 255), max_size=S.DISTANCE + 3))
def test_chain_test_never_loses_a_near_pair(flips):
    a = np.zeros(32, np.uint8)
    bits = np.zeros(256, np.uint8)
    bits[list(flips)] = 1
    assert len(S.near(a, np.packbits(bits)[None])) == (len(flips) <= S.DISTANCE)


@settings(deadline=None, max_examples=200)
@given(st.sets(st.integers(0, 255), max_size=8))
def test_pairs_within_eight_bits_always_meet(flips):
    bits = np.zeros(256, np.uint8)
    bits[list(flips)] = 1
    keys = S.chains(np.stack([np.zeros(32, np.uint8), np.packbits(bits)]), 1)
    assert (keys[0] == keys[1]).any()


def brute(rows, distance=S.DISTANCE):
    """Pairs and groups by comparing all with all."""
    h = {d: np.frombuffer(slow_hash(t), np.uint64) for d, t in rows if d is not None and t and words(t)}
    ids, parent, pairs = sorted(h), {d: d for d in h}, []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if np.bitwise_count(h[i] ^ h[j]).sum() <= distance:
                pairs.append((i, j))
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return pairs, {d: find(d) for d in ids}


def copies(n, seed=3):
    r = random.Random(seed)
    rows, k = [], 0
    for g in range(n):
        base = [f"w{r.randrange(4000)}" for _ in range(120)]
        for c in range(r.randrange(1, 5)):
            t = list(base)
            for _ in range(c * 2):
                t[r.randrange(120)] = f"w{r.randrange(4000)}"
            rows.append((k, " ".join(t)))
            k += 1
    return rows


def test_recall_against_brute_force(spark):
    rows = copies(60) + [(10_000 + r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    pairs, group = brute(rows)
    got = {r.doc_id: r.group_id for r in S.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(group[d] == group[g] for d, g in got.items())  # nothing that brute force keeps apart is joined
    assert sum(got.get(a, a) == got.get(b, -1) for a, b in pairs) >= 0.9 * len(pairs) and len(pairs) > 50


def test_a_large_group_is_linked_in_proportion(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(800):
        t = list(base)
        t[r.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = S.hashes(df).filter("hash is not null").dropDuplicates(["hash"])
    got = S.groups(df).collect()
    assert len(got) == 800 and {x.group_id for x in got} == {0} and {x.group_size for x in got} == {800}
    assert S.links(nodes).count() < 64 * 800


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (103, 100)] + [(7, 7)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward(awkward, nothing, spark):
    got = {(r.doc_id, r.group_id, r.group_size) for r in S.groups(awkward).collect()}
    assert got == {(1, 1, 2), (2, 1, 2)}
    kept = S.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == {1: 1, 3: 1, 4: 1, 5: 1, None: 2, 6: 1, 7: 1, 8: 1, 9: 1}
    assert S.groups(nothing).count() == 0 and S.keep_one(nothing).count() == 0


def test_ids_of_several_rows(spark):
    t = "the quick brown fox jumps over the lazy dog and runs away from it all at once".split()
    u = "an entirely different sentence about ships sailing on a calm sea towards harbour lights tonight".split()
    rows = [(1, " ".join(t)), (1, " ".join(t)), (1, " ".join(u)), (2, " ".join(u)), (3, " ".join(t)), (4, None), (4, None), (5, "alone here"), (6, " ".join(t)), (6, None)]
    kept = sorted(((r.doc_id, r.text) for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(1, " ".join(t)), (1, " ".join(u)), (4, None), (4, None), (5, "alone here"), (6, None)], key=str)


def parts(n, pairs):
    of = list(range(n))
    for a, b in pairs:
        a, b = of[a], of[b]
        of = [min(a, b) if x in (a, b) else x for x in of]
    return of


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10**6), st.integers(1, 14), st.integers(1, 14))
def test_bridges_connect_what_near_pairs_connect(seed, n, m):
    r = np.random.default_rng(seed)
    base = r.integers(0, 256, (3, 32), dtype=np.uint8)
    rows = base[r.integers(0, 3, n + m)].copy()
    for row in rows:
        for b in r.choice(256, r.integers(0, 40), replace=False):
            row[b // 8] ^= 1 << (b % 8)
    i, j = S.bridges(rows[:n], rows[n:])
    near = [(a, n + b) for a in range(n) for b in range(m) if np.bitwise_count(rows[a] ^ rows[n + b]).sum() <= S.DISTANCE]
    assert set(zip(i.tolist(), (j + n).tolist())) <= set(near) and len(i) <= n + m
    assert parts(n + m, zip(i.tolist(), (j + n).tolist())) == parts(n + m, near)


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10**6), st.integers(0, 60))
def test_passes_is_the_full_check(seed, distance):
    r = np.random.default_rng(seed)
    d = np.bitwise_count((r.random((50, 32, 8)) < r.random((50, 1, 1)) * 0.3).dot(1 << np.arange(8)).astype(np.uint8))
    assert S.passes(d, distance).tolist() == np.flatnonzero(d.sum(axis=1) <= distance).tolist()


def test_hot_keys_are_split(spark):
    """The same groups, however small the blocks; keys of four segments too."""
    rows = copies(12, 5) + [(9000 + k, " ".join([f"b{i}" for i in range(150)] + [f"x{k}"])) for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = S.cut(S.hashes(df).filter("hash is not null").select("hash").distinct())
    want = {(bytes(r.node), bytes(r.root)) for r in S.components(S.links(nodes)).collect()}
    for block in (5, 16, 69):
        assert {(bytes(r.node), bytes(r.root)) for r in S.components(S.links(nodes, block=block)).collect()} == want
    four = S.chains(np.random.default_rng(0).integers(0, 256, (50, 32), dtype=np.uint8), 2, 4)
    assert four.dtype == np.int64 and four.max() >= 1 << 32 and len(np.unique(four)) == four.size


def scattered(n, seed):
    """Pairs of hashes that differ in 36 bits and share no chain of three segments."""
    r, out = np.random.default_rng(seed), []
    while len(out) < n:
        a = r.integers(0, 256, 32, dtype=np.uint8)
        at = np.r_[np.arange(32), r.choice(32, 4, replace=False)]
        b = np.unpackbits(a)
        for k in range(36):
            free = np.flatnonzero(b[8 * at[k] : 8 * at[k] + 8] == np.unpackbits(a)[8 * at[k] : 8 * at[k] + 8])
            b[8 * at[k] + r.choice(free)] ^= 1
        b = np.packbits(b)
        if not (np.diff(S.chains(np.stack([a, b])), axis=0) == 0).any():
            out.append((a, b))
    return out


def test_pairs_that_share_no_chain_are_linked(spark):
    pairs = scattered(200, 4)
    assert all(np.bitwise_count(a ^ b).sum() == S.DISTANCE for a, b in pairs)
    nodes = spark.createDataFrame([(x.tobytes(),) for p in pairs for x in p], "hash binary")
    want = {tuple(sorted((a.tobytes(), b.tobytes()))) for a, b in pairs}
    assert {(bytes(r.a), bytes(r.b)) for r in S.links(nodes).collect()} == want
    assert {(bytes(r.a), bytes(r.b)) for r in S.links(nodes, block=5).collect()} == want
    assert S.links(nodes, 35).count() == 0


def test_groups_are_those_of_brute_force(spark):
    rows = copies(150, 8) + [(10_000 + r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    pairs, group = brute(rows)
    got = {r.doc_id: r.group_id for r in S.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: g for d, g in group.items() if d in {x for p in pairs for x in p}}


def met(packed, distance):
    """The links of all sets that meet, without Spark."""
    keys, out = S.parts(packed, distance), []
    for k in range(keys.shape[1]):
        for key in np.unique(keys[:, k]):
            at = np.flatnonzero(keys[:, k] == key)
            out += [(int(at[i]), int(at[j])) for i, j in zip(*S.linked(packed[at], int(key) >> 32, distance))]
    return out


@settings(deadline=None, max_examples=80)
@given(st.integers(0, 10**6), st.sampled_from([0, 1, 2, 3, 8, 17, 36, 36, 36, 60, 100]), st.integers(0, 2), st.sampled_from([1, 4, 128]), st.sampled_from([7, 1 << 20]))
def test_all_that_is_near_is_connected(seed, distance, level, dense, pairs):
    r = np.random.default_rng(seed)
    n = int(r.integers(2, 80))
    base = r.integers(0, 256, (int(r.integers(1, 7)), 32), dtype=np.uint8)
    rows = base[r.integers(0, len(base), n)]
    for row in rows:
        for b in r.choice(256, r.integers(0, distance + 2), replace=False):
            row[b // 8] ^= 1 << (b % 8)
    rows = np.unique(rows, axis=0)
    n = len(rows)
    near = [(a, b) for a in range(n) for b in range(a + 1, n) if np.bitwise_count(rows[a] ^ rows[b]).sum() <= distance]
    before = S.DIRECT, S.SHALLOW, S.DENSE, S.PAIRS
    S.DIRECT, S.SHALLOW, S.DENSE, S.PAIRS = *[(1000, 1000), (1, 1000), (1, 1)][level], dense, pairs
    try:
        got = met(rows, distance)
    finally:
        S.DIRECT, S.SHALLOW, S.DENSE, S.PAIRS = before
    assert {tuple(sorted(p)) for p in got} <= set(near)
    assert parts(n, got) == parts(n, near)
