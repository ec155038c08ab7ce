import random

import pytest

from loomgrid.llm import decontam as D


def naive(item, doc, least):
    """Greedy string tiling by its definition: the longest free match first, then by place in the item and the document."""
    a, b, total = [0] * len(item), [0] * len(doc), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total
        a[i : i + k] = b[j : j + k] = [1] * k
        total += k


def test_tiles_against_the_definition():
    r = random.Random(5)
    for _ in range(200):
        item = [r.randrange(6) for _ in range(r.randrange(1, 40))]
        doc = [r.randrange(6) for _ in range(r.randrange(0, 30))]
        for _ in range(r.randrange(3)):
            k = r.randrange(len(item))
            doc += item[k : k + r.randrange(1, 40)] + [r.randrange(6)]
        tiles = D.tiles(item, doc, 3)
        marked = [x for i, _, k in tiles for x in range(i, i + k)]
        there = [x for _, j, k in tiles for x in range(j, j + k)]
        assert len(set(marked)) == len(marked) and len(set(there)) == len(there)
        assert all(item[i : i + k] == doc[j : j + k] and k >= 3 for i, j, k in tiles)
        assert abs(len(marked) - naive(item, doc, 3)) <= 2, (item, doc)  # search lengths halve, so equal lengths may be taken in another order


def test_running_hashes():
    r = random.Random(1)
    t = [r.randrange(1, 9) for _ in range(200)]
    h = list(D.running(t, 4))
    for i in range(len(h)):
        for j in range(len(h)):
            assert (h[i] == h[j]) == (t[i : i + 4] == t[j : j + 4])


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
HALF = ITEM.split()


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM), (2, "too short"), (3, None), (None, "one two three four five six"), (4, ""), (5, ITEM.upper()), (6, "one one one one one one one one")]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "item_id long, text string, doc_id long, hash string")


@pytest.fixture(scope="module")
def docs(spark):
    moved = " ".join(HALF[12:]) + ". Then: " + " ".join(HALF[6:12]) + " - " + " ".join(HALF[:6])
    rows = [(1, "So " + ITEM + " indeed"), (2, moved), (3, " ".join(HALF[::-1])), (4, " ".join(HALF[:11]) + " and so on"), (5, " ".join(HALF[:13])), (6, None), (7, ""), (8, "one " * 30), (9, ITEM), (9, ITEM), (None, ITEM), (10, "word " * 100_000 + ITEM), (11, "alpha beta gamma " * 9)]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, item_id long, coverage string")


def test_both_ways_and_reordered(docs, benchmark):
    one = sorted(map(tuple, D.find(docs, benchmark).collect()), key=str)
    assert one == sorted(map(tuple, D.find(docs, benchmark, broadcast_bytes=0).collect()), key=str)
    full = {(d, i): (c, n) for d, i, c, _, _, n in one}
    assert full[2, 1] == (1.0, 3) and full[1, 1] == (1.0, 1) and full[1, 5][0] == 1.0 and full[8, 6][0] == 1.0
    assert full[5, 1][0] == 13 / 24
    assert {d for d, _ in full} == {1, 2, 5, 8, 9, None, 10}


def test_clean(docs, benchmark, spark):
    for way in ({}, {"broadcast_bytes": 0}):
        kept = D.clean(docs, benchmark, **way)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7, 11]


def test_awkward(awkward, nothing, benchmark, docs):
    assert D.find(awkward, benchmark).count() == 0 and D.find(nothing, benchmark).count() == 0
    assert D.find(docs, benchmark.filter("1 = 0")).count() == 0
    assert D.clean(awkward, benchmark).count() == awkward.count()
    assert D.clean(awkward, benchmark, broadcast_bytes=0).count() == awkward.count()
    assert D.clean(nothing, benchmark, broadcast_bytes=0).count() == 0


def test_planted_passages(spark):
    folder = "/root/testdata/sf0.001"
    found = {(r.doc_id, r.item_id) for r in D.query(spark, folder).collect()}
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text} <= found
    assert all(len(set(D.words(next(i.text for i in items if i.item_id == k))) & set(D.words(next(d.text for d in docs if d.doc_id == n)))) for n, k in found)
