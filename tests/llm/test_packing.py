import random
from bisect import bisect_left
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm import packing as P


def naive(sizes, capacities, overhead, attention, least=0):
    """Best fit by looking at every open bin, and at every piece to come when one is opened."""
    price = lambda c: c * (1 + c / attention) + overhead
    bins, where, todo = [], {}, sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for n, i in enumerate(todo):
        s = sizes[i]

        def filled(c):
            got = s
            for j in todo[n + 1 :]:
                if got + sizes[j] <= c:
                    got += sizes[j]
            return got

        fits = [(c - f, b) for b, (c, f) in enumerate(bins) if c - f >= s]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            some = [c for c in capacities if c >= max(s, least)]
            bins.append([some[0] if least else min(some, key=lambda c: (price(c) / filled(c), c)), 0])
        where[i] = (b, bins[b][1])
        bins[b][1] += s
    small = [capacities[bisect_left(capacities, f)] for _, f in bins]
    return sum(map(price, small)), [(b, small[b], at) for b, at in (where[i] for i in range(len(sizes)))]


PLANS = (st.lists(st.integers(1, 64), max_size=60), st.sampled_from([(64,), (16, 64), (8, 16, 32, 64)]), st.sampled_from([0, 4, 40]), st.sampled_from([50.0, 300.0, 1e9]))


@settings(deadline=None, max_examples=150)
@given(*PLANS)
def test_same_as_naive(sizes, capacities, overhead, attention):
    got = P.best_fit(sizes, capacities, overhead, attention)
    plans = [naive(sizes, capacities, overhead, attention, least) for least in (0, *capacities)]
    assert got == min(plans, key=lambda p: p[0])[1]
    held = defaultdict(list)
    for (b, c, at), s in zip(got, sizes):
        held[b, c].append((at, at + s))
    for (_, c), spans in held.items():
        spans.sort()
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] <= c
        assert all(k >= c or k < spans[-1][1] for k in capacities)  # no smaller permitted length would do


@settings(deadline=None, max_examples=100)
@given(*PLANS)
def test_never_dearer_than_a_fixed_length(sizes, capacities, overhead, attention):
    got = {(b, c) for b, c, _ in P.best_fit(sizes, capacities, overhead, attention)}
    mine = sum(P.cost(c, overhead, attention) for _, c in got)
    for least in capacities:
        assert mine <= naive(sizes, capacities, overhead, attention, least)[0] + 1e-6
    assert mine <= len({b for b, _, _ in P.best_fit(sizes, capacities[-1:], overhead, attention)}) * P.cost(capacities[-1], overhead, attention) + 1e-6


def test_least_cost_opening():
    assert P.best_fit([10] * 6, (16, 64), 4, 1e9) == [(0, 64, 10 * k) for k in range(6)]  # a long bin costs less a token while enough is left to fill it
    assert P.best_fit([10] * 2, (16, 64), 4, 1e9) == [(0, 16, 0), (1, 16, 0)]
    assert P.best_fit([10], (16, 64), 4, 1e9)[0][1] == 16


def test_several_lengths_are_opened_before_the_tail():
    """As production runs: long pieces need long sequences, short ones fill the length that costs least a token."""
    r = random.Random(1)
    sizes = [min(4096, int(r.lognormvariate(6, 1.2)) + 1) for _ in range(3000)]
    order = sorted(sizes, reverse=True)
    price = {c: P.cost(c) for c in P.CAPACITIES}
    _, where, filled = P.planned(order, P.CAPACITIES, price)
    early = {P.CAPACITIES[bisect_left(P.CAPACITIES, filled[b])] for (b, at), s in zip(where[:1500], order)}
    assert len(early) >= 3
    got = P.best_fit(sizes)
    bins = {b: c for b, c, _ in got}
    assert sum(sizes) >= 0.95 * sum(bins.values())


def test_whole_documents(spark, awkward, nothing):
    rows = P.pack(awkward).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.doc_id] += r.tokens
    assert by == {1: 42, 2: 84, None: 53, 6: 120_001, 7: 2, 8: 2, 9: 100}
    assert all(r.bin_offset + r.tokens <= r.capacity for r in rows)
    assert [r.start for r in sorted((r for r in rows if r.doc_id == 6), key=lambda r: r.piece)] == [4096 * k for k in range(30)]
    assert P.pack(nothing).count() == 0


def test_shards_share_nothing(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 700 + 1)) for i in range(300)], "doc_id long, text string")
    few = P.pack(docs, shard=50).collect()
    assert len({r.shard for r in few}) > 1 and sorted(r.doc_id for r in few) == list(range(300))
    assert all(r.tokens == r.doc_id % 700 + 2 for r in few)


def test_null_and_repeated_ids_fill_no_shard(spark):
    rows = [(None, "a b c")] * 700 + [(5, "d " * (k % 40 + 1)) for k in range(700)] + [(k, "x y") for k in range(100, 200)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), shard=50).collect()
    assert len(got) == 1500 and sum(r.doc_id is None and r.tokens == 4 for r in got) == 700
    assert max(Counter(r.shard for r in got).values()) < 250
    spans = sorted((r.shard, r.bin, r.bin_offset, r.tokens) for r in got)
    assert all(x[:2] != y[:2] or x[2] + x[3] == y[2] for x, y in zip(spans, spans[1:]))
