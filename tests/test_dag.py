"""Layers against a walk of each plan in plain Python: in one pass, and level by level for plans too large for it."""

import random

import pyarrow as pa
import pytest

from loomgrid.operators import dag

SCHEMA = "plan string, task string, waits array<string>, hours double, priority int"


def graphs(seed=5):
    rng, rows = random.Random(seed), []
    for p in range(40):
        names = rng.sample("abcdefghijklmnop", rng.randint(1, 12))
        rows += [(f"p{p}", t, rng.choices([*names[:i], "nowhere", None], k=rng.randint(0, 4)), float(rng.randint(1, 9)), rng.randint(1, 3)) for i, t in enumerate(names)]
    rows += [("chain", f"{i:03}", [f"{i - 1:03}"] if i else None, 0.5, 1) for i in range(60)]
    rows += [(None, "a", [], 1.0, 1), (None, "b", ["a"], 1.0, 1), ("q", None, ["a"], 2.0, 1), ("q", "a", [None], None, 1), ("q", "b", ["a"], 3.0, 1)]
    rng.shuffle(rows)
    return rows


def walked(rows):
    """(plan, task) -> layer."""
    waits = {(p, t): {w for w in ws or [] if p is not None and None not in (t, w) and any(x[:2] == (p, w) for x in rows)} for p, t, ws, *_ in rows}
    at = {}
    while len(at) < len(waits):
        at |= {k: max([1 + at[k[0], w] for w in ws], default=0) for k, ws in waits.items() if k not in at and all((k[0], w) in at for w in ws)}
    return at


@pytest.fixture
def settled(monkeypatch):
    calls, f = [], dag.settled
    monkeypatch.setattr(dag, "settled", lambda df: calls.append(df) or f(df))
    return calls


def test_layers_are_settled_once_however_deep(spark, settled):
    rows = graphs()
    got = dag.layers(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and {(r.plan, r.task): r.layer for r in got} == walked(rows)
    assert len(settled) == 1


def test_large_plans_level_by_level(spark, settled):
    rows = [r for r in graphs() if r[0] != "chain"]
    got = dag.placed(spark.createDataFrame(rows, SCHEMA), "priority", most=2).collect()
    assert len(got) == len(rows) and {(r.plan, r.task): r.layer for r in got} == walked(rows)
    assert {(r.plan, r.task): r.priority for r in got} == {r[:2]: r[4] for r in rows}
    assert len(settled) > 3


def test_cycle_in_a_large_plan_raises(spark):
    loop = spark.createDataFrame([("p", 1, [3]), ("p", 2, [1]), ("p", 3, [2]), ("q", 1, [])], "plan string, task int, waits array<int>")
    for most in (2, 3):
        with pytest.raises(ValueError):
            dag.placed(loop, most=most)


def test_tables_hold_whole_plans(monkeypatch):
    monkeypatch.setattr(dag, "AT_ONCE", 4)
    sizes = [3, 1, 6, 2, 9, 1, 1, 5, 0, 0, 2]
    rows = [(k, i + 1, n) for k, n in enumerate(sizes) for i in range(n or 1)]
    table = pa.table({"plan": [r[0] for r in rows], "__place": [r[1] for r in rows], "__tasks": [r[2] for r in rows]})
    for step in (1, 2, 3, 7, 50):
        got = [t.to_pydict() for t in dag.whole_plans(table.to_batches(max_chunksize=step), 6)]
        assert sorted(x for t in got for x in zip(*t.values())) == sorted(rows)
        assert all(t["__place"][0] == 1 and set(t["plan"]).isdisjoint(u["plan"]) for i, t in enumerate(got) for u in got[:i] if 0 < t["__tasks"][0] <= 6)


@pytest.mark.parametrize("most", [dag.MOST, 2])
def test_critical_path(spark, settled, monkeypatch, most):
    rows = [r for r in graphs() if most > 2 or r[0] != "chain"]
    at, ends = walked(rows), {}
    for p, t, ws, h, _ in sorted(rows, key=lambda r: at[r[:2]]):
        before = [ends[p, w] for w in ws or [] if at[p, t] and (p, w) in at and None not in (t, w)]
        ends[p, t] = None if h is None or before and set(before) == {None} else h + max((b for b in before if b is not None), default=0)
    want = {p: max(e for k, e in ends.items() if k[0] == p and e is not None) for p in {r[0] for r in rows} - {None}}
    place = dag.placed
    monkeypatch.setattr(dag, "placed", lambda *a, **k: place(*a, **k, most=most))
    got = {r.plan: (r.hours, r.saved) for r in dag.critical_path(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {p: (h, sum(r[3] or 0 for r in rows if r[0] == p) - h) for p, h in want.items()}
    assert most == 2 or len(settled) == 1


def in_order(rows):
    """Known tasks of known plans, by plan in the order of starts."""
    at, plans = walked(rows), {}
    for r in sorted((r for r in rows if None not in r[:2]), key=lambda r: (at[r[:2]], r[4], r[1])):
        plans.setdefault(r[0], []).append(r)
    return plans


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_start_and_stop_reads_tasks_once(spark):
    rows = graphs()
    got = dag.start_and_stop(spark.createDataFrame(rows, SCHEMA))
    assert {(r.plan, r.task): r.start_order for r in got.collect()} == {r[:2]: i for rs in in_order(rows).values() for i, r in enumerate(rs, 1)}
    assert all(r.start_order + r.stop_order == len(in_order(rows)[r.plan]) + 1 for r in got.collect())
    assert joins(got) == 0


def test_simulated_run_reads_tasks_once(spark):
    rows = graphs()
    got, want = dag.simulated(spark.createDataFrame(rows, SCHEMA)), {}
    for rs in in_order(rows).values():
        for i, r in enumerate(rs, 1):
            hours = [x[3] for x in rs[:i] if x[3] is not None]
            want[r[:2]] = sum(hours) if hours else None
    assert {(r.plan, r.task): r.ends for r in got.collect()} == want
    assert joins(got) == 0
