"""Dependency graphs: layers, order, roots, plans. The rows of a plan come together and are settled in one pass; plans too large for that go level by level, each level a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Tasks of the largest plan that is settled in memory. Rows that are settled at once, at least.
MOST, AT_ONCE = 1_000_000, 65_536
#: Layers of tasks that a cycle keeps from starting, and of those whose plan is too large.
CYCLE, LARGE = -1, -2

#: Assignments by pattern: phase, agent, hours, what it waits for, priority.
PLANS = {
    "sequential": [("planning", "project_manager", 1.0, "", 1), ("implementation", "developer", 4.0, "planning", 2), ("review", "reviewer", 1.0, "implementation", 3), ("testing", "qa", 2.0, "review", 4)],
    "parallel": [("planning", "project_manager", 1.0, "", 1), ("implementation_1", "developer", 3.0, "planning", 2), ("implementation_2", "developer", 3.0, "planning", 2)],
    "fan_out_in": [("planning", "project_manager", 1.0, "", 1), ("architecture", "architect", 2.0, "planning", 2), ("implementation", "developer", 4.0, "planning", 2), ("testing", "qa", 2.0, "planning", 2), ("review", "reviewer", 1.0, "architecture implementation testing", 3)],
    "pipeline": [("planning", "project_manager", 1.0, "", 1), ("architecture", "architect", 2.0, "planning", 2), ("implementation", "developer", 4.0, "architecture", 3), ("review", "reviewer", 1.0, "implementation", 4), ("testing", "qa", 2.0, "review", 5)],
    "conditional": [("planning", "project_manager", 1.0, "", 1), ("architecture", "architect", 2.0, "planning", 2), ("implementation", "developer", 5.6, "architecture", 3), ("review", "reviewer", 2.0, "implementation", 4)],
}
#: Nodes of each kind's workflow in order, with agent and progress in per cent.
WORKFLOWS = {
    "feature": [("planning", "project_manager", 10), ("architecture", "architect", 25), ("development", "developer", 60), ("code_review", "code_reviewer", 75), ("testing", "qa_agent", 90), ("documentation", "documentation_agent", 100)],
    "bug_fix": [("analysis", "developer", 20), ("reproduction", "qa_agent", 40), ("fix_development", "developer", 60), ("testing", "qa_agent", 90), ("code_review", "code_reviewer", 100)],
    "documentation": [("analysis", "documentation_agent", 30), ("writing", "documentation_agent", 70), ("review", "project_manager", 100)],
    "code_review": [("review", "code_reviewer", 75), ("feedback", "project_manager", 100)],
}


def plan_table(spark: SparkSession) -> DataFrame:
    rows = [(p, *r[:3], r[3].split(), r[4]) for p, rs in PLANS.items() for r in rs]
    return spark.createDataFrame(rows, "plan string, task string, agent string, hours double, waits array<string>, priority int")


def workflow_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i, *r) for k, rs in WORKFLOWS.items() for i, r in enumerate(rs)], "kind string, step int, node string, agent string, progress int")


def edges(tasks: DataFrame) -> DataFrame:
    """plan, task, waits_for."""
    return tasks.select("plan", "task", F.explode("waits").alias("waits_for"))


def unresolved(tasks: DataFrame) -> DataFrame:
    """Dependencies that no task of the plan has."""
    e = edges(tasks)
    return e.join(tasks.select("plan", F.col("task").alias("waits_for")), ["plan", "waits_for"], "left_anti")


def layers(tasks: DataFrame) -> DataFrame:
    """plan, task, layer: the longest path from a root. A cycle raises an error."""
    return placed(tasks)


def placed(tasks: DataFrame, *keep: str, ends: bool = False, most: int = MOST) -> DataFrame:
    """plan, task, the columns to keep, layer, and on demand ends: the hours of the longest chain up to the task's end.

    Plans are brought together by one shuffle, unless they are so already, and the settled rows are checkpointed once, however deep the graph is.
    """
    names = list(dict.fromkeys(["plan", "task", *keep, *(["hours"] if ends else [])]))
    kind, w = dict(tasks.dtypes)["task"], W.partitionBy("plan").orderBy("task")
    size = F.when(F.col("plan").isNull(), 0).otherwise(F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rows = tasks.select(*names, F.col("waits").cast(f"array<{kind}>").alias("waits"), F.row_number().over(w).alias("__place"), size.alias("__tasks"))
    schema = ", ".join(f"`{n}` {t}" for n, t in tasks.select(*names).dtypes) + ", layer long" + ", ends double" * ends

    def settle(batches):
        for table in whole_plans(batches, most):
            layer, end = table_layers(table, most, ends)
            out = table.select(names).append_column("layer", pa.array(layer))
            yield from (out.append_column("ends", pa.array(end, mask=np.isneginf(end))) if ends else out).to_batches()

    done = settled(rows.mapInArrow(settle, schema))
    cycles, large = done.agg(F.count_if(F.col("layer") == CYCLE), F.count_if(F.col("layer") == LARGE)).first()
    if cycles:
        raise ValueError("the dependencies have a cycle")
    if large:
        plans = done.filter(F.col("layer") == LARGE).select("plan").distinct()
        rest = settled(tasks.select(*names, "waits").join(plans, "plan", "left_semi"))
        done = done.filter(F.col("layer") != LARGE).unionByName(by_level(rest, ends).select(done.columns))
    return done


def whole_plans(batches, most: int):
    """Tables that no plan crosses, of rows that come by plan; rows of plans too large, or of no plan, as they come."""
    held, n = [], 0
    for batch in batches:
        size = batch["__tasks"].to_numpy(zero_copy_only=False)
        if (other := (size == 0) | (size > most)).any():
            yield pa.Table.from_batches([batch.filter(pa.array(other))])
            batch = batch.filter(pa.array(~other))
        held.append(batch)
        n += batch.num_rows
        first = np.flatnonzero(batch["__place"].to_numpy(zero_copy_only=False) == 1)
        if n >= AT_ONCE and first.size:
            cut = int(first[-1])
            held[-1] = batch.slice(0, cut)
            if n > batch.num_rows - cut:
                yield pa.Table.from_batches(held)
            held, n = [batch.slice(cut)], batch.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def table_layers(table: pa.Table, most: int, ends: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Layer and end of each row. A task that isn't known waits for nothing, and nothing waits for it; of an unknown plan none waits."""
    table, n = table.combine_chunks(), table.num_rows
    hours = pc.fill_null(pc.cast(table["hours"], pa.float64()), -np.inf).to_numpy() if ends else None
    size = table["__tasks"].to_numpy()
    if size[0] == 0 or size[0] > most:
        layer = np.where(size == 0, 0, LARGE)
        return layer, hours
    plan = np.cumsum(table["__place"].to_numpy() == 1)
    task, waits = table["task"].chunk(0), table["waits"].chunk(0)
    child = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(waits), 0).to_numpy(zero_copy_only=False))
    codes = pc.fill_null(pa.concat_arrays([task, waits.flatten()]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    width = codes.max() + 2
    node, of_row = np.unique(plan * width + codes[:n] + 1, return_inverse=True)
    sought = plan[child] * width + codes[n:] + 1
    parent = np.minimum(np.searchsorted(node, sought), node.size - 1)
    known = (node[parent] == sought) & (codes[n:] >= 0) & (codes[:n][child] >= 0)
    of_node = None
    if ends:
        of_node = np.full(node.size, -np.inf)
        np.maximum.at(of_node, of_row, hours)
    layer, before = node_layers(of_row[child[known]], parent[known], node.size, of_node)
    return layer[of_row], before[of_row] + hours if ends else None


def node_layers(child: np.ndarray, parent: np.ndarray, n: int, hours: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Layer of each node, and the hours before it starts. Each level follows the edges of its own nodes alone, so every edge is followed once."""
    open_, order = np.bincount(child, minlength=n), np.argsort(parent, kind="stable")
    child, start = child[order], np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=n))])
    layer, now, k = np.full(n, CYCLE), np.flatnonzero(open_ == 0), 0
    before = None if hours is None else np.where(open_ == 0, 0.0, -np.inf)
    while now.size:
        layer[now] = k
        count = start[now + 1] - start[now]
        after = child[np.repeat(start[now] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        if hours is not None:
            np.maximum.at(before, after, np.repeat(before[now] + hours[now], count))
        np.subtract.at(open_, after, 1)
        now, k = np.unique(after[open_[after] == 0]), k + 1
    return layer, before


def by_level(tasks: DataFrame, ends: bool = False) -> DataFrame:
    """The tasks with layer and ends: each round settles those whose dependencies are all settled; the settled set is checkpointed, so the plan stays short."""
    e = edges(tasks)
    e = settled(e.join(tasks.select("plan", F.col("task").alias("waits_for")), ["plan", "waits_for"], "left_semi"))
    done = tasks.join(e, ["plan", "task"], "left_anti").withColumn("layer", F.lit(0).cast("long"))
    done = settled(done.withColumn("ends", F.col("hours").cast("double")) if ends else done)
    todo, total, n, k = tasks.dropna(subset=["task"]), tasks.count(), -1, 0
    while (now := done.count()) < total:
        if now == n:
            raise ValueError("the dependencies have a cycle")
        n, k = now, k + 1
        left = todo.join(done, ["plan", "task"], "left_anti")
        waiting = e.join(done.select("plan", F.col("task").alias("waits_for")), ["plan", "waits_for"], "left_anti").select("plan", "task").distinct()
        new = left.join(waiting, ["plan", "task"], "left_anti").withColumn("layer", F.lit(k).cast("long"))
        if ends:
            before = e.join(done.select("plan", F.col("task").alias("waits_for"), F.col("ends").alias("b")), ["plan", "waits_for"]).groupBy("plan", "task").agg(F.max("b").alias("b"))
            new = new.join(before, ["plan", "task"]).withColumn("ends", F.col("b") + F.col("hours")).drop("b")
        done = settled(done.unionByName(new))
    return done


def settled(df: DataFrame) -> DataFrame:
    """Cut off from its lineage through the shared checkpoint folder."""
    from loomgrid.sources.shared import checkpointed

    return checkpointed(df)


def roots(tasks: DataFrame) -> DataFrame:
    """n_roots, whether they form a parallel group, and the sum of their hours, by plan."""
    first = F.size("waits") == 0
    return tasks.groupBy("plan").agg(F.count_if(first).alias("n_roots"), (F.count_if(first) > 1).alias("parallel"), F.sum(F.when(first, F.col("hours"))).alias("root_hours"))


def critical_path(tasks: DataFrame) -> DataFrame:
    """plan, hours of its longest chain, and what it saves over one task after another."""
    plans = placed(tasks, ends=True).dropna(subset=["plan"]).groupBy("plan").agg(F.max("ends").alias("hours"), F.sum("hours").alias("total"))
    return plans.select("plan", "hours", (F.col("total") - F.col("hours")).alias("saved"))


def start_and_stop(tasks: DataFrame) -> DataFrame:
    """plan, task and its places among starts and stops: by layer, priority and name, and the other way round."""
    w = W.partitionBy("plan")
    rows = placed(tasks, "priority").dropna(subset=["plan", "task"])
    place = lambda *by: F.row_number().over(w.orderBy(*by)).cast("long")
    return rows.select("plan", "task", place("layer", "priority", "task").alias("start_order"), place(F.desc("layer"), F.desc("priority"), F.desc("task")).alias("stop_order"))


def simulated(tasks: DataFrame) -> DataFrame:
    """plan, task, ends: hours from the plan's start when tasks run one after another in order of layer, priority and name."""
    rows = placed(tasks, "priority", "hours").dropna(subset=["plan", "task"])
    return rows.select("plan", "task", F.round(F.sum("hours").over(W.partitionBy("plan").orderBy("layer", "priority", "task")), 6).alias("ends"))
