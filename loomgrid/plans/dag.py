"""Plans and workflows as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgrid.operators import dag as D
from loomgrid.plans.registry import Tables, query

PLANS = "p(plan, task, agent, hours, waits, priority) as (values " + ", ".join(f"('{p}', '{a}', '{b}', {c}::double, {d.split()}::varchar[], {e})" for p, rs in D.PLANS.items() for a, b, c, d, e in rs) + ")"
EDGES = f"{PLANS}, e as (select plan, task, unnest(waits) as waits_for from p)"
LAYERS = f"{EDGES}, r as (select plan, task, 0 as layer from p where len(waits) = 0 union all select e.plan, e.task, r.layer + 1 from r join e on e.plan = r.plan and e.waits_for = r.task), l as (select plan, task, cast(max(layer) as bigint) as layer from r group by 1, 2)"
FLOWS = "w(kind, step, node, agent, progress) as (values " + ", ".join(f"('{k}', {i}, '{a}', '{b}', {c})" for k, rs in D.WORKFLOWS.items() for i, (a, b, c) in enumerate(rs)) + ")"


@query("g06_plan_templates", "G-06", f"with {PLANS} select plan, task, agent, hours, len(waits) as n_waits, cast(priority as bigint) as priority from p")
def plan_templates(t: Tables) -> DataFrame:
    return D.plan_table(t.spark).select("plan", "task", "agent", "hours", F.size("waits").cast("long").alias("n_waits"), F.col("priority").cast("long").alias("priority"))


@query("g03_edges", "G-03", f"with {EDGES} select * from e")
def edges(t: Tables) -> DataFrame:
    return D.edges(D.plan_table(t.spark))


@query("g01_layers", "G-01 J-13 C-13", f"with recursive {LAYERS} select * from l")
def layers(t: Tables) -> DataFrame:
    return D.layers(D.plan_table(t.spark))


@query("g02_priority_order", "G-02 O-07 O-13 G-15 C-19", f"with recursive {LAYERS} select plan, task, cast(row_number() over (partition by plan order by layer, priority, task) as bigint) as start_order, cast(row_number() over (partition by plan order by layer desc, priority desc, task desc) as bigint) as stop_order from l join p using (plan, task)")
def priority_order(t: Tables) -> DataFrame:
    return D.start_and_stop(D.plan_table(t.spark))


@query("u04_unresolved", "U-04 J-07", f"with {EDGES}, x as (select plan, task, waits_for from e union all select plan, task, 'nowhere' from p where priority = 2) select plan, task, waits_for from x where not exists (select 1 from p where p.plan = x.plan and p.task = x.waits_for)")
def unresolved(t: Tables) -> DataFrame:
    p = D.plan_table(t.spark)
    return D.unresolved(p.withColumn("waits", F.when(F.col("priority") == 2, F.array_append("waits", F.lit("nowhere"))).otherwise(F.col("waits")))).select("plan", "task", "waits_for")


@query("g04_roots", "G-04 G-05", f"with {PLANS} select plan, count(*) filter (where len(waits) = 0) as n_roots, count(*) filter (where len(waits) = 0) > 1 as parallel, sum(hours) filter (where len(waits) = 0) as root_hours from p group by 1")
def roots(t: Tables) -> DataFrame:
    return D.roots(D.plan_table(t.spark))


@query("g05_critical_path", "G-05 C-14 A-26", f"with recursive {EDGES}, r as (select plan, task, hours as ends from p where len(waits) = 0 union all select e.plan, e.task, r.ends + p.hours from r join e on e.plan = r.plan and e.waits_for = r.task join p on p.plan = e.plan and p.task = e.task) select plan, max(ends) as hours, (select sum(hours) from p where p.plan = r.plan) - max(ends) as saved from r group by 1")
def critical_path(t: Tables) -> DataFrame:
    return D.critical_path(D.plan_table(t.spark))


@query("g09_simulated_run", "G-09", f"with recursive {LAYERS} select plan, task, round(sum(hours) over (partition by plan order by layer, priority, task), 6) as ends from l join p using (plan, task)")
def simulated_run(t: Tables) -> DataFrame:
    return D.simulated(D.plan_table(t.spark))


@query("g10_workflow_walk", "G-10 G-11 T-12 C-17", f"with {FLOWS} select kind, node, agent, cast(progress as bigint) as progress, lead(node) over (partition by kind order by step) as next from w")
def workflow_walk(t: Tables) -> DataFrame:
    w = W.partitionBy("kind").orderBy("step")
    return D.workflow_table(t.spark).select("kind", "node", "agent", F.col("progress").cast("long").alias("progress"), F.lead("node").over(w).alias("next"))


@query("g12_workflow_status", "G-12 T-12 G-11", f"""with {FLOWS}, o as (select o_orderkey, case o_orderkey % 5 when 0 then 'feature' when 1 then 'bug_fix' when 2 then 'documentation' when 3 then 'code_review' else 'feature' end as kind, o_orderkey // 5 % 4 as place from orders)
select o_orderkey, kind, node, cast(progress as bigint) as progress, progress = 100 as completed from o join w using (kind) where step = least(place, case kind when 'feature' then 5 when 'bug_fix' then 4 when 'documentation' then 2 else 1 end)""")
def workflow_status(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("feature", "bugfix", "documentation", "code_review", "unheard_of"))), (k % 5 + 1).cast("int"))
    kind = F.when(kind == "bugfix", "bug_fix").when(kind.isin(*D.WORKFLOWS), kind).otherwise("feature")
    last = F.element_at(F.create_map(*[F.lit(x) for a, b in D.WORKFLOWS.items() for x in (a, len(b) - 1)]), F.col("kind"))
    o = t.orders.select("o_orderkey", kind.alias("kind"), (F.floor(k / 5) % 4).alias("at")).withColumn("step", F.least("at", last).cast("int"))
    return o.join(D.workflow_table(t.spark), ["kind", "step"]).select("o_orderkey", "kind", "node", F.col("progress").cast("long").alias("progress"), (F.col("progress") == 100).alias("completed"))


# An order is a plan and its line numbers are tasks, each of which waits for the line before it by one, and by half its number where that line is part of the order.
LINES = """p as (select l_orderkey as plan, l_linenumber as task, sum(l_quantity) as hours, count(*) as priority from lineitem group by 1, 2),
x as (select plan, task, unnest(case when task % 2 = 0 then [task - 1, task // 2] else [task - 2] end) as waits_for from p),
e as (select distinct x.plan, x.task, x.waits_for from x join p on p.plan = x.plan and p.task = x.waits_for),
r as (select plan, task, 0 as layer from p where not exists (select 1 from e where e.plan = p.plan and e.task = p.task) union all select e.plan, e.task, r.layer + 1 from r join e on e.plan = r.plan and e.waits_for = r.task),
l as (select plan, task, cast(max(layer) as bigint) as layer from r group by 1, 2)"""


def lines(t: Tables) -> DataFrame:
    n = F.col("task")
    p = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("task")).agg(F.sum("l_quantity").alias("hours"), F.count(F.lit(1)).alias("priority"))
    return p.withColumn("waits", F.when(n % 2 == 0, F.array_distinct(F.array(n - 1, F.floor(n / 2).cast("int")))).otherwise(F.array(n - 2)))


def known(tasks: DataFrame) -> DataFrame:
    """Tasks that wait for tasks of their plan alone."""
    has = tasks.groupBy("plan").agg(F.collect_set("task").alias("__has"))
    return tasks.join(has, "plan").withColumn("waits", F.array_intersect("waits", "__has")).drop("__has")


@query("g03_line_edges", "G-03", f"with recursive {LINES} select plan, task, waits_for from e")
def line_edges(t: Tables) -> DataFrame:
    return D.edges(known(lines(t)))


@query("g01_line_layers", "G-01 J-13", f"with recursive {LINES} select plan, task, layer from l")
def line_layers(t: Tables) -> DataFrame:
    return D.layers(lines(t))


@query("g02_line_order", "G-02 O-07 O-13 G-15", f"with recursive {LINES} select plan, task, cast(row_number() over (partition by plan order by layer, priority, task) as bigint) as start_order, cast(row_number() over (partition by plan order by layer desc, priority desc, task desc) as bigint) as stop_order from l join p using (plan, task)")
def line_order(t: Tables) -> DataFrame:
    return D.start_and_stop(lines(t))


@query("g05_line_critical_path", "G-05 A-26", f"with recursive {LINES}, c as (select plan, task, hours as ends from p where not exists (select 1 from e where e.plan = p.plan and e.task = p.task) union all select e.plan, e.task, c.ends + p.hours from c join e on e.plan = c.plan and e.waits_for = c.task join p on p.plan = e.plan and p.task = e.task), s as (select plan, sum(hours) as total from p group by 1) select plan, round(max(ends), 6) as hours, round(any_value(total) - max(ends), 6) as saved from c join s using (plan) group by 1")
def line_critical_path(t: Tables) -> DataFrame:
    return D.critical_path(lines(t)).select("plan", F.round("hours", 6).alias("hours"), F.round("saved", 6).alias("saved"))


@query("g09_line_run", "G-09", f"with recursive {LINES} select plan, task, round(sum(hours) over (partition by plan order by layer, priority, task), 6) as ends from l join p using (plan, task)")
def line_run(t: Tables) -> DataFrame:
    return D.simulated(lines(t))


@query("u04_line_unresolved", "U-04 J-07", f"with recursive {LINES} select distinct x.plan, x.task, x.waits_for from x where not exists (select 1 from p where p.plan = x.plan and p.task = x.waits_for)")
def line_unresolved(t: Tables) -> DataFrame:
    return D.unresolved(lines(t)).select("plan", "task", "waits_for")
