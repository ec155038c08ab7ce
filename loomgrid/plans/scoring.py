"""Tasks: a document is a task's description, its lines' first words the requirements; orders are submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import scoring as S
from loomgrid.plans.registry import Tables, query

KINDS = ["feature", "bugfix", "documentation", "code_review", "refactor", "other"]
WORDS = ["API integration", "legacy database", "third-party service", "UI interface", "security audit", "performance test", "data migration", "authentication", "docker deployment", "react css html"]


def pick(names: list[str], i):
    return F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))


def tasks(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    wanted = F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), lambda i: pick(WORDS, k + i * i))
    return t.orders.select("o_orderkey", F.concat(F.lit("Build "), pick(WORDS, k), F.lit(" with "), pick(WORDS, F.floor(k / 10))).alias("description"), wanted.alias("requirements"), pick(KINDS, k).alias("task_type"))


def sql_pick(names: list[str], i: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + f"][cast(({i}) % {len(names)} + 1 as int)]"


TASKS = f"t as (select o_orderkey, 'Build ' || {sql_pick(WORDS, 'o_orderkey')} || ' with ' || {sql_pick(WORDS, 'o_orderkey // 10')} as description, list_transform(range(1, o_orderkey % 5 + 2), lambda i: {sql_pick(WORDS, 'o_orderkey + i * i')}) as requirements, {sql_pick(KINDS, 'o_orderkey')} as task_type from orders)"
# The counterpart's constants are written out here, so that a wrong one in the operators shows.
LOC = "case when contains(d, 'auth') then 500 else 0 end + case when contains(d, 'db') or contains(d, 'database') then 300 else 0 end + case when contains(d, 'api') then 200 else 0 end + case when contains(d, 'ui') or contains(d, 'interface') then 400 else 0 end"
OUT = "cast(list_sum(list_transform(requirements, lambda r: " + " + ".join(f"cast(contains(lower(r), '{w}') as int)" for w in ("api", "service", "external", "integration", "third-party")) + ")) as bigint)"
SKILL = " || ".join(
    f"list_filter({v}, lambda x: contains(full_text, x))[1:2]"
    for v in (
        "['authentication', 'encryption', 'security']",
        "['css', 'html', 'javascript', 'react', 'vue']",
        "['ci/cd', 'deployment', 'docker', 'kubernetes']",
        "['api', 'database', 'java', 'node', 'python']",
        "['qa', 'quality', 'test', 'validation']",
    )
)
RISK = """list_filter([case when contains(full_text, 'security') then 'Security implementation required' end, case when contains(full_text, 'performance') then 'Performance optimization needed' end,
case when contains(full_text, 'scalability') then 'Scalability considerations' end, case when contains(full_text, 'legacy') then 'Legacy system integration' end, case when contains(full_text, 'data migration') then 'Data migration required' end], lambda x: x is not null)"""
SCORED = f"""{TASKS}, f as (select *, lower(description) as d, lower(description) || ' ' || lower(array_to_string(requirements, ' ')) as full_text from t),
g as (select *, cast({LOC} as bigint) as loc, cast(greatest(1, len(requirements)) as bigint) as components, {OUT} as outside, array_to_string({RISK}, ';') as risks, cast(len(list_distinct({SKILL})) as bigint) as n_skills from f),
h as (select *, cast(case task_type when 'refactor' then 6 when 'feature' then 8 when 'documentation' then 2 when 'code_review' then 1 else 4 end as double) * (1 + loc / 5000.0::double + outside * 0.2::double) as hours from g),
c as (select *, case when hours <= 6 and components <= 1 and n_skills <= 2 then 'simple' when hours <= 20 and components <= 3 and n_skills <= 4 then 'moderate' when hours <= 50 and components <= 8 and n_skills <= 6 then 'complex' else 'enterprise' end as complexity from h),
s as (select *, case when complexity = 'simple' or complexity = 'moderate' and components <= 1 then 'sequential' when complexity = 'moderate' then 'pipeline' when complexity = 'complex' and outside > 0 then 'fan_out_in' when complexity = 'complex' then 'parallel' else 'conditional' end as pattern from c)"""


@query("j09_task_scores", "J-09 J-10 J-11 A-21 F-37 F-38 F-39 U-03", f"with {SCORED} select o_orderkey, loc, components, outside, risks, n_skills, round(hours, 6) as hours, complexity, pattern from s")
def task_scores(t: Tables) -> DataFrame:
    return S.scored(tasks(t)).select("o_orderkey", "loc", "components", "outside", F.array_join("risks", ";").alias("risks"), "n_skills", F.round("hours", 6).alias("hours"), "complexity", "pattern")


@query("g08_pattern_counts", "G-08 A-30", f"with {SCORED} select complexity, pattern, count(*) as n, round(sum(hours), 4) as hours from s group by 1, 2")
def pattern_counts(t: Tables) -> DataFrame:
    return S.scored(tasks(t)).groupBy("complexity", "pattern").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("hours"), 4).alias("hours"))


@query("f35_priorities", "F-35 F-36", "select o_orderkey, cast(case o_orderkey % 6 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 5 else 2 end as bigint) as priority, case when o_orderkey % 3 = 0 then 'title' when o_orderkey % 5 = 0 then 'submitter' end as missing from orders")
def priorities(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    title, submitter = F.when(k % 3 != 0, "t"), F.when(k % 5 != 0, "s")
    return t.orders.select("o_orderkey", S.priority(pick(["Low", "MEDIUM", "high", "Urgent", "critical", "whenever"], k)).alias("priority"), F.when(title.isNull(), "title").when(submitter.isNull(), "submitter").alias("missing"))


@query("f41_recovery", "F-41 G-13 F-42", """select event_id, case when e = 'agent_timeout' and r < 3 then 'retry_with_backoff' when e in ('agent_timeout', 'agent_failure') then 'fallback_agent' when e = 'resource_unavailable' then 'wait_and_retry' else 'escalate_to_human' end as strategy,
round(pow(case e when 'agent_timeout' then 2.0 when 'agent_failure' then 1.5 when 'resource_unavailable' then 1.2 else 1.0 end, r), 6) as delay from (select event_id, ['agent_timeout', 'agent_failure', 'resource_unavailable', 'quality_gate_failure', 'strange'][cast(event_id % 5 + 1 as int)] as e, event_id // 5 % 5 as r from events)""")
def recovery(t: Tables) -> DataFrame:
    e, r = pick(["agent_timeout", "agent_failure", "resource_unavailable", "quality_gate_failure", "strange"], F.col("event_id")), F.floor(F.col("event_id") / 5) % 5
    return t.events.select("event_id", S.recovery(e, r).alias("strategy"), F.round(S.back_off_of(e, r), 6).alias("delay"))


@query("f45_derived_quality", "F-45 F-46", """select o_orderkey, q as quality, round(q * case when ok then 0.9::double else 0.6::double end, 6) as satisfaction, case kind when 'feature' then 'developer_1' when 'bugfix' then 'developer_1' when 'documentation' then 'documentation_agent' when 'code_review' then 'code_reviewer' else 'project_manager' end as agent
from (select o_orderkey, o_orderstatus = 'F' as ok, least(100.0::double, case when o_orderstatus = 'F' then 85.0 else 30.0 end + (o_orderkey % 6) * 5.0)::double as q, """ + sql_pick(KINDS, "o_orderkey") + " as kind from orders)")
def derived_quality(t: Tables) -> DataFrame:
    ok = F.col("o_orderstatus") == "F"
    q = S.quality(ok, F.col("o_orderkey") % 6)
    return t.orders.select("o_orderkey", q.alias("quality"), F.round(S.satisfaction(ok, q), 6).alias("satisfaction"), S.primary_agent(pick(KINDS, F.col("o_orderkey"))).alias("agent"))


@query("a15_overload", "A-15 W-10 A-22", "with l as (select l_suppkey, round(sum(l_quantity), 6) as load from lineitem group by 1) select l_suppkey, load, load > (select avg(load) from l) * 1.5 as overloaded from l")
def overload(t: Tables) -> DataFrame:
    return S.overloaded(t.lineitem, "l_suppkey", "l_quantity")


@query("j12_best_agent", "J-12 F-40 G-07 P-23 D-08 A-22", """with l as (select l_suppkey, count(*) as load from lineitem group by 1), a as (select s_suppkey, s_nationkey, s_acctbal / (1 + coalesce(load, 0)) as score from supplier left join l on l_suppkey = s_suppkey where s_acctbal > 0),
b as (select s_nationkey, arg_max(s_suppkey, (score, -s_suppkey)) as agent, round(max(score), 6) as score from a group by 1) select n_name, agent, score from nation join b on n_nationkey = s_nationkey""")
def best_agent(t: Tables) -> DataFrame:
    load = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("load"))
    s = t.supplier.join(load, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    agents = s.select(F.col("s_nationkey").alias("agent_type"), F.col("s_suppkey").alias("agent"), F.coalesce("load", F.lit(0)).alias("load"), F.col("s_acctbal").alias("performance"), (F.col("s_acctbal") > 0).alias("enabled"), F.col("s_suppkey").alias("rank"))
    return S.best_agents(t.nation.select("n_name", F.col("n_nationkey").alias("agent_type")), agents).select("n_name", "agent", F.round("score", 6).alias("score"))


@query("a17_team_status", "A-17 A-18 P-21 D-13", """select count(*) filter (where o_orderstatus = 'P') as active, count(*) filter (where o_orderstatus = 'O') as queued, count(*) filter (where o_orderstatus = 'F') as completed, count(*) as total, round(count(*) filter (where o_orderstatus not in ('F', 'C')) / cast(greatest(5, 1) as double), 6) as system_load from orders""")
def team_status(t: Tables) -> DataFrame:
    of = lambda x: F.count_if(F.col("o_orderstatus") == x)
    live = F.count_if(~F.col("o_orderstatus").isin("F", "C"))
    return t.orders.agg(of("P").alias("active"), of("O").alias("queued"), of("F").alias("completed"), F.count(F.lit(1)).alias("total"), F.round(live / F.greatest(F.lit(5), F.lit(1)), 6).alias("system_load"))


@query("j05_task_progress", "J-05 J-06 A-28", """with p as (select l_orderkey, round(sum(l_quantity), 6) as done, arg_max(l_linestatus, (l_linenumber, l_linestatus)) as phase from lineitem where l_returnflag = 'R' group by 1)
select o_orderkey, coalesce(done, 0.0) as progress, coalesce(phase, 'unknown') as phase from orders left join p on l_orderkey = o_orderkey where o_orderstatus <> 'F'""")
def task_progress(t: Tables) -> DataFrame:
    p = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 6).alias("done"), F.max_by("l_linestatus", F.struct("l_linenumber", "l_linestatus")).alias("phase"))
    o = t.orders.filter("o_orderstatus <> 'F'")
    return o.join(p, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("done", F.lit(0.0)).alias("progress"), F.coalesce("phase", F.lit("unknown")).alias("phase"))


@query("o11_admission", "O-11 C-27 A-17", "with q as (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n, o_custkey from orders where o_orderstatus = 'O'), r as (select o_custkey, count(*) as running from orders where o_orderstatus = 'P' group by 1) select o_orderkey from q left join r using (o_custkey) where n <= 5 - coalesce(running, 0)")
def admission(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    running = t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("running"))
    queued = t.orders.filter("o_orderstatus = 'O'").withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).filter("n <= 5")
    return queued.join(running, "o_custkey", "left").filter("n <= 5 - coalesce(running, 0)").select("o_orderkey")


SPEC = """v(place, kind, template, before, after, step) as (values (0, 'tone_adjustment', 'professional', '', '', 'formal'), (1, 'tone_adjustment', 'friendly', '', 'Always maintain a friendly and approachable tone in your interactions.', ''),
(2, 'tone_adjustment', 'direct', 'Be direct and concise in all responses.', '', ''), (3, 'tone_adjustment', 'encouraging', '', 'Provide encouraging feedback and support to team members.', ''),
(4, 'structure_modification', 'steps', '', '', 'steps'), (5, 'structure_modification', 'bullets', '', '', 'bullets'), (6, 'structure_modification', 'sections', '', '', ''), (7, 'structure_modification', 'examples', '', '', ''),
(8, 'detail_level_change', 'more', '', 'Provide detailed explanations and comprehensive analysis in all responses.', ''), (9, 'detail_level_change', 'less', 'Be concise and focus on key points.', '', ''), (10, 'detail_level_change', 'technical', '', '', ''), (11, 'detail_level_change', 'edge_cases', '', '', ''),
(12, 'instruction_clarity', 'explicit', '', 'Be explicit about requirements and provide specific, actionable guidance.', ''), (13, 'instruction_clarity', 'outputs', '', '', ''), (14, 'instruction_clarity', 'validation', '', '', ''), (15, 'instruction_clarity', 'format', '', '', ''),
(16, 'context_enhancement', 'goals', 'Consider the overall project context and goals when completing tasks.', '', ''), (17, 'context_enhancement', 'team', '', '', ''), (18, 'context_enhancement', 'stack', '', '', ''), (19, 'context_enhancement', 'users', '', '', ''),
(20, 'specialization_focus', 'expertise', '', '', 'focus'), (21, 'specialization_focus', 'practices', '', '', 'focus'), (22, 'specialization_focus', 'standards', '', '', 'focus'), (23, 'specialization_focus', 'tools', '', '', 'focus'))"""
AGENTS = ["developer", "code_reviewer", "architect", "project_manager", "qa_agent", "documentation_agent", "team_lead"]


@query("f47_prompt_variations", "F-47 D-14 F-49", f"""with {SPEC}, n as (select n_name, 'You serve ' || n_name || ' in a friendly, casual way. Be brief. Be kind.' as p, {sql_pick(AGENTS, "n_nationkey")} as agent from nation)
select n_name, agent, cast(place as bigint) as place, kind, template, case when before = '' then '' else before || chr(10) || chr(10) end || case step when 'formal' then replace(replace(p, 'friendly', 'professional'), 'casual', 'formal')
when 'steps' then 'Follow these numbered steps:' || chr(10) || '1. ' || replace(p, '. ', '.' || chr(10) || '2. ') when 'bullets' then 'Key responsibilities:' || chr(10) || '• ' || replace(p, '. ', '.' || chr(10) || '• ')
when 'focus' then 'Focus on ' || case agent when 'developer' then 'coding best practices and software engineering' when 'code_reviewer' then 'code quality and security standards' when 'architect' then 'system design and architectural patterns' when 'project_manager' then 'project management and team coordination'
when 'qa_agent' then 'testing methodologies and quality assurance' when 'documentation_agent' then 'technical writing and documentation standards' else 'general expertise' end || ' in your responses.' || chr(10) || chr(10) || p else p end || case when after = '' then '' else chr(10) || chr(10) || after end as prompt from v, n""")
def prompt_variations(t: Tables) -> DataFrame:
    v = t.spark.createDataFrame(S.variations(24), S.VARIATION_SCHEMA)
    p = t.nation.select("n_name", pick(AGENTS, F.col("n_nationkey")).alias("agent"), F.concat(F.lit("You serve "), "n_name", F.lit(" in a friendly, casual way. Be brief. Be kind.")).alias("p"))
    return p.crossJoin(v).select("n_name", "agent", F.col("place").cast("long").alias("place"), "kind", "template", S.varied(F.col("p"), F.col("agent"), F.col("step"), F.col("before"), F.col("after")).alias("prompt"))


@query("o12_variation_order", "O-12", f"with {SPEC}, n as (select unnest([1, 3, 4, 5, 6]) as wanted) select cast(wanted as bigint) as wanted, cast(row_number() over (partition by wanted order by place) as bigint) as place, kind, template from v, n where place % 4 < wanted qualify row_number() over (partition by wanted order by place) <= wanted")
def variation_order(t: Tables) -> DataFrame:
    rows = [(n, r[0] + 1, r[1], r[2]) for n in (1, 3, 4, 5, 6) for r in S.variations(n)]
    return t.spark.createDataFrame(rows, "wanted long, place long, kind string, template string")


@query("w09_phase_progress", "W-09 G-14", "select l_orderkey, l_linenumber, round(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) / cast(count(*) over (partition by l_orderkey) as double) * 100, 6) as progress from lineitem")
def phase_progress(t: Tables) -> DataFrame:
    l = t.lineitem.withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return S.phases_progress(l, "l_orderkey", "o").select("l_orderkey", "l_linenumber", "progress")
