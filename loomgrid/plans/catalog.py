"""The parts as a catalog of tools: id = key, name, category = brand, tags = words of name and type, use = their line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgrid.operators import catalog as C
from loomgrid.plans.registry import Tables, query

SQL = """tools as (select cast(p_partkey as varchar) as tool_id, p_name as name, cast(p_size as varchar) as version, case when p_size % 7 = 0 then 'deprecated' when p_size % 2 = 0 then 'active' else 'inactive' end as status,
p_brand as category, p_type || ' ' || p_name as description, p_type as brief_description, list_value(lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) as tags, p_partkey as seq,
coalesce(usage_count, 0) as usage_count, registered_at, last_used from part left join (select l_partkey, count(*) as usage_count, min(l_shipdate) as registered_at, max(l_shipdate) as last_used from lineitem group by 1) on l_partkey = p_partkey)"""


def tools(t: Tables) -> DataFrame:
    use = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("usage_count"), F.min("l_shipdate").alias("registered_at"), F.max("l_shipdate").alias("last_used"))
    p, size = t.part, F.col("p_size")
    status = F.when(size % 7 == 0, "deprecated").when(size % 2 == 0, "active").otherwise("inactive")
    words = F.split("p_name", " ")
    rows = p.join(use, p.p_partkey == use.l_partkey, "left")
    return rows.select(F.col("p_partkey").cast("string").alias("tool_id"), F.col("p_name").alias("name"), size.cast("string").alias("version"), status.alias("status"), F.col("p_brand").alias("category"), F.concat_ws(" ", "p_type", "p_name").alias("description"), F.col("p_type").alias("brief_description"), F.array(F.lower("p_type"), words[0], words[1]).alias("tags"), F.col("p_partkey").alias("seq"), F.coalesce("usage_count", F.lit(0).cast("long")).alias("usage_count"), "registered_at", "last_used")


@query("a23_usage", "A-23 A-24", f"with {SQL} select tool_id, usage_count, last_used from tools")
def usage(t: Tables) -> DataFrame:
    return tools(t).select("tool_id", "usage_count", "last_used")


@query("p15_registry_list", "P-10 P-12 P-13 P-14 P-15 O-02 U-06", f"with {SQL} select tool_id, name, version from tools where status = 'active' and list_contains(tags, 'small') and name glob '*g*'")
def registry_list(t: Tables) -> DataFrame:
    return C.list_where(tools(t), status="active", tags=["small"], pattern="*g*").select("tool_id", "name", "version")


@query("p09_keyword_search", "P-09 P-10 P-11 O-03 P-27 A-19", f"with {SQL}, f as (select * from tools where (contains(lower(name), 'bolt') or contains(lower(description), 'bolt')) and lower(category) in ('brand#4') and (list_contains(tags, 'blue') or list_contains(tags, 'red')) order by name, version, seq limit 20) select tool_id as name, category, version from f")
def keyword_search(t: Tables) -> DataFrame:
    found = C.search(tools(t), "BOLT", category="BRAND#4", tags=["Blue", "RED"], ties=("seq",))
    return found.select(F.col("tool_id").alias("name"), "category", "version")


@query("o03_search_relevance", "O-03 C-10", f"""with {SQL}, f as (select * from tools where contains(lower(name), 'ring') or contains(lower(description), 'ring') or list_contains(list_transform(tags, lambda x: contains(x, 'ring')), true)),
l as (select * from f order by name, seq limit 25) select tool_id, cast(row_number() over (order by not contains(name, 'ring'), name, seq) as bigint) as place, (select count(*) from f) as found from l""")
def search_relevance(t: Tables) -> DataFrame:
    found = tools(t).filter(C.keyword(" Ring "))
    some = found.orderBy("name", "seq").limit(25)
    return some.withColumn("place", F.row_number().over(W.orderBy(~F.contains("name", F.lit("ring")), "name", "seq")).cast("long")).select("tool_id", "place").crossJoin(found.agg(F.count(F.lit(1)).alias("found")))


@query("w04_latest_registration", "W-04", f"with {SQL} select name, tool_id from (select *, row_number() over (partition by name order by registered_at desc nulls last, seq) as n from tools) where n = 1")
def latest(t: Tables) -> DataFrame:
    return C.latest(tools(t)).select("name", "tool_id")


@query("j01_resolve_identifier", "J-01 J-15", f"""with {SQL}, a as (select 'alias-' || seq as alias, tool_id from tools), n as (select name, tool_id from (select *, row_number() over (partition by name order by registered_at desc nulls last, seq) as n from tools) where n = 1),
w as (select unnest(['5', 'alias-20', 'red plate', 'nothing', 'alias-21']) as identifier) select identifier, coalesce(t.tool_id, a.tool_id, n.tool_id) as tool_id from w left join tools t on t.tool_id = identifier left join a on alias = identifier left join n on n.name = identifier""")
def resolve(t: Tables) -> DataFrame:
    every = tools(t)
    aliases = every.select(F.concat(F.lit("alias-"), F.col("tool_id")).alias("alias"), "tool_id")
    wanted = t.spark.createDataFrame([(x,) for x in ("5", "alias-20", "red plate", "nothing", "alias-21")], "identifier string")
    return C.resolve(wanted, every, aliases)


@query("j02_name_version", "J-02 D-01", f"with {SQL} select a.tool_id, count(*) as same from tools a join tools b on a.name = b.name and a.version = b.version group by 1")
def name_version(t: Tables) -> DataFrame:
    a = tools(t)
    n = a.groupBy("name", "version").agg(F.count(F.lit(1)).alias("same"))  # a self-join on the key is a count by the key
    return a.join(n, ["name", "version"]).select("tool_id", "same")


@query("j03_tag_index", "J-03 U-11", f"with {SQL} select distinct unnest(tags) as tag, tool_id from tools")
def tag_index(t: Tables) -> DataFrame:
    return C.tag_index(tools(t)).select("tag", "tool_id")


@query("a08_registry_stats", "A-08 A-09", f"""with {SQL} select 'total' as kind, '' as key, count(*) as n from tools union all select 'status', status, count(*) from tools group by 2 union all select 'category', category, count(*) from tools group by 2
union all select 'tag', tag, count(*) from (select distinct unnest(tags) as tag, tool_id from tools) group by 2""")
def registry_stats(t: Tables) -> DataFrame:
    return C.group_counts(tools(t))


@query("o04_most_used", "O-04", f"with {SQL} select tool_id, usage_count from tools order by usage_count desc, seq limit 10")
def most_used(t: Tables) -> DataFrame:
    return tools(t).orderBy(F.desc("usage_count"), "seq").limit(10).select("tool_id", "usage_count")


@query("o05_most_recent", "O-05", f"with {SQL} select tool_id, registered_at from tools order by registered_at desc nulls last, seq limit 10")
def most_recent(t: Tables) -> DataFrame:
    return tools(t).orderBy(F.desc_nulls_last("registered_at"), "seq").limit(10).select("tool_id", "registered_at")


@query("u03_tag_sets", "U-03 U-05 U-06 U-11 P-24", f"""with {SQL} select tool_id, array_to_string(list_sort(list_distinct(list_concat(tags, ['red', 'steel']))), ',') as either, array_to_string(list_sort(list_intersect(tags, ['red', 'ring', 'small'])), ',') as both,
list_has_any(tags, ['red', 'ring']) as overlaps, array_to_string(list_sort(list_filter(tags, lambda x: x <> 'red')), ',') as without from tools""")
def tag_sets(t: Tables) -> DataFrame:
    lit = lambda *x: F.array(*map(F.lit, x))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return tools(t).select("tool_id", text(F.array_union("tags", lit("red", "steel"))).alias("either"), text(F.array_intersect("tags", lit("red", "ring", "small"))).alias("both"), F.arrays_overlap("tags", lit("red", "ring")).alias("overlaps"), text(F.array_remove("tags", "red")).alias("without"))


@query("u10_header_merge", "U-09 U-10 F-29", """select doc_id, lang as accept, case when doc_id % 2 = 0 then source else 'default' end as agent, coalesce(case when doc_id % 3 = 0 then 'x' end, 'none') as trace from documents""")
def header_merge(t: Tables) -> DataFrame:
    base = F.create_map(F.lit("agent"), F.lit("default"), F.lit("accept"), F.lit("any"))
    own = F.map_filter(F.create_map(F.lit("accept"), F.col("lang"), F.lit("agent"), F.when(F.col("doc_id") % 2 == 0, F.col("source"))), lambda k, v: v.isNotNull())
    merged = F.map_from_entries(F.concat(F.map_entries(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k))), F.map_entries(own)))  # the right side wins, whatever the policy for equal keys
    body = F.to_json(F.struct(F.struct(F.when(F.col("doc_id") % 3 == 0, "x").alias("trace")).alias("h")))
    d = t.documents.select("doc_id", merged.alias("m"), body.alias("b"))
    return d.select("doc_id", F.col("m")["accept"].alias("accept"), F.col("m")["agent"].alias("agent"), F.coalesce(F.get_json_object("b", "$.h.trace"), F.lit("none")).alias("trace"))


@query("s18_upsert", "S-18 J-14 D-02 D-03", """with new as (select s_name, s_nationkey + 100 as s_nationkey from supplier where s_acctbal < 1000 union all select 'new-' || n_name, n_nationkey from nation)
select s_name, s_nationkey from supplier s where not exists (select 1 from new where new.s_name = s.s_name) union all select * from new""")
def upsert(t: Tables) -> DataFrame:
    new = t.supplier.filter("s_acctbal < 1000").select("s_name", (F.col("s_nationkey") + 100).alias("s_nationkey")).unionByName(t.nation.select(F.concat(F.lit("new-"), F.col("n_name")).alias("s_name"), F.col("n_nationkey").alias("s_nationkey")))
    return C.upsert(t.supplier.select("s_name", "s_nationkey"), new, "s_name")


PARAMETERS = [("query", "string", None, None, True, None), ("limit", "integer", 1, 1000, False, "20"), ("context_lines", "integer", 0, 10, False, "0"), ("regex", "boolean", None, None, False, "false"), ("tags", "array", None, None, False, None), ("headers", "object", None, None, False, None)]
VALUES = ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in PARAMETERS)


@query("f31_parameter_schema", "F-31 F-32 F-33 F-34 P-29", f"""select name, '{{"name":"' || name || '","type":"' || type || '"' || coalesce(',"minimum":' || least_, '') || coalesce(',"maximum":' || most, '') || ',"required":' || required || coalesce(',"default":"' || preset || '"', '') || '}}' as schema,
case type when 'string' then '"example"' when 'integer' then '42' when 'boolean' then 'true' when 'array' then '[]' when 'object' then '{{}}' end as example from (values {VALUES}) p(name, type, least_, most, required, preset)""")
def parameter_schema(t: Tables) -> DataFrame:
    p = t.spark.createDataFrame(PARAMETERS, "name string, type string, least int, most int, required boolean, preset string")
    return p.select("name", C.parameter_schema(p.name, p.type, p.least, p.most, p.required, p.preset).alias("schema"), C.example_value(p.type).alias("example"))


@query("d05_describe_tool", "D-05 P-26 P-28", f"with {SQL} select tool_id, name, description, array_to_string(tags, ',') as tags, usage_count, seq % 3 = 0 as allowed from tools where tool_id = '17'")
def describe(t: Tables) -> DataFrame:
    needs = F.col("seq") % 3 != 0  # tools that ask for the permission to run, which this caller lacks
    return tools(t).filter("tool_id = '17'").select("tool_id", "name", "description", F.array_join("tags", ",").alias("tags"), "usage_count", (~needs).alias("allowed"))


@query("p25_discovery_filter", "P-25 S-16", f"with {SQL} select tool_id from tools where not contains(name, 'hot') and not contains(name, 'bolt') and category = 'Brand#4' and length(name) > 8")
def discovery(t: Tables) -> DataFrame:
    return tools(t).filter(~F.contains("name", F.lit("hot")) & ~F.contains("name", F.lit("bolt"))).filter("category = 'Brand#4'").filter(F.length("name") > 8).select("tool_id")


@query("d04_retagged", "D-04 U-11", f"""with {SQL}, c as (select tool_id, seq as at, case when seq % 3 = 0 then 'remove' else 'add' end as action, case when seq % 2 = 0 then 'red' else 'new' end as tag from tools)
select tool_id, array_to_string(list_sort(list_distinct(case when action = 'add' then list_append(tags, tag) else list_filter(tags, lambda x: x <> tag) end)), ',') as tags from tools join c using (tool_id)""")
def retagged(t: Tables) -> DataFrame:
    every = tools(t)
    seq = F.col("seq")
    log = every.select("tool_id", "seq", F.when(seq % 3 == 0, "remove").otherwise("add").alias("action"), F.when(seq % 2 == 0, "red").otherwise("new").alias("tag"))
    earlier = log.select("tool_id", (seq - 10_000_000).alias("seq"), F.lit("add").alias("action"), "tag")
    return C.retagged(every.select("tool_id", "tags"), log.unionByName(earlier)).select("tool_id", F.array_join("tags", ",").alias("tags"))


@query("f30_types", "F-30", f"select name, case type when 'integer' then 'bigint' when 'boolean' then 'boolean' when 'array' then 'array<string>' when 'object' then 'map<string,string>' else 'string' end as column_type from (values {VALUES}) p(name, type, a, b, c, d)")
def types(t: Tables) -> DataFrame:
    p = t.spark.createDataFrame(PARAMETERS, "name string, type string, least int, most int, required boolean, preset string")
    return p.select("name", C.spark_type(p.type).alias("column_type"))


@query("d01_register", "D-01", f"with {SQL} select tool_id, seq = min(seq) over (partition by name, version) as accepted from tools")
def register(t: Tables) -> DataFrame:
    return C.registered(tools(t), "seq").select("tool_id", "accepted")


@query("d02_unregister", "D-02", f"""with {SQL}, l as (select * from tools where status <> 'deprecated') select 'tool' as kind, name as key, tool_id from l union all select 'alias', 'alias-' || seq, tool_id from l
union all select distinct 'tag', unnest(tags), tool_id from l""")
def unregister(t: Tables) -> DataFrame:
    every = tools(t)
    aliases = every.select(F.concat(F.lit("alias-"), F.col("seq").cast("string")).alias("key"), "tool_id")
    left, named, tagged = C.unregistered(every, aliases, every.filter("status = 'deprecated'"))
    rows = lambda kind, df, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "tool_id")
    return rows("tool", left, "name").unionByName(rows("alias", named, "key")).unionByName(rows("tag", tagged, "tag"))


@query("d03_usage_log", "D-03", f"""with {SQL}, g as (select cast(l_partkey as varchar) as tool_id, l_shipdate as used_at, case l_returnflag when 'R' then 'deprecated' when 'A' then 'inactive' end as status, l_linestatus = 'F' as used from lineitem),
c as (select tool_id, max(row(used_at, status)) filter (where status is not null) as c, count(*) filter (where used) as n, max(used_at) filter (where used) as l from g group by 1)
select tool_id, coalesce(struct_extract(c, 2), status) as status, usage_count + coalesce(n, 0) as usage_count, greatest(last_used, l) as last_used from tools left join c using (tool_id)""")
def usage_log(t: Tables) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", "deprecated").when(F.col("l_returnflag") == "A", "inactive")
    log = t.lineitem.select(F.col("l_partkey").cast("string").alias("tool_id"), F.col("l_shipdate").alias("at"), flag.alias("status"), (F.col("l_linestatus") == "F").alias("used"))
    return C.folded(tools(t), log)
