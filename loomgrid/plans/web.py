"""Pages as recorded HTTP responses and search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgrid.functions import html as H
from loomgrid.functions import http, text, url
from loomgrid.plans.registry import Tables, query

CLEAN = "replace(replace(replace(replace(replace(replace(regexp_replace(trim({x}, ' ' || chr(10)), '[ \\n]+', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39))"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def title() -> F.Column:
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


@query("f01_clean_text", "F-01", f"select page_id, {CLEAN.format(x=TITLE)} as title from pages")
def clean(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.clean_text(title()).alias("title"))


@query("f02_url_checks", "F-02 F-03 F-05 F-06 F-23", """select page_id, length(url) >= 7 and regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') as valid, regexp_matches(url, '(?i)^https?://[^/?#]+') as request, lower(regexp_replace(url, '/+$', '')) as normal,
case when contains(url, '//') then string_split(url, '/')[3] else string_split(url, '/')[1] end as domain, case when page_id % 2 = 0 then url else '' end as checked from pages""")
def url_checks(t: Tables) -> DataFrame:
    u = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("not a url")
    return t.pages.select("page_id", url.is_valid(F.col("url")).alias("valid"), url.is_request(F.col("url")).alias("request"), url.normal(F.col("url")).alias("normal"), url.domain(F.col("url")).alias("domain"), F.when(url.is_valid(u), u).otherwise("").alias("checked"))


@query("f04_redirect_unwrap", "F-04", "select page_id, case when page_id % 3 = 0 then url else 'https://s.example.com/l/?kh=1' end as target from pages")
def unwrap(t: Tables) -> DataFrame:
    twice = F.url_encode(F.url_encode("url"))
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://s.example.com/l/?kh=1&uddg="), twice)).otherwise("https://s.example.com/l/?kh=1")
    return t.pages.select("page_id", url.unwrapped(link).alias("target"))


@query("f07_truncation", "F-07 F-08 F-09 F-14", f"""select page_id, case when length({TITLE}) > 80 then left({TITLE}, 77) || '...' else {TITLE} end as title, case when length(html) > 120 then left(html, 117) || '...' else html end as snippet,
string_split({TITLE}, ' - ')[1] as topic, case when length(html) > 8000 then left(html, 8000) || ' [truncated]' else html end as body from pages""")
def truncation(t: Tables) -> DataFrame:
    h = F.col("html")
    return t.pages.select("page_id", text.shortened(title(), 80, 77).alias("title"), text.shortened(h, 120, 117).alias("snippet"), text.topic_title(title()).alias("topic"), text.capped(h).alias("body"))


@query("f10_fallback_snippet", "F-10 J-16", """with s as (select doc_id, text, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x)), lambda x: contains(lower(x), 'tion') and length(x) > 20)[1] as first from documents)
select doc_id, case when length(text) <= 150 then text when first is not null then case when length(first) > 200 then left(first, 200) || '...' else first end else left(text, 150) || '...' end as snippet from s""")
def fallback_snippet(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.snippet(F.col("text"), "Tion").alias("snippet"))


@query("f12_content_kind", "F-12 F-13 F-25", """select page_id, case when kind = 'a' or left(trim(html), 14) = '<!DOCTYPE html' then 'html' end as html_kind, kind in ('b', 'c') as code from (select page_id, html, case page_id % 4 when 0 then 'a' when 1 then 'b' when 2 then 'c' else 'd' end as kind from pages)""")
def content_kind(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("text/html; charset=utf-8", "application/javascript", "text/css", "application/octet-stream"))), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", F.when(text.is_html(kind, F.col("html")), "html").alias("html_kind"), text.is_code(kind, F.col("html")).alias("code"))


@query("f15_response_type", "F-15 F-22 S-06", "select event_id, case when event_id % 4 = 0 then 'json' when event_id % 4 = 1 then 'json_string' when event_id % 4 = 2 then 'text' else 'other' end as response_type, cast(length(case when event_id % 4 = 2 then 'not ' || props when event_id % 4 < 2 then props else '' end) as bigint) as data_size from events")
def response_type(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.encode(F.when(k < 2, F.col("props")).when(k == 2, F.concat(F.lit("not "), F.col("props"))), "UTF-8")
    body = F.decode(raw, "UTF-8")
    return t.events.select("event_id", http.response_type(body, k == 0).alias("response_type"), F.length(F.coalesce(body, F.lit(""))).cast("long").alias("data_size"))


@query("f16_status_category", "F-16", "select event_id, case (100 + event_id % 500) // 100 when 2 then 'success' when 3 then 'redirection' when 4 then 'client_error' when 5 then 'server_error' else 'unknown' end as category from events")
def status_category(t: Tables) -> DataFrame:
    return t.events.select("event_id", http.status_category(100 + F.col("event_id") % 500).alias("category"))


@query("f17_request_type", "F-17 F-26", "select event_id, case when event_id % 3 < 2 then 'application/json' else 'application/x-www-form-urlencoded' end as kind from events")
def request_type(t: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    body = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.col("props"), F.lit(" cut"))).otherwise("a=1&b=2")
    return t.events.select("event_id", http.request_type(body, F.lit(False)).alias("kind"))


@query("f42_back_off", "F-42 T-15", "select event_id, cast(event_id % 4 + 1 as double) as linear, round(pow(1.5, event_id % 4), 6) as growing from events")
def back_off(t: Tables) -> DataFrame:
    n = F.col("event_id") % 4
    return t.events.select("event_id", http.back_off(n).alias("linear"), F.round(http.back_off(n, factor=1.5), 6).alias("growing"))


@query("f50_parameters", "F-50 F-03", "select page_id, upper(trim(v)) as method, upper(trim(v)) in ('DELETE', 'GET', 'HEAD', 'OPTIONS', 'PATCH', 'POST', 'PUT') as known, lower(trim(l)) as language, length(trim(l)) = 2 as good from (select page_id, case page_id % 3 when 0 then ' get ' when 1 then 'Post' else 'trace' end as v, case page_id % 2 when 0 then ' EN' else 'deu' end as l from pages)")
def parameters(t: Tables) -> DataFrame:
    k = F.col("page_id")
    v, l = F.when(k % 3 == 0, " get ").when(k % 3 == 1, "Post").otherwise("trace"), F.when(k % 2 == 0, " EN").otherwise("deu")
    method = F.upper(F.trim(v))
    return t.pages.select("page_id", method.alias("method"), method.isin("DELETE GET HEAD OPTIONS PATCH POST PUT".split()).alias("known"), F.lower(F.trim(l)).alias("language"), (F.length(F.trim(l)) == 2).alias("good"))


@query("f11_html_text", "F-11 F-12")
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", H.main_text(F.col("html")).alias("text"))


LINKS = """links as (select page_id, cast(i as bigint) as pos, m as raw, regexp_extract(m, 'href="([^"]*)"', 1) as href, regexp_extract(m, '>([^<]*)<', 1) as title from
(select page_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as m from (select page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as l from pages)))"""


def results(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*</a>'), F.lit(0))).alias("i", "m"))
    return found.select("page_id", (F.col("i") + 1).cast("long").alias("pos"), F.regexp_extract("m", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("m", ">([^<]*)<", 1).alias("title"))


@query("s11_lite_links", "S-11 F-19 P-18 O-10", f"with {LINKS} select page_id, pos, href, title from links where length(href) > 0 and href not like '#%' and not contains(href, 'search.example.com') and length(title) >= 3 and pos <= 20")
def lite_links(t: Tables) -> DataFrame:
    r = results(t)
    return r.filter(url.acceptable_link(r.href, r.title, "search.example.com")).filter("pos <= 20")


@query("s10_parsed_links", "S-10 F-20 F-21", f"with {LINKS} select page_id, pos, href, title from links")
def parsed_links(t: Tables) -> DataFrame:
    every = t.pages.select("page_id", F.posexplode(H.links(F.col("html"))).alias("i", "a"))
    return every.select("page_id", (F.col("i") + 1).cast("long").alias("pos"), F.col("a.href").alias("href"), F.col("a.text").alias("title"))


@query("w05_url_dedup", "W-05 U-08 W-08", f"with {LINKS}, d as (select *, row_number() over (partition by page_id, lower(regexp_replace(href, '/+$', '')) order by pos) as n from links) select page_id, href, cast(row_number() over (partition by page_id order by pos) as bigint) as ordinal from d where n = 1")
def url_dedup(t: Tables) -> DataFrame:
    first = results(t).groupBy("page_id", url.normal(F.col("href")).alias("normal")).agg(F.min("pos").alias("pos"), F.min_by("href", "pos").alias("href"))
    return first.select("page_id", "href", F.row_number().over(W.partitionBy("page_id").orderBy("pos")).cast("long").alias("ordinal"))


@query("u07_fallback_chain", "U-07 U-02 S-08 S-09 F-24", """with s as (select 1 as rank, page_id, url as result from pages where url like 'https:%' union all select 2, page_id, 'html:' || url from pages where contains(url, 'www.') union all select 3, page_id, 'instant:' || page_id from pages),
b as (select page_id, min(rank) as rank from s group by 1) select page_id, result, cast(rank as bigint) as rank from s join b using (page_id, rank)""")
def fallback_chain(t: Tables) -> DataFrame:
    p = t.pages
    lite = p.filter("url like 'https:%'").select(F.lit(1).alias("rank"), "page_id", F.col("url").alias("result"))
    serp = p.filter("contains(url, 'www.')").select(F.lit(2).alias("rank"), "page_id", F.concat(F.lit("html:"), "url").alias("result"))
    instant = p.select(F.lit(3).alias("rank"), "page_id", F.concat(F.lit("instant:"), F.col("page_id").cast("string")).alias("result"))
    best = lite.unionByName(serp).unionByName(instant).groupBy("page_id").agg(F.min(F.struct("rank", "result")).alias("m"))
    return best.select("page_id", "m.result", F.col("m.rank").cast("long").alias("rank"))


@query("s09_instant_answer", "S-09 U-02 F-22 F-24", """select page_id, 'topic' as block, cast(i as bigint) as pos, 'T' || i as title from pages, range(1, 4) r(i) where i <= page_id % 4 union all select page_id, 'abstract', 10, coalesce(case when page_id % 2 = 0 then 'H' || page_id end, 'Instant answer') from pages""")
def instant_answer(t: Tables) -> DataFrame:
    topics = F.transform(F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda i: i <= F.col("page_id") % 4), lambda i: F.struct(F.concat(F.lit("T"), i.cast("string"), F.lit(" - more")).alias("Text")))
    raw = F.to_json(F.struct(topics.alias("RelatedTopics"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("H"), F.col("page_id").cast("string"))).alias("Heading")))
    doc = t.pages.select("page_id", F.from_json(raw, "RelatedTopics array<struct<Text:string>>, Heading string").alias("j"))
    topic = doc.select("page_id", F.lit("topic").alias("block"), F.posexplode("j.RelatedTopics").alias("i", "r")).select("page_id", "block", (F.col("i") + 1).cast("long").alias("pos"), text.topic_title(F.col("r.Text")).alias("title"))
    return topic.unionByName(doc.select("page_id", F.lit("abstract").alias("block"), F.lit(10).cast("long").alias("pos"), F.coalesce("j.Heading", F.lit("Instant answer")).alias("title")))


@query("f27_result_text", "F-27 W-08 F-06 F-08", f"""with {LINKS}, k as (select * from links where pos <= 3) select page_id, count(*) || case when count(*) = 1 then ' result' else ' results' end || chr(10) || string_agg(pos || '. ' || title || chr(10) || '   ' || href, chr(10) order by pos) as text from k group by 1""")
def result_text(t: Tables) -> DataFrame:
    block = F.concat(F.col("pos").cast("string"), F.lit(". "), "title", F.lit("\n   "), url.shown(F.col("href")))
    n = F.count(F.lit(1))
    return results(t).filter("pos <= 3").groupBy("page_id").agg(F.concat(n.cast("string"), F.when(n == 1, " result").otherwise(" results"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), "\n")).alias("text"))
