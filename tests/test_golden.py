"""Small worked examples."""

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import html, text, url
from loomgrid.operators import catalog, dag, metrics, scoring, search
from loomgrid.operators.registry import Registry, safe_predicate


def test_task_metrics(spark):
    ok, took, quality, liked = (True, True, False, True), (1.0, 1.5, 3.0, 1.2), (90.0, 85.0, 40.0, 88.0), (95.0, 90.0, 30.0, 92.0)
    rows = [("a", *r) for r in zip(ok, took, quality, liked)]
    r = metrics.task_metrics(spark.createDataFrame(rows, "agent string, success boolean, response_time double, quality_score double, satisfaction double"), "agent", satisfaction="satisfaction").first()
    assert (r.total_tasks, r.successful_tasks, r.failed_tasks, r.success_rate, r.error_rate) == (4, 3, 1, 75.0, 25.0)
    assert (r.average_response_time, r.average_quality, r.average_satisfaction) == (1.675, 75.75, 76.75)


def test_comparison(spark):
    r = spark.range(1).select(*(metrics.change(F.lit(v), F.lit(b), less).alias(k) for k, v, b, less in (("s", 85.0, 70.0, False), ("t", 1.5, 2.0, True), ("q", 90.0, 75.0, False), ("n", 1.0, 0.0, False)))).first()
    assert round(r.s, 2) == 21.43 and r.t == 25 and r.q == pytest.approx(20) and r.n is None


def test_winner(spark):
    s = spark.createDataFrame([(0, 30, 81.832), (1, 35, 96.0), (2, 5, 99.0)], "variation long, total_tasks long, score double")
    r = metrics.winner(s).first()
    assert (r.variation, r.confidence) == (1, 33.25) and round(r.lift, 3) == 17.314


def test_ema(spark):
    log = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "k int, o int, s int")
    assert metrics.ema(log, "k", "o", "s").first().ema == 0.9


def test_content_search(spark):
    files = spark.createDataFrame([("file1.txt", "Hello world\nThis is a test\nHello again"), ("file2.txt", "Different content\nNo matches here"), ("file3.py", "print('Hello world')\n# Hello comment\n")], "file string, text string")
    assert [(r.file, r.line_number) for r in search.search(files, "Hello").orderBy("file", "line_number").collect()] == [("file1.txt", 1), ("file1.txt", 3), ("file3.py", 1), ("file3.py", 2)]
    assert files.select(F.size(search.split_lines(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] == 7


def test_globs(spark):
    names = spark.createDataFrame([("a.txt",), ("b.py",), ("[x].txt",), ("A.TXT",)], "n string")
    get = lambda **k: [r.n for r in names.filter(search.name_matches(F.col("n"), **k)).collect()]
    assert get(glob="?.txt") == ["a.txt"] and get(glob="[!a]*") == ["b.py", "[x].txt", "A.TXT"] and get(glob="A.*", case_sensitive=False) == ["a.txt", "A.TXT"]
    with pytest.raises(Exception):
        get(regex="(")


def test_scores(spark):
    rows = [("simple", "bugfix", "Fix minor UI bug", ["x"]), ("complex", "feature", "Implement user authentication system with database integration and API endpoints", ["authentication", "database", "API integration", "e", "f", "g"]), ("metrics", "feature", "Build secure API with database integration and performance optimization", ["security", "db", "api", "cache"])]
    by = {r.task_id: r for r in scoring.scored(spark.createDataFrame(rows, "task_id string, task_type string, description string, requirements array<string>")).collect()}
    assert by["simple"].complexity == "simple" and by["simple"].hours <= 6 and by["simple"].components == 1
    assert by["complex"].complexity in ("complex", "enterprise") and by["complex"].hours > 8 and by["complex"].components > 3 and "authentication" in by["complex"].skills
    assert by["metrics"].loc > 0 and by["metrics"].components >= 4 and "Security implementation required" in by["metrics"].risks and by["metrics"].n_skills >= 1


def test_cycles_raise(spark):
    loop = spark.createDataFrame([("p", "A", ["B"]), ("p", "B", ["A"])], "plan string, task string, waits array<string>")
    with pytest.raises(ValueError):
        dag.layers(loop).collect()


def test_catalog_search_checks(spark):
    with pytest.raises(ValueError):
        catalog.keyword("  ")
    with pytest.raises(ValueError):
        catalog.search(None, "x", limit=0)


def test_text_functions(spark):
    r = spark.range(1).select(text.clean_text(F.lit("  a \n b&nbsp;&amp;lt; ")).alias("c"), url.unwrapped(F.lit("//s.com/l/?uddg=https%253A%252F%252Fa.b%252Fc&x=1")).alias("u"), url.is_valid(F.lit("nope")).alias("v"), url.normal(F.lit("HTTP://A.b//")).alias("n")).first()
    assert (r.c, r.u, r.v, r.n) == ("a b <", "https://a.b/c", False, "http://a.b")


def test_html_regions():
    assert html.text_of("<body><nav>x</nav><p>a</p><article>b<script>c</script></article></body>") == "b"
    assert html.text_of("<body><main>m</main><article>b</article></body>") == "m"
    assert html.text_of('<div class="my-content">k</div>z') == "k" and html.text_of("plain") == "plain" and html.text_of(None) is None
    assert html.text_of("<p>" + "y" * 9000).endswith("[truncated]")


def test_round_robin_is_global(spark):
    got = {r.i: r.variation for r in metrics.assign(spark.range(0, 600, 3).withColumnRenamed("id", "i").repartition(7), "i", 3).collect()}
    assert got == {3 * k: k % 3 for k in range(200)}


def test_user_queries(spark):
    reg = Registry()

    @reg.add("upto")
    def upto(spark, n: int, step: int = 1):
        return spark.range(0, n, step)

    assert reg.run(spark, "upto", n=5).count() == 5
    with pytest.raises(TypeError):
        reg.run(spark, "upto", n="5")
    with pytest.raises(TypeError):
        reg.run(spark, "upto", m=5)
    with pytest.raises(ValueError):
        reg.add("upto")(upto)
    assert spark.range(4).filter(safe_predicate(lambda x: 6 // x > 2, "id")).count() == 2


def test_search_size_limit(spark, tmp_path):
    from loomgrid.plans.catalogue import QUERIES

    rows = [(1, "555-1234", 8), (2, "é 555-1234", 10), (3, "x" * 5000 + "\n555-1234", 5009), (4, "555-1234\n" + "x" * search.MOST_BYTES, search.MOST_BYTES + 9), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    assert [r.file for r in search.search(docs, "[0-9]{3}-", "doc_id", regex=True, keep=search.searched(docs.text, 10)).collect()] == [1]  # é has two bytes
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["p08_regex_search_default_limit"](spark, str(tmp_path))
    assert sorted((r.file, r.line_number) for r in got.collect()) == [(1, 1), (2, 1), (3, 2)]


def test_risks_keep_their_order(spark):
    row = [("a", "feature", "data migration of legacy code", ["performance", "security"])]
    got = scoring.scored(spark.createDataFrame(row, "task_id string, task_type string, description string, requirements array<string>")).first()
    assert got.risks == ["Security implementation required", "Performance optimization needed", "Legacy system integration", "Data migration required"]


def test_first_variations_are_of_tone():
    assert {r[1] for r in scoring.variations(4)} == {"tone_adjustment"}
    assert [r[1] for r in scoring.variations(5)] == ["tone_adjustment"] * 4 + ["structure_modification"]
    assert [len(scoring.variations(n)) for n in (1, 6, 24, 99)] == [1, 6, 24, 24]


def test_change_log(spark):
    asked = spark.createDataFrame([("a", "1", 1), ("a", "1", 2), ("a", "2", 3), (None, "1", 4), (None, "1", 5)], "name string, version string, seq int")
    assert {r.seq: r.accepted for r in catalog.registered(asked, "seq").collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    tools = spark.createDataFrame([("x", "active", 1, None, ["t"]), ("y", "active", 0, None, ["t", "u"])], "tool_id string, status string, usage_count long, last_used int, tags array<string>")
    left, aliases, tags = catalog.unregistered(tools, spark.createDataFrame([("p", "x"), ("q", "y")], "alias string, tool_id string"), spark.createDataFrame([("x",), ("no",)], "tool_id string"))
    assert [r.tool_id for r in left.collect()] == ["y"] and [r.alias for r in aliases.collect()] == ["q"] and sorted(r.tag for r in tags.collect()) == ["t", "u"]
    log = spark.createDataFrame([("x", 3, "inactive", False), ("x", 5, None, True), ("x", 1, "deprecated", True)], "tool_id string, at int, status string, used boolean")
    assert sorted(map(tuple, catalog.folded(tools, log).collect())) == [("x", "inactive", 3, 5), ("y", "active", 0, None)]
