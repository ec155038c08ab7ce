import duckdb
import numpy as np
from compare import check, connect

from loomgrid.llm import quality as Q

FOLDER = "/root/testdata/sf0.001"


def test_same_as_sql(spark):
    check(Q.query(spark, FOLDER), Q.sql(), connect(FOLDER))


def test_order_changes_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = list(Q.rules())
    ids = [{r.doc_id for r in Q.keep(docs, order=o).select("doc_id").collect()} for o in (names, names[::-1])]
    assert ids[0] == ids[1]


def test_ranked_by_rejections_per_cost():
    """Rule by rule against all that are left, on what the rules before leave."""
    rng = np.random.default_rng(4)
    names = list(Q.rules())
    for _ in range(50):
        seconds, failed = rng.random((60, len(names))) + 0.01, rng.random((60, len(names))) < 0.2
        got, left = Q.ranked(seconds, failed), list(range(60))
        todo = list(names)
        for name, cost, share in got:
            rate = {k: sum(failed[i][names.index(k)] for i in left) / sum(seconds[i][names.index(k)] for i in left) for k in todo} if left else dict.fromkeys(todo, 0)
            assert abs(rate[name] - max(rate.values())) < 1e-9
            if left:
                assert abs(share - sum(failed[i][names.index(name)] for i in left) / len(left)) < 1e-9
            todo.remove(name)
            left = [i for i in left if not failed[i][names.index(name)]]
    assert [x[0] for x in Q.ranked(np.ones((3, len(names))), np.zeros((3, len(names)), bool))] == names  # a tie


def test_overlapping_rules_are_ranked_on_what_is_left():
    names = list(Q.rules())
    seconds, failed = np.ones((10, len(names))), np.zeros((10, len(names)), bool)
    failed[:6, 1] = failed[:5, 2] = failed[8:, 3] = True  # the second rule finds nothing that the first leaves
    assert [x[0] for x in Q.ranked(seconds, failed)][:2] == [names[1], names[3]]


def test_sample_is_of_all_rows(spark):
    docs = spark.range(0, 4000, 1, 40).selectExpr("id as doc_id", "if(id < 100, 'a b', concat('# # ', id)) as text")
    seconds, failed = Q.measured(docs, sample=160)
    assert seconds.shape == failed.shape == (160, len(Q.rules())) and failed[:, 1].sum() > 100
    assert Q.measured(docs.filter("1 = 0"))[0].shape == (0, len(Q.rules()))


def test_awkward(awkward, nothing):
    kept = Q.keep(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=str) == [1, 2, 2, 8, None]  # 6 has no stop words, 7 is one endless word, 9 repeats itself
    assert Q.keep(nothing).count() == 0


def test_each_rule(spark):
    good = "The old mill stood by the river and the miller was glad of it in the spring"
    bad = {"symbols": "a # b # c # d # e # the of and", "upper": good.upper(), "length": " ".join("a" * 12), "lines": "\n".join(["the same line of it"] * 9), "repeats": "der die das " * 80, "stutter": "la la que que del del raes raes", "stop": " ".join(f"xq{i}zzz" for i in range(60))}
    every = Q.rules()
    assert not any(test(Q.Measures(good)) for test in every.values())
    for name, t in bad.items():
        assert every[name](Q.Measures(t)), name


def test_short_documents_are_judged():
    every = Q.rules()
    failed = lambda t: [k for k, test in every.items() if test(Q.Measures(t))]
    for t in ("x" * 300_000, "$%&*|# " * 8, "Ourere | ertible | thheedre. |", "That*** atly.###", "STOP IT NOW", "ha ha ha", "same\nsame\nsame"):
        assert failed(t), t[:40]
    for t in ("This.", "A.", "I", "Thble erndti.", "R&D pays", "Edrere.", "No no, said the man.", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "one\ntwo\none"):
        assert not failed(t), (t, failed(t))


def test_other_white_space_and_letters(spark):
    """Vertical tabs, form feeds and no-break spaces don't part words; capitals beyond ASCII count."""
    rows = [(1, "a\x0bb c\x0cd " * 30), (2, "ÄÖÜ ÉÈÊ " * 20), (3, "der Äpfel und die Öfen " * 3), (4, "x\u00a0y the of and z " * 15), (5, "\x0b"), (6, "|# " * 12), (7, "A."), (8, "x" * 50), (9, "x" * 40), (10, "ha ha ha"), (11, "# a"), (12, "# # a"), (13, " \x0b \n"), (14, "a b c d e f g h i j k l m"), (15, "A B C D"), (16, "AB CD"), (17, "x\n\nx\nx"), (18, " ".join(f"w{i % 200}" for i in range(3000)) + " the of"), (19, " ".join(f"w{i}" for i in range(300)) + " the of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(r.doc_id for r in Q.keep(docs).collect()) == sorted(r[0] for r in con.execute(Q.sql(columns="doc_id")).fetchall())
