import random

import pytest
import zstandard

from loomgrid.llm import langid as L

WORDS = {"aa": "banana kanaka maraka lanada sanaga".split(), "bb": "thwick blorsh grimst spronk flitch".split(), "cc": "oieu aeiou ueoai ieauo ouiea".split()}


def text(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS[lang])[:4] for _ in range(2)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(k, 60, i), k, k) for i, k in enumerate(list(WORDS) * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")


def test_held_out_accuracy(spark, docs):
    contents = L.dictionaries(docs.filter("doc_id < 60"))
    got = {r.doc_id: r for r in L.identify(docs.filter("doc_id >= 60"), contents).collect()}
    want = {r.doc_id: r.lang for r in docs.filter("doc_id >= 60").collect()}
    assert sum(got[k].language == v for k, v in want.items()) >= 0.95 * len(want)


def test_smallest_wins_as_by_hand():
    contents = {k: (text(k, 900, 7).encode(), text(k, 900, 8).encode()) for k in WORDS}
    judge = L.Judge(contents)
    for k, n in [(k, n) for k in WORDS for n in (30, 31, 2000)]:
        t = text(k, n, 99)
        sizes = {}
        for x, c in contents.items():
            d = zstandard.ZstdCompressionDict(c[1 - L.fold(t)], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            z = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes[x] = sum(len(z.compress(t.lower().encode()[i : i + 8192])) for i in range(0, len(t), 8192))
        lang, margin, ok = judge(t)
        first, second = sorted(sizes.values())[:2]
        assert ok and lang == k and sizes[lang] == first and margin == (second - first) / second
    assert judge("zq", margin=0.9)[0] == "und" and judge("zq", margin=0.9)[2] is False


def test_awkward(awkward, nothing, docs):
    contents = L.dictionaries(docs)
    got = L.identify(awkward, contents).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got}
    assert all(by[k].language == "und" and by[k].margin is None and not by[k].accepted for k in (3, 4, 5))
    assert L.identify(nothing, contents).count() == 0
    assert L.dictionaries(nothing) == {}
    assert all(r.language == "und" for r in L.identify(awkward, {}).collect())
    assert L.dictionaries(awkward)  # labels that are null or of null ids are left out
    assert by[7].language == "und" and by[7].margin < L.MARGIN  # one letter again and again
    assert by[6].margin is not None and len([r for r in got if r.doc_id == 2]) == 2
    one = L.identify(awkward.filter("doc_id = 8"), {"aa": contents["aa"]}).first()
    assert (one.language, one.margin, one.accepted) == ("aa", 1.0, True)


def test_ties_go_to_the_first_name():
    same = text("aa", 500, 1).encode()
    assert L.Judge({"b": (same, same), "a": (same, same)})(text("aa", 20, 2), margin=0.0)[:2] == ("a", 0.0)


def test_sample_is_bounded(docs):
    few = L.dictionaries(docs, per_language=5, dictionary_bytes=20_000)
    whole = {r.text.lower() for r in docs.collect()}
    for halves in few.values():
        lines = [set(x.decode().split("\n")[:-1]) for x in halves]
        assert sum(map(len, halves)) <= 20_000 and lines[0] | lines[1] <= whole and len(lines[0]) + len(lines[1]) == 5
    assert set(few) == set(WORDS)
    assert all(sum(map(len, v)) <= 800 for v in L.dictionaries(docs, dictionary_bytes=800).values())


def test_no_text_is_judged_by_a_dictionary_that_holds_it(docs):
    contents = L.dictionaries(docs)
    for r in docs.collect():
        assert r.text.lower().encode() not in contents[r.lang][1 - L.fold(r.text)]


def test_languages_of_long_texts_alone_have_dictionaries(spark):
    rows = [(i, text(k, 4000, i), k) for i, k in enumerate(list(WORDS) * 4)]
    contents = L.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dictionary_bytes=1 << 16)
    assert set(contents) == set(WORDS) and all(0 < sum(map(len, v)) <= 1 << 16 for v in contents.values())
    judge = L.Judge(contents)
    assert all(judge(text(k, 50, 77))[0] == k for k in WORDS)


def test_an_id_of_many_rows(spark):
    rows = [(1, text("aa", 20, i), "aa") for i in range(300)] + [(i, text("bb", 20, i), "bb") for i in range(2, 12)]
    contents = L.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10)
    assert all(sum(x.count(b"\n") for x in v) == 10 for v in contents.values())


def test_margin_does_not_depend_on_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 400")
    contents = L.dictionaries(docs.filter("doc_id % 2 = 0"))
    judge = L.Judge(contents)
    held = [r.text for r in docs.filter("doc_id % 2 = 1 and lang = 'en'").collect()]
    assert judge("\n".join(held)[: 1 << 10])[0] == "en"
    long = "\n".join(held)
    while len(long) < 1 << 24:
        long += "\n" + long
    margins = [judge(long[:n]) for n in (10_000, 100_000, 1 << 20, 1 << 24)]
    assert all(lang == "en" for lang, _, _ in margins), margins
    assert min(m for _, m, _ in margins) > 10 * L.MARGIN
