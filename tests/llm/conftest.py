import pytest

EXTRA = "id long, hash binary, key int, node long, tokens long, shard long, language string, score double, `__id` long, row string, n long, group_id long, y int, text_ string, item_id long, word string, pair long, margin double, __key string, capacity long"
PROSE = "the river ran past an old mill and the miller counted sacks of grain by the light of a lamp that his daughter had filled with oil in the morning before she went to the market with two baskets of eggs"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows, ties, and columns whose names clash."""
    rows = [
        (1, PROSE, "en", "a", 5),
        (2, PROSE, "en", "a", 5),
        (2, PROSE, "en", "a", 5),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \n\t ", "de", "b", 3),
        (None, PROSE + " and more of the same was said on the way home", "en", "b", 1),
        (None, None, None, None, None),
        (6, " ".join(f"word{i} runs" for i in range(60_000)), "fr", "c", 9),
        (7, "x" * 300_000, "fr", "c", 9),
        (8, "one", "es", "c", 3),
        (9, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich \U0001f600 " * 9, "de", "d", 1),
    ]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = spark.createDataFrame([], EXTRA)
    from pyspark.sql import functions as F

    return base.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in extra.schema)).cache()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("1 = 0")
