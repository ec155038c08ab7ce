"""Language identification by compression.

Each language has zstandard raw-content dictionaries made of sample texts of that language, in lower case. A text, too, is
compressed with each language's dictionary; the language that makes it smallest wins, unless the runner-up comes so near that the
margin, as a share of the runner-up's size, is under `margin`; then the language is `und` and `accepted` is false.

A text is compressed in segments of SEGMENT bytes, each by itself, and its size is the sum over all of them. So every part
of a text meets the dictionary, and the margin of a text doesn't depend on its length: compressed whole, a long text would
be its own dictionary.

Sample texts are dealt to two folds by their hash, and a language has a dictionary of each. A text is judged by the
dictionaries of the other fold, so none is judged by a dictionary that holds it or an exact copy of it.

The dictionaries are fitted on a bounded sample of rows whose language is known: `per_language` rows a language, of the
least hashes of their ids, up to `dictionary_bytes` bytes a language. Of a text of more than 1/`share` of these bytes, PIECES
pieces that lie evenly over all of it are taken. Everything else covers all rows and whole texts.

Defined results: a null, blank or empty text is `und` with null margin and not accepted; without any labelled row every
text is so, and with one language only the margin is 1; a fold without a text of some language borrows the other's; equal sizes go to the language first in the alphabet, with
margin 0; a null id is kept; repeated rows are judged one by one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgrid.llm.common import arrow_map, blank, pick

PER_LANGUAGE, DICTIONARY_BYTES, LEVEL, MARGIN = 600, 1 << 20, 6, 0.003
#: Bytes that are compressed at a time.
SEGMENT = 8192
#: The share of a language's bytes that one sample text may take, as 1/SHARE; pieces that are taken of a longer one.
SHARE, PIECES = 8, 8


def fold(text: str) -> int:
    """0 or 1, the same for equal texts."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) & 1


def dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES, share: int = SHARE) -> dict[str, tuple[bytes, bytes]]:
    """Language -> raw content of each fold. Ranks are limited before the shuffle, on ids alone; texts are then read for the chosen ids."""
    known = pick(docs, id=id_col, lang=lang_col).filter("id is not null and lang is not null and lang <> ''")
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = known.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).groupBy("id", "lang").agg(F.min("n").alias("n"))
    text, most = docs[text_col].cast("string"), dictionary_bytes // share
    piece = max(1, most // PIECES // 4)  # characters; one has 4 bytes at most
    pieces = F.concat_ws("\n", *(F.substring(text, (F.floor(F.length(text) * k / PIECES) + 1).cast("int"), F.lit(piece)) for k in range(PIECES)))
    texts = pick(docs, id=id_col, lang=lang_col, text=F.when(F.octet_length(text) <= most, text).otherwise(pieces)).filter("text is not null")
    found = texts.join(F.broadcast(chosen), ["id", "lang"])  # per_language rows a language
    first = W.partitionBy("lang").orderBy("n", F.xxhash64("text"), "text")
    found = found.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language)  # an id may have many rows
    found = found.withColumn("bytes", F.sum(F.octet_length("text") + 1).over(first.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("bytes") <= dictionary_bytes)
    out: dict[str, tuple[bytes, bytes]] = {}
    for r in sorted(found.select("lang", "k", "text").collect()):  # dictionary_bytes a language
        halves = list(out.get(r["lang"], (b"", b"")))
        halves[fold(r["text"])] += r["text"].lower().encode("utf-8", "replace") + b"\n"
        out[r["lang"]] = tuple(halves)
    return {k: (a if len(a) >= 8 else b, b if len(b) >= 8 else a) for k, (a, b) in sorted(out.items()) if max(len(a), len(b)) >= 8}


class Judge:
    """Compressors by language, of each fold; made anew in each Python worker."""

    def __init__(self, contents: dict[str, tuple[bytes, bytes]], level: int = LEVEL):
        self.names = sorted(contents)
        self.by = []
        for k in (0, 1):
            some = []
            for name in self.names:
                d = zstandard.ZstdCompressionDict(contents[name][k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                some.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            self.by.append(some)

    def __call__(self, text: str | None, margin: float = MARGIN) -> tuple[str, float | None, bool]:
        if not text or not text.strip() or not self.names:
            return "und", None, False
        raw = text.lower().encode("utf-8", "replace")
        parts = [raw[k : k + SEGMENT] for k in range(0, len(raw), SEGMENT)]
        sizes = sorted((sum(map(len, map(c.compress, parts))), k) for c, k in zip(self.by[1 - fold(text)], self.names))
        gap = 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return (sizes[0][1] if gap >= margin else "und"), gap, gap >= margin


def identify(docs: DataFrame, contents: dict[str, tuple[bytes, bytes]], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, level: int = LEVEL) -> DataFrame:
    """doc_id, language, margin, accepted for every row: a map without a shuffle."""
    made: list[Judge] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Judge(contents, level))
        got = [made[0](t, margin) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "language": [x[0] for x in got], "margin": [x[1] for x in got], "accepted": [x[2] for x in got]}

    return arrow_map(pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string")), run, "doc_id long, language string, margin double, accepted boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, dictionaries(docs.filter(~blank(docs["text"]))))
