"""What the training-data operators share: column handling, Arrow maps, checkpoints."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


#: Bytes of lower-case UTF-8: ASCII letters, digits, _ and whatever isn't ASCII stay, the rest becomes a space.
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c == 95 or c >= 128 else 32 for c in range(256))
#: Punctuation and spaces beyond ASCII.
MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2000-\u206f\u2190-\u2bff\u3000-\u3004\u3008-\u3020\u3030\ufe10-\ufe6f\uff01-\uff0f]+")


def words(text: str) -> list[bytes]:
    """Lower-case words as UTF-8: runs of letters, digits, _ and other characters that are neither punctuation nor space."""
    text = text.lower()
    if not text.isascii():
        text = MARKS.sub(" ", text)
    return text.encode("utf-8", "replace").translate(TABLE).split()


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Just the named columns, under new names; others, however named, can't clash."""
    return df.select(*((df[c] if isinstance(c, str) else c).alias(k) for k, c in columns.items()))


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and about BATCH_BYTES bytes of text; a longer text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, x in enumerate(lengths):
        if i > start and (size + x > BATCH_BYTES or i - start >= rows):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += x
    yield batch.slice(start, n - start)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow by slices: f gets a slice and returns {column: values} in the order of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                got = f(part)
                arrays = [got[k.name] if isinstance(got[k.name], pa.Array) else pa.array(got[k.name], type=k.type) for k in kinds]
                yield pa.RecordBatch.from_arrays([a if a.type == k.type else a.cast(k.type) for a, k in zip(arrays, kinds)], schema=kinds)

    return df.mapInArrow(run, schema)


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by the key as tables that hold all rows of each of their keys."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        keys = table.column(key)
        others = np.flatnonzero(pc.not_equal(keys, keys[-1]).to_numpy())
        last = int(others[-1]) + 1 if len(others) else 0
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield held


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir. Where the session names none, a local session gets a temporary folder; on a cluster that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgrid-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows as written to the checkpoint folder, without lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop(df: DataFrame) -> None:
    """Removes what cut() wrote of these rows, once nothing reads them any more."""
    context = df.sparkSession.sparkContext
    name = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if name.isDefined():
        path = context._jvm.org.apache.hadoop.fs.Path(name.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blank(column: Column) -> Column:
    return column.isNull() | (F.length(F.btrim(column, F.lit(" \t\n\r"))) == 0)
