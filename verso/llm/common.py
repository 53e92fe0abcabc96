"""What the operators share: shared-folder tables, row identity and Arrow plumbing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of columns that are Python lists at a time.
BYTES_AT_ONCE = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Without either, a local session gets a temporary folder; a cluster has no folder that could be guessed.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="verso-")
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This ends the lineage (a lost executor re-reads files instead of repeating Python work) and makes
    sure that an expensive stage runs once. ``spent`` tables, which only ``df`` still needed, are deleted
    then; the others go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/verso-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)
    for other in spent:
        if at := getattr(other, "_verso_path", None):
            folder, files = _folder(spark, at)
            files.delete(folder, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._verso_path = path
    return out


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_columns(df: DataFrame, schema: str, work: Callable[[Iterator[list[list]]], Iterator[list]]) -> DataFrame:
    """``mapInArrow`` on Python lists: ``work`` gets an iterator of column lists and yields column lists of ``schema``.

    The output's Arrow types come from ``schema``, so that empty and all-null batches keep their types. Batches
    are halved until a part has at most ``BYTES_AT_ONCE`` bytes or one row, so that long texts need no more
    memory than short ones.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ([column.to_pylist() for column in part.columns] for batch in batches for part in _parts(batch))
        for columns in work(lists):
            arrays = [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, spark_schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.nbytes <= BYTES_AT_ONCE or batch.num_rows < 2:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _parts(batch.slice(0, half))
        yield from _parts(batch.slice(half))


def fold(column: str, divisor: int):
    """crc32 of an id written as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet (names are compared without case, as Spark does)."""
    taken = {name.lower() for name in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with ``value`` as a column that is computed once for each row.

    A plain projection may be merged into the lambdas that use its column and then be computed again for
    every element; a generator of one row stands between.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
