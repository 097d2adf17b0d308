"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hex_int(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits of ``digest`` from the 1-based ``start`` as an integer (at most 15 digits)."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column has."""
    while name.lower() in (c.lower() for c in df.columns):
        name = "_" + name
    return name


def numbered(docs: DataFrame, id_col: str, text_col: str, name: str) -> tuple[DataFrame, bool]:
    """``docs`` with a column ``name`` that tells rows apart and orders them: the id, where ids are whole numbers, unique and not null; and is it that.

    Otherwise rows are numbered in order of id (null last), then text.
    """
    repeated = docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1))
    if docs.schema[id_col].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint") and repeated.isEmpty():
        return docs.withColumn(name, F.coalesce(F.col(id_col).cast("long"), F.lit(0))), True  # none is null; said so, plans can share exchanges
    return written(docs.sort(F.col(id_col).asc_nulls_last(), text_col).withColumn(name, F.monotonically_increasing_id())), False


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one where that is unset (local runs)."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("cadenza.shared.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("cadenza.shared.dir", at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: cuts the lineage, survives lost executors."""
    at = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    back = df.sparkSession.read.schema(df.schema).parquet(at)
    back._written_to = at
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what `written` wrote, once nothing that is still to run reads it."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
