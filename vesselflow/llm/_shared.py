"""What several operators need of the session: the shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; only where it is unset (tests), a new local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="vesselflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: a short lineage and a true size."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def driver_table(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A few rows made in the driver. They go by Arrow: a list of rows would start Python workers of another kind, which stay beside those of later stages."""
    values = list(zip(*rows)) or [()] * len(columns)
    return spark.createDataFrame(pa.table([pa.array(v, kind) for v, kind in zip(values, columns.values())], list(columns)))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written narrow table, marked for broadcast if it has few enough rows, else for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def arrow_rows(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in an Arrow batch, so that a batch of long documents stays small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for a row's id and text, so that rows of one key are taken to be equal."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(1), text, doc_id).alias("b"))


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text, and no other column that a caller's table may have."""
    return docs.select("doc_id", *columns, F.col("text").cast("string").alias("text"))
