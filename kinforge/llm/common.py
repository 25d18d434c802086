"""What the operators share: their input columns, stored tables, Arrow batches and hashes.

Conventions that hold for every operator, unless its docstring says otherwise:

* Input is any DataFrame with ``doc_id`` (integer) and ``text`` (string); only the columns named are
  read, so other columns may have any name or type.
* A null text counts as the empty text. A null ``doc_id`` is a value like any other and sorts first.
* Each input row is a document of its own: rows that repeat give as many result rows.
* An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.session import shared_dir

Batches = Iterator[pa.RecordBatch]


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long, ``text`` without nulls, and the columns asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like those given that ``docs`` does not use."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
        taken.add(n)
    return out


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once below the shared folder and read back: cuts lineage and fixes the rows.

    The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a session, however the driver came to import it."""
    context = spark.sparkContext
    if getattr(context, "_kinforge_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context.addPyFile(shutil.make_archive(os.path.join(context._temp_dir, "kinforge-package"), "zip", root, "kinforge"))
    context._kinforge_shipped = True


def mapped(df: DataFrame, fn: Callable[[Batches], Batches], schema) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
