"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in one local process where none is set (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and every executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows handed to a Python worker at once: whole texts, so the default of 10,000 would hold tens of megabytes twice.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, which may not find it on their own path, in small batches."""
    sc, batch = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= BATCH_ROWS:
        spark.conf.set(batch, str(BATCH_ROWS))
    if getattr(sc, "_quillgraph_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    file = os.path.join(tempfile.mkdtemp(), "quillgraph.zip")
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(file)
    sc._quillgraph_shipped = True


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """array<string> of the words of a text, null: none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(*cols: Column | int) -> Column:
    """A double in (0, 1) that depends on nothing but the values given."""
    args = [F.lit(c) if not isinstance(c, Column) else c for c in cols]
    return (F.shiftrightunsigned(F.xxhash64(*args), 12).cast("double") + 0.5) / F.lit(float(2**52))


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once; a lambda would compute it again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


#: A key is hot if it holds one part in so many of all rows; so there are no more hot keys than that.
HOT_SHARE = 10_000


def join_hot(rows: DataFrame, side: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join with ``side``, one row for each key, whose column ``count`` says how many rows have it (``total`` in all).

    Rows of hot keys meet a broadcast of at most HOT_SHARE rows; the others are shuffled, and none of them is hot.
    """
    hot = side.where(F.col(count) * HOT_SHARE >= total).drop(count)
    cold = side.where(F.col(count) * HOT_SHARE < total).drop(count)
    apart = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(apart.join(cold, on, how))


def dropped(df: DataFrame) -> None:
    """Delete the files of a table of ``written`` that nothing will read again."""
    sc = df.sparkSession.sparkContext
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
