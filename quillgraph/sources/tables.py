"""Writing intermediate tables where every executor can read them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder of spark.checkpoint.dir (a temporary one in one local process where none is set)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/graph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that queries of one application share: (application, key) -> table.
_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, key: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """The table of ``key``, written once an application and read again by every query, as long as its files are there."""
    at = (spark.sparkContext.applicationId, *key)
    if at in _KEPT and not _there(_KEPT[at]):
        del _KEPT[at]
    if at not in _KEPT:
        _KEPT[at] = written(build(), "-".join(x for x in key if "/" not in x))
    return _KEPT[at]


def _there(df: DataFrame) -> bool:
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)
