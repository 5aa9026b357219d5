"""Input tables, and folders that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders made in the scopes that this thread is in; queries in other threads have their own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session may do without, as in tests."""
    set_already = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_already:
        return set_already
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "lorebase-checkpoints"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    """A folder not made yet, in the shared one; the scopes round it delete it at their end."""
    path = f"{shared_dir(spark).rstrip('/')}/lorebase-{uuid.uuid4().hex}"
    for made in _scopes.get():
        made.append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["settled_path"] = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the folders of settled frames that nothing unwritten reads any more."""
    for df in frames:
        path = df.__dict__.get("settled_path")
        if path:
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession, *keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Delete at the end what was settled inside, but for frames put into the list."""
    made: list[str] = []
    kept: list[DataFrame] = list(keep)
    before = _scopes.set((*_scopes.get(), made))
    try:
        yield kept
    finally:
        _scopes.reset(before)
        spared = {df.__dict__.get("settled_path") for df in kept}
        for path in made:
            if path not in spared:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
