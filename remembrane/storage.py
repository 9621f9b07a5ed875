"""Tables in the folder that all executors share, to end a lineage."""

from __future__ import annotations

import atexit
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

OWN = "spark.remembrane.shared"
_written: list[tuple[SparkSession, str]] = []
_lasting: dict[tuple, tuple[SparkSession, str, DataFrame]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and the master is local, as in tests, a temporary folder.

    On a cluster a machine's own folder would lose rows without an error, so there the setting has to be there.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(OWN, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="remembrane-")
        spark.conf.set(OWN, shared)
    return shared.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table that is dropped when the driver's Python ends, or by drop_tables."""
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables written inside are dropped at the end: for a call whose result has been written or collected by then."""
    kept = len(_written)
    try:
        yield
    finally:
        drop_tables(kept)


def _delete(spark: SparkSession, path: str) -> bool:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except (Py4JError, OSError, AttributeError):  # the JVM has gone; its folder is the cluster's to clean
        return False
    return True


def drop_tables(keep: int = 0) -> None:
    """Delete the tables written so far, but for the first `keep`; what was derived from them can't be computed any more."""
    while len(_written) > keep:
        if not _delete(*_written.pop()):
            return


def _key(name: str, source: DataFrame, more: tuple) -> tuple:
    size = str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return source.sparkSession.sparkContext.applicationId, name, more, tuple(sorted(source.inputFiles())), tuple(source.columns), size


def known(name: str, source: DataFrame, *more: str) -> bool:
    """Whether lasting would find its table written."""
    return _key(name, source, more) in _lasting


def lasting(name: str, source: DataFrame, build: Callable[[DataFrame, str], DataFrame], *more: str) -> DataFrame:
    """The table that build(source, path) writes (and returns, for its columns), read; written once for a source and what `more` names, and kept for the session.

    For indexes: the source is known by its files and their size, so a changed source is indexed anew. Dropped by drop_lasting,
    or when the driver's Python ends.
    """
    spark, key = source.sparkSession, _key(name, source, more)
    if key not in _lasting:
        path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
        written = build(source, path)
        _lasting[key] = (spark, path, spark.read.schema(written.schema).parquet(path))
    return _lasting[key][2]


def lasting_path(name: str, source: DataFrame, *more: str) -> str:
    """Where lasting has written its table; what its builder puts beside it, under this path with a suffix, goes with it."""
    return _lasting[_key(name, source, more)][1]


def drop_lasting() -> None:
    """Delete the session's indexes."""
    while _lasting:
        spark, path, _ = _lasting.popitem()[1]
        if not all(_delete(spark, p) for p in (path, f"{path}-model")):
            return


atexit.register(drop_tables)
atexit.register(drop_lasting)


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again: lost executors cost no rework of what came before."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
