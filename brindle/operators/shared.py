"""The folder all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
#: All that this process has staged, and, of each thread or task, what the blocks of ``tidy`` around it have staged.
_staged: list[str] = []
_blocks: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("blocks", default=())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset a temporary folder on one machine, and on a cluster a ValueError."""
    path = spark.conf.get("spark.checkpoint.dir", None) or (_own_dir[0] if _own_dir else None)
    if not path and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="brindle-")
        _own_dir.append(path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet under the shared folder, by the session's codec unless one is named, and reads it back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    to_discard(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    files = df.inputFiles()
    gone = [path for path in _staged if files and f"/{path.rsplit('/', 1)[1]}/" in files[0]]
    for path in gone:
        _staged.remove(path)
        for own in _blocks.get():
            if path in own:
                own.remove(path)
    _delete(df.sparkSession, gone)


def to_discard(path: str) -> str:
    """A folder of an operator's own, to be deleted with the staged tables."""
    _staged.append(path)
    for own in _blocks.get():
        own.append(path)
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """A block that ends by staging its result: the tables that this thread staged before that within the block are deleted."""
    own: list[str] = []
    token = _blocks.set((*_blocks.get(), own))
    try:
        yield
    finally:
        _blocks.reset(token)
    gone = own[:-1]
    for path in gone:
        if path in _staged:
            _staged.remove(path)
    _delete(spark, gone)


def discard(spark: SparkSession) -> int:
    """Deletes all that this process has staged, once the results that read it are written; returns how many folders."""
    paths = _staged[:]
    _staged.clear()
    _delete(spark, paths)
    return len(paths)
