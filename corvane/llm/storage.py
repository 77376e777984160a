"""Tables in the shared checkpoint folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corvane-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


#: Bytes of a batch that goes to a Python worker: texts differ too much in length for a number of rows to bound it.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers by bytes, unless the session has set a smaller bound itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = "".join(c for c in spark.conf.get(key) if c.isdigit())
    if not now or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: Tables written inside ``scratch`` blocks that are open.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """On leaving, delete the tables that were written inside, but for the last one, which is the result."""
    _OPEN.append([])
    try:
        yield
    finally:
        for done in _OPEN.pop()[:-1]:
            discard(done)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back with the same column types."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/corvane/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._corvane_path = path
    for made in _OPEN:
        made.append(back)
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote, once nothing reads it any more."""
    path = getattr(df, "_corvane_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, as no column of ``df`` is called in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this process, as a worker, keeps between tasks, by the operator that keeps it.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """A table that a worker keeps for the tasks of ``owner``, until a ``trimmed`` task of another operator begins."""
    return _KEPT.setdefault(owner, {})


def drop_others(owner: str) -> None:
    """Give back what the worker keeps for operators other than ``owner``."""
    others = [held for name, held in _KEPT.items() if name != owner and held]
    for held in others:
        held.clear()
    if others:
        release()


def trimmed(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` over batches, after whose last one the worker, which later tasks share, gives its memory back.

    Before the first one it gives back what operators other than ``owner`` keep.
    """

    def of(batches: Iterator) -> Iterator:
        drop_others(owner)
        try:
            yield from run(batches)
        finally:
            release()

    return of


def release() -> None:
    """Return what this process no longer uses to the system, where the system's library can."""
    import ctypes

    import pyarrow as pa

    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library, which has no such call
        pass
