"""Plumbing that the operators share: the shared work folder, written intermediate tables, batch helpers."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of output that a Python worker gathers before it hands a batch back.
FLUSH_BYTES = 8 << 20

#: Rows and bytes of an Arrow batch: texts are long, and each task holds a batch in the JVM and in Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_made: dict[str, SparkSession] = {}
#: Of an application on one machine without a configured folder: its own.
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a new one for a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_dir.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_dir[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return base.rstrip("/")


def _plain(label: str) -> str:
    return re.sub("[^a-z0-9]+", "-", label)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one; it is removed when the driver process ends."""
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex[:12]}-{_plain(label)}"
    _made[path] = spark
    return path


def remove(path: str) -> None:
    """Removes a folder that ``work_dir`` named."""
    spark = _made.pop(path, None)
    with contextlib.suppress(Exception):
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextlib.contextmanager
def spent(*keep: str) -> Iterator[None]:
    """Removes at its end the folders that were named within, but for those whose label is in ``keep``."""
    before = set(_made)
    yield
    for path in [p for p in _made if p not in before and not any(p.endswith(f"-{_plain(k)}") for k in keep)]:
        remove(path)


@atexit.register
def _remove_work_dirs() -> None:
    for path in list(_made):
        remove(path)


def written(df: DataFrame, label: str, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder (or at ``path``) and read back.

    This cuts the lineage: what follows survives the loss of any executor and never
    recomputes ``df``.
    """
    spark = df.sparkSession
    path = path or work_dir(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def publish(folder: str, name: str, write) -> str:
    """Writes a file in a shared folder by ``write(stream)`` and returns its address.

    Each attempt of a task has a file of its own, whose name starts with ``name``; the address that the
    task hands on, with its other rows, is the one of the attempt that counts.
    """
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}.bin"
    with fs.open_output_stream(f"{root}/{own}") as out:
        write(out)
    return f"{folder}/{own}"


def read_shared(uri: str) -> bytes:
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as stream:
        return stream.read()


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` as names that no column of ``df`` has (compared without case), by prefixing underscores."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def content_hash(df: DataFrame, id_col: str | None = None, seed: int = 0) -> Column:
    """A hash (a long) of all columns of a row, nulls told apart; with ``id_col`` of the id as a long and the text columns only."""
    if id_col is not None:
        parts = [F.col(id_col).cast("long"), *[F.col(c) for c, kind in df.dtypes if kind == "string" and c != id_col]]
    else:
        parts = [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(c) for c, kind in df.dtypes]
    return F.xxhash64(F.lit(seed), *parts, *[p.isNull() for p in parts])


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands batches of BATCH_ROWS rows and about BATCH_BYTES at most to Python from now on."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH_ROWS, int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")) % folds


def trimmed(out: Iterator) -> Iterator:
    """``out``; at its end the worker, which later tasks use again, gives back the memory that it no longer needs."""
    try:
        yield from out
    finally:
        release()


def release() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_batches(rows: Iterable[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches from (row, its bytes) pairs, one batch for every ``FLUSH_BYTES``."""
    held: list[tuple] = []
    size = 0
    for row, n in rows:
        held.append(row)
        size += n + 64
        if size >= FLUSH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
