"""Plumbing shared by the operators of this subpackage: shared scratch space, Arrow maps over rows, small files for executors."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stranda.storage import shared_dir

#: Rows that a Python function sees at once; Arrow batches are cut to this many.
SLICE = 512
#: More rows than SLICE make at most so many bytes.
SLICE_BYTES = 32 << 20
#: Bytes of rows that go to a Python worker at once, about; both it and the JVM hold that much.
BATCH_BYTES = 8 << 20


_scratch: list[str] = []


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Frees disks: of these scratch tables, and of shuffle files that nothing refers to any more."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        _scratch.remove(path)
    gc.collect()
    jvm.System.gc()


def made_since(count: int) -> list[str]:
    """Scratch tables made since there were so many."""
    return _scratch[count:]


def scratch_count() -> int:
    return len(_scratch)


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path in the shared folder that nothing else uses; what is written there goes when the driver ends, in whatever store it is.

    With ``keep`` it isn't counted among those that may be discarded before.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if path.startswith(("/", "file:/")):
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    else:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        fs.deleteOnExit(target)
    if not keep:
        _scratch.append(path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = f"{scratch(df.sparkSession, name)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Stores a small file in the shared folder and has Spark hand it to each executor; the name for ``SparkFiles.get``."""
    return put_parts(spark, name, [data])


def put_parts(spark: SparkSession, name: str, parts: Iterable[bytes]) -> str:
    """The same for a file given part by part.

    Executors started later fetch it too. The bytes go through Hadoop's file system, so the folder may be in any store.
    """
    unique = f"{uuid.uuid4().hex}-{name}"
    uri = f"{shared_dir(spark).rstrip('/')}/{unique}"
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    fs.deleteOnExit(path)
    try:
        for data in parts:
            for at in range(0, len(data), 1 << 20):
                out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()
    sc.addFile(path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString())
    return unique


#: Tables that workers hold from task to task, and those that the task at hand has asked for.
_held: list[dict] = []
_asked: list[dict] = []


def held(table: dict) -> dict:
    """A table that a worker keeps from task to task, for as long as its tasks ask for it."""
    _held.append(table)
    return table


def asked(table: dict) -> None:
    _asked.append(table)


def end_task() -> None:
    """Lets go of what tasks of other stages kept: a worker lives on for stages that have no use for it."""
    for table in _held:
        if not any(table is t for t in _asked):
            table.clear()
    _asked.clear()
    release()


def release() -> None:
    """Gives memory that a worker no longer uses back to the machine; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES; a lower one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if bound <= 0 or bound > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def add_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[..., list], inputs: list[str], setup: Callable[[], object] | None = None, keep: list[str] | None = None, rows: int = SLICE) -> DataFrame:
    """Appends computed columns to rows without moving them.

    ``fn(state, *columns)`` gets Arrow arrays of at most ``rows`` rows (SLICE, if they are long) and returns one list or Arrow array per field. ``setup()``
    makes the state once per task. ``keep``: the columns that go on (all, if None); a new column replaces an old one of its name.
    """
    bound_batches(df.sparkSession)
    names = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    # Plain names on the way, as Spark takes a dot in a column's name here for a field of a struct.
    source = df.select(*[F.col(f"`{c}`").alias(f"__k_{k}") for k, c in enumerate(kept)], *[F.col(f"`{c}`").alias(f"__in_{k}") for k, c in enumerate(inputs)])
    schema = T.StructType([*(source.schema[f"__k_{k}"] for k in range(len(kept))), *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    added = list(to_arrow_schema(T.StructType(fields)))
    n, m = len(kept), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            step = rows if batch.nbytes * rows < SLICE_BYTES * max(batch.num_rows, 1) else min(rows, SLICE)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                made = fn(state, *(part.column(n + k) for k in range(m)))
                columns = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, added, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *columns], schema=pa.schema([*list(part.schema)[:n], *added]))
                del part, made, columns
            release()
        del state
        end_task()

    return source.mapInArrow(run, schema).toDF(*kept, *(f.name for f in fields))


def emit(df: DataFrame, schema: str | T.StructType, fn: Callable[[Iterator[list[pa.Array]]], Iterator[list]], inputs: list[str], rows: int = SLICE) -> DataFrame:
    """Rows of another shape: ``fn`` gets an iterator of the input columns and yields lists of columns.

    It gets at most ``rows`` rows at once, and no more than SLICE if they are long.
    """
    bound_batches(df.sparkSession)
    source = df.select(*[F.col(f"`{c}`").alias(f"__in_{k}") for k, c in enumerate(inputs)])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                step = rows if batch.nbytes * rows < SLICE_BYTES * max(batch.num_rows, 1) else min(rows, SLICE)
                for at in range(0, batch.num_rows, step):
                    yield batch.slice(at, step).columns
                release()

        for columns in fn(parts()):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            del columns
        end_task()

    return source.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Whole texts; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8; null counts as empty."""
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
