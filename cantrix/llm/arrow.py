"""Small helpers around ``mapInArrow``: pass some columns through, add computed ones."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbuf import Texts, chunks

#: Rows of an Arrow batch are cut again by bytes in ``textbuf.chunks``.
KEY, TEXT = "_key", "_text"


def add_columns(df: DataFrame, text: str, keep: list[str], schema: str, of: Callable[[], Callable[[Texts], dict]]) -> DataFrame:
    """``keep`` columns of each row, then the columns that ``of()(chunk)`` makes from the whole text.

    ``of`` is called once a task and returns a function from a chunk to arrays by name.
    Only ``keep`` and ``text`` are read, so other columns, whatever their names, have no effect.
    """
    kept = {k: df.schema[k].dataType.simpleString() for k in keep}
    out = ", ".join([*(f"`{k}` {v}" for k, v in kept.items()), schema])
    names = [x.split()[0] for x in schema.split(", ")]
    types = [f.type for f in _arrow(df.sparkSession, schema)]

    # a text that is kept as it is crosses to Python once
    at = keep.index(text) if text in keep and kept[text] == "string" else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = of()
        for b in batches:
            for t in chunks(b.column(at)):
                got = each(t)
                own = [b.column(i).slice(t.first, len(t)) for i in range(len(keep))]
                made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip((got[n] for n in names), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *made], [*keep, *names])
        pa.default_memory_pool().release_unused()

    columns = [F.col(f"`{k}`") for k in keep] + [F.col(f"`{text}`").cast("string").alias(TEXT)] * (at == len(keep))
    return df.select(*columns).mapInArrow(run, out)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the documented folds."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for each i; empty spans give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local master, whose workers share the driver's disk, may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{tempfile.gettempdir()}/cantrix-checkpoints"


#: Settings that decide how much is held at once, with the default and what is set in its place: rows and bytes of an
#: Arrow batch, rows that a Parquet reader holds; then Parquet's own. Vectored reads pass a column chunk through direct
#: buffers as long as it, which their threads keep; other reads take it in pieces. Row groups and pages are short, also
#: where rows are long: compressors keep direct buffers of the longest page. Every row passes either way.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2048"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", f"{4 << 20}b"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
    "parquet.hadoop.vectored.io.enabled": ("true", "false"),
    "parquet.read.allocation.size": (f"{8 << 20}", f"{1 << 18}"),
    "parquet.block.size": (f"{128 << 20}", f"{16 << 20}"),
    "parquet.page.size": (f"{1 << 20}", f"{1 << 18}"),
    "parquet.page.size.row.check.min": ("100", "8"),
}


def bound_batches(spark: SparkSession) -> dict[str, str | None]:
    """Set ``BATCHES`` and return what held before. An own setting of the session, or of Hadoop's, is kept."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = {}
    for name, (default, small) in BATCHES.items():
        own = spark.conf.get(name, None)
        if own == default or own is None and hadoop.get(name) is None:
            before[name] = own
            spark.conf.set(name, small)
    return before


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    before = bound_batches(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, which goes when the driver ends or by ``drop``.

    A written table has plain statistics and no constraints, which ``checkpoint()`` carries along
    and which grow with every step of an iteration.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/cantrix-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove the table behind a DataFrame of ``cut`` that nothing reads any more."""
    _remove(df.sparkSession, df._cut_path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone, and the folder with it
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
