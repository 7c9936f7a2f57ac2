"""What the operators of this subpackage share: cut lineage in the shared folder, and fixed patterns."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of code points other than ASCII white space (Java, Python and RE2 read it alike).
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space, as the characters themselves.
BLANKS = " \t\n\x0b\x0c\r"

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a folder of our own in local mode alone."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            given = "file://" + tempfile.mkdtemp(prefix="scrivener-")
            spark.sparkContext.setCheckpointDir(given)
        _roots[app] = f"{given.rstrip('/')}/scrivener-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended before the interpreter
        pass


#: Rows that go to Python at once: texts may be long, and a batch of them is held in memory.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """From now on this session sends at most BATCH_ROWS rows to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def in_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInPandas(run, schema)`` in bounded batches, for rows without ids."""
    bound_batches(df.sparkSession)
    return df.mapInPandas(run, schema)


def in_arrow(df: DataFrame, run: Callable[[dict[str, list], int], Iterator[tuple[Sequence[int] | None, dict]]], schema: str, keep: Sequence[str]) -> DataFrame:
    """Python over bounded Arrow batches. Columns of ``keep`` never become Python values: null ids stay null, large ones exact.

    ``run`` gets the other columns as lists, and the number of rows; it yields (rows, columns): the rows of the batch that a
    result belongs to (None: each its own) and the new columns, which ``schema`` names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bound_batches(df.sparkSession)
    kept = [T.StructField(c, df.schema[c].dataType, True) for c in keep]
    out = T.StructType([*kept, *T.StructType.fromDDL(schema).fields])

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for b in given:
            own = {n: b.column(n).to_pylist() for n in b.schema.names if n not in keep}
            for rows, columns in run(own, b.num_rows):
                ids = [b.column(c) if rows is None else b.column(c).take(pa.array(rows, pa.int64())) for c in keep]
                new = [pa.array(columns[f.name], f.type) for f in list(arrow)[len(keep) :]]
                yield pa.RecordBatch.from_arrays([i.cast(f.type) for i, f in zip(ids, arrow, strict=False)] + new, schema=arrow)

    return df.mapInArrow(batches, out)


_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside, but for kept ones, are deleted at the end. Each thread has scopes of its own."""
    token = _scopes.set((*_scopes.get(), []))
    try:
        yield
    finally:
        done = _scopes.get()[-1]
        _scopes.reset(token)
        for path in done:
            _remove(spark, path)


def materialize(df: DataFrame, label: str, keep: bool = False, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there and survives lost executors.

    ``keep``: the table outlives the innermost ``scratch``; it then belongs to the one around it, if any.
    ``partition_by``: the last column, whose values become folders.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    scopes = _scopes.get()[:-1] if keep else _scopes.get()
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text"):
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

