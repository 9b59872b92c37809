"""What the operators share: columns by exact name, the shared folder, staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the space and U+0009 to U+000D.
SPACES = r"\x20\x09-\x0D"
#: A side of at most so many rows may be broadcast; callers count first.
BROADCAST_ROWS = 100_000


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed; names are matched exactly, so others that differ in case do no harm."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{names.index(source)}").alias(target) for target, source in columns.items()])


def plain(docs: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    """`docs` with columns _0, _1, ... in place of names that may clash, and its id; toDF(*docs.columns) names them again."""
    names = docs.columns
    return docs.toDF(*[f"_{i}" for i in range(len(names))]), F.col(f"_{names.index(id_col)}").cast("long")


def by_id(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """The rows of `docs`, all columns, whose id is among `ids` (one column; left_semi) or isn't (left_anti); null is an id like others."""
    rows, key = plain(docs, id_col)
    return rows.join(ids.toDF("__id"), key.eqNullSafe(F.col("__id")), how).toDF(*docs.columns)


def portions(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches in parts of at most so many rows, to hold less at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one is made where the session names none and runs in one process (local tests), on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(where)
    return where


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Arrow batches of at most so many rows in what runs inside, fewer if the session says so; None leaves them as they are."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not rows or 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and lost executors cost nothing.

    With `rows`, Arrow batches on the way have at most so many: where rows are whole texts,
    JVM and Python hold less at once.
    """
    path = f"{shared_dir(df.sparkSession)}/lectern/{name}-{uuid.uuid4().hex}"
    with arrow_rows(df.sparkSession, rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most `limit` rows, else left to the optimizer. Expects a staged table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def words(text: Column) -> Column:
    """The words of a text as an array; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")
