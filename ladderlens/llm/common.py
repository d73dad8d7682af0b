"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ladderlens.tables import folder

#: Rows of a table that may be broadcast, once they have been counted.
BROADCAST_ROWS = 1_000_000
#: Whether the shuffle files of a job are deleted at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each open scope, the folders written in it.
_written: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, else one below its warehouse, unless that is on the driver's own disk."""
    return folder(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage: the work behind df runs once, and what it made
    outlives any executor.  The table stays until its scope ends (``scope``),
    or until the folder is cleared.  The shuffle files of the work go as soon
    as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before else spark.conf.unset(CLEAN_UP)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete folders of the shared store."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are materialized within it are deleted at its end; take a path off the list to keep it."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        remove(spark, _written.pop())


def hand_on(path: str) -> None:
    """Let a path outlive the innermost scope; it belongs to the one around it, if any."""
    if len(_written) > 1:
        _written[-2].append(path)


def with_few(df: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with a written table that should be small: broadcast if its rows, counted first, are few, else by Spark's choice."""
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, how)


def named(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


#: The input columns of a batch -> values by derived column, and the row that each belongs to (None: one for each row, in order).
Derive = Callable[[list[pa.Array]], tuple[dict[str, Sequence], Sequence[int] | None]]


def beside(df: DataFrame, keep: Sequence[str], inputs: Sequence[str], derived: StructType | str, start: Callable[[], Derive], at_once: int = 1 << 30) -> DataFrame:
    """The columns in keep, with what a function derives from the input columns of each batch, of at_once rows at most.

    Kept columns pass through as Arrow arrays: no value, null or type of theirs
    is changed.  start is called once a task and gives the function.
    """
    keep, sent = list(keep), list(dict.fromkeys([*keep, *inputs]))
    places = [sent.index(c) for c in inputs]
    columns = [named(c).alias(f"c{i}") for i, c in enumerate(sent)]
    derived = StructType.fromDDL(derived) if isinstance(derived, str) else derived
    schema = StructType([StructField(c, df.schema[c].dataType, True) for c in keep] + derived.fields)
    types = {f.name: to_arrow_type(f.dataType) for f in derived}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        derive = start()
        for batch in (b.slice(at, at_once) for b in batches for at in range(0, b.num_rows, at_once)):
            values, rows = derive([batch.column(i) for i in places])
            kept = [batch.column(i) for i in range(len(keep))]
            if rows is not None:
                at = pa.array(np.asarray(rows, np.int64))
                kept = [k.take(at) for k in kept]
            made = [v if isinstance(v := values[name], pa.Array) else pa.array(v, kind, from_pandas=False) for name, kind in types.items()]
            yield pa.RecordBatch.from_arrays(kept + made, names=[*keep, *types])

    return df.select(*columns).mapInArrow(run, schema)


def each(text: pa.Array) -> Iterator[str | None]:
    """The values of a column of texts, one at a time."""
    return (value.as_py() for value in text)


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n (null stays null)."""
    return F.crc32(doc_id.cast("string")) % n


def id_crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
