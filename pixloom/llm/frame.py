"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom.session import shared_dir

SLICE_BYTES = 4 << 20
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the columns whose names an operator is about to add, in any case."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def append_columns(
    df: DataFrame,
    fields: Sequence[T.StructField],
    make: Callable[[pa.RecordBatch], list[pa.Array]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """Add columns made from Arrow batches; columns of the same names are replaced."""
    df = without(df, [f.name for f in fields])
    names = [c for c in df.columns if c not in drop]
    schema = T.StructType([df.schema[c] for c in names] + list(fields))

    def run(batches):
        for batch in batches:
            # slices of a few megabytes, so that what a task holds does not depend on the batch
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + make(part), names=schema.names)

    return df.mapInArrow(run, schema)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that all executors share and read again: a cut that survives lost executors.

    The shuffle files of the write, which nothing else reads, go once it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def lists(values, lengths, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
