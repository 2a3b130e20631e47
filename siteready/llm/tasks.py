"""What the operators share: slice-wise Arrow functions, tables in the cluster's shared folder, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteready.llm.words import SLICE_BYTES, slices
from siteready.session import shared_dir

#: Rows of at most three longs that may be broadcast: 24 MB. Larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder of the shared checkpoint folder and read again: later steps start there, also after
    an executor is lost. The folder is left to whoever clears spark.checkpoint.dir, as the result may be read late."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the counted rows are within BROADCAST_ROWS; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def remainder(column: Column, by: int) -> Column:
    """crc32 of a number as decimal text, modulo ``by``; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % by


def map_slices(df: DataFrame, text: str, keep: Sequence[str], added: str,
               make: Callable[[], Callable[[pa.Array], list]], limit: int = SLICE_BYTES) -> DataFrame:
    """``keep`` columns as they are, and ``added`` ones that a function computes from slices of the text column.

    ``make`` runs once in each task and gives that function: a string array to one list or Arrow array for each added
    column. Columns of df outside ``keep`` never reach Python; a kept name that is also added gives way.
    """
    fields = T._parse_datatype_string(added)
    keep = [k for k in keep if k not in fields.names]
    source = df.select(F.col(text).alias("__text"), *keep)
    schema = T.StructType([*(source.schema[k] for k in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made, target = make(), to_arrow_schema(schema)
        for batch in batches:
            column = batch.column(0)
            for start, stop in slices(column, limit):
                part = batch.slice(start, stop - start)
                new = [x if isinstance(x, pa.Array) else pa.array(x, f.type)
                       for x, f in zip(made(part.column(0)), list(target)[len(keep):], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], names=schema.names)

    return source.mapInArrow(run, schema)


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
