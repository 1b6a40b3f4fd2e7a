"""Helpers shared by the corpus operators: Arrow mapping and reliable checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from credence.session import checkpointed, shared_folder, ship_code  # noqa: F401

#: Rows and bytes of one Arrow batch; what a Python worker holds at a time follows from these.
BATCH_ROWS = 10_000
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Prepare a session for Python workers: they can import this package, and their Arrow batches
    are bounded, so that long texts do not add up."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(
    df: DataFrame,
    columns: list[str],
    schema: str | T.StructType,
    rows: Callable[..., list[tuple]],
) -> DataFrame:
    """Apply ``rows(*column_lists) -> list of tuples`` to each Arrow batch of ``columns``.

    The column lists hold Python values; the function may return any number of rows.
    """
    bounded_batches(df.sparkSession)
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = rows(*(c.to_pylist() for c in batch.columns))
            if got:
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow
                )

    return df.select(*[F.col(c) if isinstance(c, str) else c for c in columns]).mapInArrow(run, out)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it from there; unlike a
    checkpoint, later jobs read only the columns they use."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
