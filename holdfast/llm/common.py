"""Helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.stable import ensure_checkpoint_dir
from holdfast.session import tune

#: rows and bytes of one Arrow batch; keep a batch of very long texts inside a Python worker's memory
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20
#: code points that one vectorised step works on
BLOCK_CHARS = 4_000_000


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    """Adaptive execution as the library wants it, and Arrow batches that stay small when texts are long. Every operator
    of this package that runs Python sets this for its session."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that no working column can clash with a column of the input."""
    return F.struct(*[quoted(c) for c in df.columns])


def unpacked(df: DataFrame, columns: Iterable[str], own: dict[str, Column], row: str = "row") -> DataFrame:
    """The input's columns again, then the operator's own, which win over input columns of the same name."""
    taken = {c.lower() for c in own}
    kept = [F.col(row)[c].alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *[col.alias(name) for name, col in own.items()])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there: short lineage, columns prunable."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with their texts (null: empty) of about ``limit`` code points, at least one row each."""
    texts = [x or "" for x in batch.column(text).to_pylist()]
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents no model may learn labels from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))
