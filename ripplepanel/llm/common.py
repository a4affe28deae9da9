"""What the text operators share: input columns, held-out rows, words, and batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplepanel.session import cut

#: Words are runs of anything but blank, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of text a task handles at once where it builds arrays over them.
CHUNK_CHARS = 2_000_000


def texts(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and the text (null: empty); other columns, whatever their names, are left out."""
    return docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text"))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a row without id is held out."""
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
    return F.coalesce(rest == 0, F.lit(True))


def share(rows: int, per_group: int) -> int:
    """How many groups of about ``per_group`` rows hold ``rows``; at least one."""
    return max(1, -(-rows // per_group))


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts add up to about ``most`` bytes; one long text may be a slice of its own."""
    start, size = 0, 0
    lengths = [0 if v is None else v for v in pa.compute.binary_length(batch.column(column)).to_pylist()]
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


@contextmanager
def _shuffles_released(spark: SparkSession):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_clean(df: DataFrame, tag: str) -> DataFrame:
    """``cut``, and the shuffle files behind it go once the table is written: what follows reads the table only."""
    with _shuffles_released(df.sparkSession):
        return cut(df, tag)
