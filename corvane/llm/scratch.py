"""Keys of rows and small tables; intermediate tables live in corvane.sources.shared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.shared import made, materialize, purge, scratch_path

__all__ = ["made", "materialize", "purge", "row_keys", "scratch_path", "small_table"]


def row_keys(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """(rows, key column): docs and id_col where its ids are unique and not null, which reads that column alone.

    Otherwise docs written to the shared folder with a number for each row, in the column _row.
    """
    odd = docs.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("k")).filter("k > 1 or id is null")
    if odd.isEmpty():
        return docs, id_col
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows"), "_row"


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table out of literals, without Python on the executors; schema: name type, name type."""
    fields = [c.split() for c in schema.split(", ")]
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in fields))
    value = lambda v, kind: (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(kind)
    made = F.array(*(F.struct(*(value(v, kind).alias(name) for v, (name, kind) in zip(row, fields, strict=True))) for row in rows))
    return spark.range(1).select(F.inline(made))
