"""Order within a scope: ranks of large scopes, and rules that are a sequence (rows in order, a state per scope, one decision per row)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import checkpoint


def in_sequence(rows: DataFrame, scope: str, order: str, columns: list[str], state: Callable[[], Any], decide: Callable[[Any, dict], tuple], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """``decide(state, row)`` for the rows of each ``scope`` in ``order``, each scope with a new ``state()``.

    The rows of a scope are sorted by Spark (which spills) and pass through one task batch by batch; no scope
    is ever held as a whole, only its state is. Rows with a null order are left out; a null scope is one of its own.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[scope] != at or current is None:
                    at, current = row[scope], state()
                out.append(decide(current, row))
            columns_ = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, kinds)], names)

    ready = rows.where(F.col(order).isNotNull()).select(*columns)
    return ready.repartition(scope).sortWithinPartitions(scope, order).mapInArrow(run, schema)


def ranked(rows: DataFrame, scope: str, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with the place of each row in its scope, from 1, as a bigint; a null scope is one of its own.

    Rows are divided into ranges of the order over all scopes, numbered within each range, and moved on by what the
    scope has in the ranges before. So a scope with most of the rows is spread over many tasks. Rows that are equal
    in ``order`` are numbered in any order.
    """
    parts = checkpoint(rows.repartitionByRange(F.col(scope).asc_nulls_first(), *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(scope, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col(scope).alias("_scope"), F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    placed = parts.withColumn(name, F.row_number().over(Window.partitionBy(scope, "_part").orderBy(*order)))
    placed = placed.join(offsets, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("_part") == F.col("_of")))
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_n", "_scope", "_of", "_before")
