"""Running totals over a whole table in the order of some columns, group by group, without a window over a whole group.

Rows are sorted into ranges of (group, order), so a hot group lies in many partitions. Each task adds up inside its own range; one row for each
range and group (as many as ranges and groups together) then says what came before. Rows that are alike in all columns would meet in one range,
so their place in the written input parts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burncal.llm.common import cut, small_batches


def _inside(batches: Iterator[pa.RecordBatch], group: str, size: str | None) -> Iterator[pa.RecordBatch]:
    """Adds `inside`: what the rows of the group before this one in the partition add up to."""
    at, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = pc.dictionary_encode(batch.column(group))
        code = groups.indices.to_numpy(zero_copy_only=False)
        sizes = np.ones(len(code), np.int64) if size is None else batch.column(size).to_numpy(zero_copy_only=False)
        before = np.cumsum(sizes) - sizes
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))  # groups are runs
        own = before - np.repeat(before[first], np.diff(np.append(first, len(code))))
        names = groups.dictionary.to_pylist()
        if names[code[0]] == at:
            own[: first[1] if len(first) > 1 else None] += total
        at, total = names[code[-1]], int(own[-1] + sizes[-1])
        yield batch.append_column("inside", pa.array(own))


def running(rows: DataFrame, group: str, order: list[str], size: str | None = None) -> DataFrame:
    """The rows with `before`, how much (the sum of a long column, or the number of rows) the rows of the same group before them have, nulls of
    the order first, and `total`, how much the group has. `group` is a string without nulls; rows have to come from a written table or a checkpoint, as their place in it parts equal rows."""
    small_batches(rows.sparkSession, 8192)
    placed = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [group, *order, "tie"]
    dealt = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes) + ", inside long"
    summed = cut(dealt.mapInArrow(lambda batches: _inside(batches, group, size), schema))
    sizes = summed.groupBy(group, "part").agg((F.count(F.lit(1)) if size is None else F.sum(size)).alias("own"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select(group, "part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset"), F.sum("own").over(Window.partitionBy(group)).alias("total"))
    return summed.join(offsets, [group, "part"]).withColumn("before", F.col("offset") + F.col("inside")).drop("part", "inside", "offset", "tie")
