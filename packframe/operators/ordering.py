"""Order over partitions: numbering rows, and carrying values forward, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from packframe.streaming.storage import stored

#: Bits of monotonically_increasing_id() that count rows inside a partition (fixed by Spark).
_ROW_BITS = 33
#: Places of one task of carry_last().
BUCKET = 1 << 20


def with_row_index(df: DataFrame, *order: str | Column, index: str = "_row") -> DataFrame:
    """Adds the 0-based place of each row in the order given.

    Rows are range-partitioned and sorted, and written to the shared folder once, with their partition and their place in
    it: bounds of a range partitioning are sampled anew each time it is computed, so counts have to come from the rows
    that were written.  What is summed up over partitions is one count for each.  Rows that are equal in `order` may
    come in any order; an empty table stays empty; columns of any name but `_packframe_*` are kept."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    void = {f.name for f in df.schema.fields if isinstance(f.dataType, NullType)}  # has no form in a file, and needs none
    split = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()
    placed = stored(split.select(*(f"`{c}`" for c in df.columns if c not in void), F.shiftright(number, _ROW_BITS).cast("int").alias("_packframe_part"), number.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_packframe_place")), "ordered")
    counts = placed.groupBy("_packframe_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_packframe_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_packframe_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_packframe_before"))  # a row a partition
    joined = placed.join(F.broadcast(offsets), "_packframe_part")
    kept = (F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns)
    return joined.select(*kept, (F.col("_packframe_before") + F.col("_packframe_place")).alias(index))


def carry_last(df: DataFrame, values: dict[str, Column], pos: str = "pos", bucket: int = BUCKET) -> DataFrame:
    """Adds for each name the last of its values that isn't null at or before each row, in the order of `pos` (long, unique).

    Windows are over runs of `bucket` places; from one run to the next goes one value of each."""
    cut = df.select("*", F.floor(F.col(pos) / bucket).alias("_packframe_run"), *(v.alias(f"_packframe_{n}") for n, v in values.items()))
    inside = Window.partitionBy("_packframe_run").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_packframe_run").rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.max_by(f"_packframe_{n}", F.when(F.col(f"_packframe_{n}").isNotNull(), F.col(pos))).alias(f"_packframe_end_{n}") for n in values]
    runs = cut.groupBy("_packframe_run").agg(*ends)  # a row a run
    carried = runs.select("_packframe_run", *(F.last(f"_packframe_end_{n}", ignorenulls=True).over(before).alias(f"_packframe_before_{n}") for n in values))
    found = cut.withColumns({f"_packframe_last_{n}": F.last(f"_packframe_{n}", ignorenulls=True).over(inside) for n in values}).join(carried, "_packframe_run")
    return found.select(*(f"`{c}`" for c in df.columns), *(F.coalesce(f"_packframe_last_{n}", f"_packframe_before_{n}").alias(n) for n in values))
