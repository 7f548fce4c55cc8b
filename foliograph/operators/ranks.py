"""Ordered computations over groups of any size.

A plain window sorts a whole group in one task. Here a group is cut into blocks that
follow its order: each block is worked on alone, the per-block totals are accumulated
over the (small) table of blocks, and the two are put together. One hot group then
spreads over as many tasks as it has blocks.

``block`` columns must be a monotone function of the order: if row a comes before row b,
then a's block does not come after b's. Give them where the order is a dense number or a
time; without them the rows are range-partitioned by keys and order and the partition
number, frozen by writing it out, is the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliograph.session import per_key, settle

BLOCK_ROWS = 65_536


def seq_block(order: Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number for a whole-number order such as a line or object number."""
    return F.floor(order / rows)


def time_block(order: Column, seconds: int = 3600) -> Column:
    return F.floor(F.unix_seconds(order.cast("timestamp")) / seconds)


def _cut(df: DataFrame, keys: list[str], order: list, block: list[Column] | None) -> tuple[DataFrame, list[str]]:
    """Add the block columns and ``_key``, the keys as one struct.

    A struct is never NULL and equals another one with the same NULLs in it, so join and
    window below can use the same columns and share one shuffle of the rows.
    """
    keyed = df.withColumn("_key", F.struct(*keys))
    if block is None:
        ranged = keyed.repartitionByRange("_key", *order)
        return settle(ranged.withColumn("_block0", F.spark_partition_id())), ["_key", "_block0"]
    names = [f"_block{i}" for i in range(len(block))]
    return keyed.withColumns(dict(zip(names, block))), ["_key", *names]


def _with_carry(df: DataFrame, names: list[str], total: Column, running) -> DataFrame:
    """Join each row with ``running(total)`` over the blocks before its own as ``_carry``."""
    key, *places = names
    before = Window.partitionBy(key).orderBy(*places).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*names).agg(total.alias("_total"))
    return df.join(blocks.select(*names, running("_total").over(before).alias("_carry")), names, "left")


def ordinals(
    df: DataFrame,
    keys: list[str],
    order: list,
    block: list[Column] | None = None,
    name: str = "ordinal",
    most: int = BLOCK_ROWS,
) -> DataFrame:
    """1-based position of each row within its keys.

    Without ``block`` the keys are counted first. Keys of at most ``most`` rows are ranked by one
    hash shuffle; only the rows of larger ones are cut into blocks. Both ways give the same positions.
    """
    if block is None:
        counts = per_key(df.withColumn("_key", F.struct(*keys)), ["_key"], F.count(F.lit(1)).alias("_n"))
        hot = settle(counts.filter(F.col("_n") > most).select("_key"))
        inside = Window.partitionBy(*keys).orderBy(*order)
        place = F.row_number().over(inside).cast("bigint")
        if hot.isEmpty():
            return df.withColumn(name, place)
        keyed = df.withColumn("_key", F.struct(*keys))
        cold = keyed.join(hot, "_key", "left_anti").drop("_key").withColumn(name, place)
        large = keyed.join(hot, "_key", "left_semi").drop("_key")
        return cold.unionByName(_block_ordinals(large, keys, order, None, name))
    return _block_ordinals(df, keys, order, block, name)


def _block_ordinals(df: DataFrame, keys: list[str], order: list, block: list[Column] | None, name: str) -> DataFrame:
    cut, names = _cut(df, keys, order, block)
    carried = _with_carry(cut, names, F.count(F.lit(1)), F.sum)
    inside = Window.partitionBy(*names).orderBy(*order)
    place = F.coalesce("_carry", F.lit(0)) + F.row_number().over(inside)
    return carried.withColumn(name, place.cast("bigint")).drop("_carry", *names)


def sum_before(
    df: DataFrame, keys: list[str], order: list, block: list[Column] | None, value: str, name: str
) -> DataFrame:
    """Sum of ``value`` over the rows that come before each one."""
    cut, names = _cut(df, keys, order, block)
    carried = _with_carry(cut, names, F.sum(value), F.sum)
    inside = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce("_carry", F.lit(0)) + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return carried.withColumn(name, total.cast("bigint")).drop("_carry", *names)


def running_max(
    df: DataFrame, keys: list[str], order: list, block: list[Column] | None, value: Column, name: str
) -> DataFrame:
    """Maximum of ``value`` over the rows up to and including each one."""
    cut, names = _cut(df.withColumn("_value", value), keys, order, block)
    carried = _with_carry(cut, names, F.max("_value"), F.max)
    inside = (
        Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    best = F.greatest("_carry", F.max("_value").over(inside))
    return carried.withColumn(name, best).drop("_carry", "_value", *names)


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int, spread: int = 32) -> DataFrame:
    """The last ``n`` rows per key, with ``tail_pos`` counting back from the end.

    The first ranking runs per key and salt, and Spark limits each map task to n rows per
    key and salt before the shuffle; the second one sees at most ``spread * n`` rows per key.
    """
    newest = [F.col(c).desc() for c in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(spread)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*newest)
    final = Window.partitionBy(*keys).orderBy(*newest)
    kept = salted.withColumn("_near", F.row_number().over(first)).filter(F.col("_near") <= n)
    ranked = kept.drop("_near", "_salt").withColumn("tail_pos", F.row_number().over(final))
    return ranked.filter(F.col("tail_pos") <= n)
