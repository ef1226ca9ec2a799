"""Global positions and running sums without a window over everything.

A global ``row_number`` in Spark (``Window.orderBy`` with no partition) moves every row into one
task. Here rows are dealt by range into *blocks*, in order, and written, which pins each row's block and its
place in it. Blocks follow the number of partitions, not the values of the order, so ids may have any gaps.
What lies before a block is the sum of the totals of the blocks before it, scanned in tree levels:
within groups of ``FAN`` blocks, then over the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunedata.operators.keyfilter import written

#: Blocks per group of a scan level: rows that one task of its window sorts, at most.
FAN = 256
#: Block tables of up to this many rows (one per partition) are broadcast; larger ones are joined.
BROADCAST_BLOCKS = 1 << 14
_PLACE_BITS = 33  # monotonically_increasing_id: partition above, place in it below


def _scan(totals: DataFrame, names: list[str], n_blocks: int) -> DataFrame:
    """``_blk`` and, for each name, ``_o_<name>``: its sum over all blocks before."""
    before = Window.partitionBy("_grp").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    grouped = totals.withColumn("_grp", F.floor(F.col("_blk") / FAN).cast("bigint"))
    local = grouped.select("_blk", "_grp", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    if n_blocks <= FAN:
        return local.drop("_grp")
    above = grouped.groupBy("_grp").agg(*[F.sum(n).alias(n) for n in names]).withColumnRenamed("_grp", "_blk")
    above = _scan(above, names, -(-n_blocks // FAN))
    above = above.select(F.col("_blk").alias("_grp"), *[F.col(f"_o_{n}").alias(f"_u_{n}") for n in names])
    return local.join(above, "_grp").select("_blk", *[(F.col(f"_o_{n}") + F.col(f"_u_{n}")).alias(f"_o_{n}") for n in names])


def _join_blocks(rows: DataFrame, offsets: DataFrame, n_blocks: int) -> DataFrame:
    return rows.join(F.broadcast(offsets) if n_blocks <= BROADCAST_BLOCKS else offsets, "_blk")


def _in_blocks(df: DataFrame, order: list[str | Column]) -> tuple[DataFrame, int]:
    """``df`` in ordered blocks: ``_blk`` and ``_at``, which rises with the order over the whole table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealing by range reads its input twice (once to sample the bounds): what makes the rows runs once.
    ranged = written(df, "unordered").repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return written(ranged, "ordered").withColumn("_blk", F.shiftright("_at", _PLACE_BITS)), n


def global_positions(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """Adds ``name`` = 1-based position in ``order`` (which must be unique). No window sees the rows:
    the place within a block was fixed when it was written sorted."""
    rows, n = _in_blocks(df, order)
    offsets = _scan(rows.groupBy("_blk").agg(F.count(F.lit(1)).alias("cnt")), ["cnt"], n)
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return _join_blocks(rows, offsets, n).withColumn(name, F.col("_o_cnt") + place + 1).drop("_blk", "_at", "_o_cnt")


def hash_prefix_block(hex_key: str | Column, digits: int = 3) -> Column:
    """Block of a hex hash key: its first ``digits`` hex characters (16**digits blocks)."""
    c = F.col(hex_key) if isinstance(hex_key, str) else hex_key
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("bigint")


def positions_by_block(df: DataFrame, block: Column, order: list[str | Column], n_blocks: int,
                       name: str = "pos") -> DataFrame:
    """Adds ``name`` = 1-based position in ``order``, whose blocks are known beforehand: ``block`` is
    monotonic in the order, from 0 to ``n_blocks - 1``, and even, as hash prefixes are."""
    rows = df.withColumn("_blk", block)
    offsets = _scan(rows.groupBy("_blk").agg(F.count(F.lit(1)).alias("cnt")), ["cnt"], n_blocks)
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_blk").orderBy(*order)))
    return (_join_blocks(rows, offsets, n_blocks)
            .withColumn(name, (F.col("_o_cnt") + F.col("_rn")).cast("bigint")).drop("_blk", "_rn", "_o_cnt"))


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, Column], pos: str = "pos") -> DataFrame:
    """Position and running sums in ``order`` (unique), inclusive of the current row: each block
    runs its own window, shifted by what lies before it."""
    names = list(sums)
    rows, n = _in_blocks(df.select("*", *[c.alias(f"_v_{k}") for k, c in sums.items()]), order)
    totals = rows.groupBy("_blk").agg(F.count(F.lit(1)).alias("_cnt"), *[F.sum(f"_v_{k}").alias(k) for k in names])
    offsets = _scan(totals.fillna(0, names), ["_cnt", *names], n)
    local = Window.partitionBy("_blk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    out = rows.select("*", *[F.coalesce(F.sum(f"_v_{k}").over(local), F.lit(0)).alias(f"_c_{k}") for k in names])
    out = _join_blocks(out, offsets, n).withColumn(pos, F.col("_o__cnt") + place + 1)
    for k in names:
        out = out.withColumn(k, F.col(f"_o_{k}") + F.col(f"_c_{k}"))
    return out.drop("_blk", "_at", "_o__cnt", *[f"_{p}_{k}" for k in names for p in ("v", "o", "c")])


def _last_before(ends: DataFrame, n_blocks: int) -> DataFrame:
    """``_blk, _p``: the ``_end`` of the nearest block before that has one; the same tree as ``_scan``."""
    grouped = ends.withColumn("_grp", F.floor(F.col("_blk") / FAN).cast("bigint"))
    local = grouped.select("_blk", "_grp", F.lag("_end").over(Window.partitionBy("_grp").orderBy("_blk")).alias("_p"))
    if n_blocks <= FAN:
        return local.drop("_grp")
    above = _last_before(grouped.groupBy("_grp").agg(F.max_by("_end", "_blk").alias("_end")).withColumnRenamed("_grp", "_blk"), -(-n_blocks // FAN))
    above = above.select(F.col("_blk").alias("_grp"), F.col("_p").alias("_q"))
    return local.join(above, "_grp").select("_blk", F.coalesce("_p", "_q").alias("_p"))


def with_previous(df: DataFrame, order: list[str], cols: list[str], prefix: str = "prev_") -> DataFrame:
    """Adds ``prefix + c`` for each of ``cols``: its value in the row before in ``order``, null in the first
    row. ``lag`` runs within a block; a block's first row takes the last one of the block before."""
    rows, n = _in_blocks(df, [F.col(c).asc() for c in order])
    rows = rows.select("*", F.struct(*[F.col(c).alias(prefix + c) for c in cols]).alias("_me"))
    before = _last_before(rows.groupBy("_blk").agg(F.max_by("_me", "_at").alias("_end")), n)
    rows = rows.select("*", F.lag("_me").over(Window.partitionBy("_blk").orderBy("_at")).alias("_l"))
    return _join_blocks(rows, before, n).select(*df.columns, F.coalesce("_l", "_p").alias("_l")).select(*df.columns, "_l.*")
