"""Global order without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task.  The
helpers here get exact global running sums / row numbers the distributed way, at
every size:

1. bounds of contiguous ranges are chosen once, from a bounded draw of the order
   keys (the rows of least key hash, so the draw is the same on every run; each task
   keeps no more of them than the whole draw),
2. each row finds its range by a binary search over the bounds, literal arrays that one
   small expression looks into.  The assignment depends on the row alone, so it may be
   recomputed after an executor loss and needs no checkpoint; a unique tie-breaker in
   the order lets a hot value spread over many ranges,
3. running sums inside each range (a window partitioned by range id),
4. one total per range (their number is a parameter), turned into offsets and
   broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRAW_PER_RANGE = 64
MAX_RANGES = 512


def _flags(order: list[str], descending: list[bool] | bool) -> list[bool]:
    return [descending] * len(order) if isinstance(descending, bool) else list(descending)


def _order_exprs(order: list[str], flags: list[bool]) -> list[Column]:
    return [F.col(f"`{c}`").desc_nulls_last() if d else F.col(f"`{c}`").asc_nulls_first()
            for c, d in zip(order, flags)]


def _behind(bound: dict[str, Column], order: list[str], flags: list[bool]) -> Column:
    """Whether a row sorts behind ``bound`` (a value per order column)."""
    out = F.lit(False)
    for c, desc in reversed(list(zip(order, flags))):
        v, b = F.col(f"`{c}`"), bound[c]
        if desc:                       # nulls last
            past = F.when(b.isNull(), F.lit(False)).otherwise(F.coalesce(v < b, F.lit(True)))
        else:                          # nulls first
            past = F.when(b.isNull(), v.isNotNull()).otherwise(F.coalesce(v > b, F.lit(False)))
        out = past | (v.eqNullSafe(b) & out)
    return out


def range_bounds(df: DataFrame, order: list[str], descending: list[bool] | bool = False,
                 ranges: int | None = None) -> list[tuple]:
    """At most ``ranges - 1`` keys that cut the order into near-equal ranges.

    About ``DRAW_PER_RANGE`` keys a range reach the driver, whatever the row count.
    """
    spark = df.sparkSession
    flags = _flags(order, descending)
    if ranges is None:
        ranges = min(MAX_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if ranges < 2:
        return []
    keys = df.select(*[F.col(f"`{c}`") for c in order])
    drawn = keys.orderBy(F.xxhash64(*keys.columns), *order).limit(ranges * DRAW_PER_RANGE) \
        .sortWithinPartitions(*_order_exprs(order, flags)).collect()      # one partition
    step = len(drawn) / ranges
    out: list[tuple] = []
    for i in range(1, ranges):
        at = int(i * step)
        if 0 < at < len(drawn) and (not out or tuple(drawn[at]) != out[-1]):
            out.append(tuple(drawn[at]))
    return out


def range_id(df: DataFrame, bounds: list[tuple], order: list[str],
             descending: list[bool] | bool = False) -> Column:
    """Number of the range a row falls in: how many bounds it sorts behind.

    A binary search over one literal array per order column.  The expression holds the comparison
    once, however many bounds there are.
    """
    if not bounds:
        return F.lit(0)
    flags = _flags(order, descending)
    arrays = {c: F.array(*[F.lit(b[i]).cast(df.schema[c].dataType) for b in bounds])
              for i, c in enumerate(order)}

    def step(at: Column, width: Column) -> Column:
        upto = at + width
        bound = {c: F.get(a, upto - 1) for c, a in arrays.items()}
        return F.when((upto <= len(bounds)) & _behind(bound, order, flags), upto).otherwise(at)

    widths = [F.lit(1 << digit) for digit in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*widths), F.lit(0), step)


def ordered_cumsum(df: DataFrame, order: list[str], sums: dict[str, str],
                   descending: list[bool] | bool = False,
                   ranges: int | None = None) -> DataFrame:
    """Inclusive running sums in a total order.

    ``sums`` maps output column -> input column.  The order must be total
    (unique) for the running sums to be deterministic.
    """
    bounds = range_bounds(df, order, descending, ranges)
    ranged = df.withColumn("_range_id", range_id(df, bounds, order, descending))
    w = Window.partitionBy("_range_id").orderBy(
        *_order_exprs(order, _flags(order, descending))).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_loc_{o}": F.sum(F.col(f"`{i}`")).over(w)
                                for o, i in sums.items()})
    totals = ranged.groupBy("_range_id").agg(
        *[F.sum(F.col(f"`{i}`")).alias(f"_tot_{o}") for o, i in sums.items()])
    # one row per range: a single-partition window over them is fine
    before = Window.orderBy("_range_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range_id", *[
        F.coalesce(F.sum(f"_tot_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in sums])
    out = local.join(F.broadcast(offsets), "_range_id")
    out = out.withColumns({o: F.col(f"_loc_{o}") + F.col(f"_off_{o}") for o in sums})
    return out.drop("_range_id", *[f"_loc_{o}" for o in sums], *[f"_off_{o}" for o in sums])


def global_row_number(df: DataFrame, order: list[str], name: str = "row_num",
                      descending: list[bool] | bool = False) -> DataFrame:
    """1-based row number in a total order (include a unique key in ``order``)."""
    one = "_one_for_rownum"
    out = ordered_cumsum(df.withColumn(one, F.lit(1).cast("long")), order, {name: one}, descending)
    return out.drop(one)


def key_number(df: DataFrame, key: str) -> Column:
    """A whole number for a key of any type: itself, or 52 bits of the MD5 of its text.

    The digest is the same in any engine, so hashes built on it are too.
    """
    c = F.col(f"`{key}`")
    if isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 13), 16, 10).cast("long")
