"""Ordered work on groups of any size.

A window over (key) puts a whole key into one task. Here a key is cut into spans of its order
column, a window runs inside each span, and what a span needs from earlier ones (a few numbers per
span) is carried over by a join with the small table of span ends. A key that holds a third of all
rows is then spread over as many tasks as it has spans, and no row is lost or moved twice.

The order column must be an integer from 0 up, and unique inside a key. When the caller knows a bound on
it (a run's frame total, say) that fits one span, there is nothing to carry and a single window is
planned.
"""

from pyspark.sql import Window, functions as F

SPAN_BITS = 22
_SPAN = "_span"


def span_of(order, bits=SPAN_BITS):
    return F.shiftright(F.col(order).cast("bigint"), bits)


def fits(bound, bits=SPAN_BITS):
    """True when no order value reaches the end of the first span."""
    return bound is not None and 0 <= bound < (1 << bits)


def running(df, keys, order, sums, bits=SPAN_BITS, bound=None):
    """Inclusive running sums of `sums` = {new column: BIGINT expression} along `order`."""
    keys = list(keys)
    names = list(sums)
    if fits(bound, bits):
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *(
            F.sum(sums[n].cast("bigint")).over(whole).alias(n) for n in names))
    source = df.withColumn(_SPAN, span_of(order, bits))
    inside = Window.partitionBy(*keys, _SPAN).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = source.select(
        "*", *(F.sum(sums[n].cast("bigint")).over(inside).alias(f"_in_{n}") for n in names))

    # Only spans after a key's first one have something to carry, so this side is usually empty.
    totals = source.groupBy(*keys, _SPAN).agg(
        *(F.sum(sums[n].cast("bigint")).alias(f"_total_{n}") for n in names))
    earlier = Window.partitionBy(*keys).orderBy(_SPAN).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.select(*keys, _SPAN, *(
            F.sum(f"_total_{n}").over(earlier).alias(f"_carry_{n}") for n in names),
            F.count(F.lit(1)).over(earlier).alias("_seen"))
        .filter("_seen > 0").drop("_seen")
    )
    joined = rows.join(carry, [*keys, _SPAN], "left")
    return joined.select(
        *(F.col(c) for c in df.columns),
        *((F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_carry_{n}", F.lit(0))).alias(n)
          for n in names))


def numbered(df, keys, order, name, bits=SPAN_BITS, bound=None):
    """1, 2, 3, ... along `order` inside each key."""
    return running(df, keys, order, {name: F.lit(1)}, bits, bound)


def with_trailing(df, keys, order, depth, build, bits=SPAN_BITS, bound=None):
    """Columns that look back over at most `depth` earlier rows of the same key.

    `build(window)` returns {new column: expression over window}. Rows are numbered first; then
    every bucket of row numbers also receives the last `depth` rows of the bucket before it, so
    looking back never leaves the bucket.
    """
    keys = list(keys)
    if fits(bound, bits):
        whole = Window.partitionBy(*keys).orderBy(order)
        return df.select("*", *(expr.alias(n) for n, expr in build(whole).items()))
    size = 1 << bits
    if depth >= size:
        raise ValueError("depth must be smaller than a bucket")
    rows = numbered(df, keys, order, "_rn", bits)
    own = F.shiftright("_rn", bits)
    to_next = (size - F.pmod(F.col("_rn"), F.lit(size))) <= depth
    placed = rows.select("*", F.explode(
        F.when(to_next, F.array(own, own + 1)).otherwise(F.array(own))).alias(_SPAN))
    window = Window.partitionBy(*keys, _SPAN).orderBy("_rn")
    built = placed.select("*", *(expr.alias(n) for n, expr in build(window).items()))
    return built.filter(F.col(_SPAN) == own).drop("_rn", _SPAN)
