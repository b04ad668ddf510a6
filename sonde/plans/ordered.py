"""Ordered (window-like) computations that never gather a whole group in one task.

A plain `Window.partitionBy(run).orderBy(seq)` sends every row of a run to one task; a run
that holds a third of the data would then decide the job's run time.  Here a group is cut
into blocks along its own order.  Windows run inside (group, block); each block leaves one
summary row; the summaries, thousands of times fewer, are scanned per group and joined back
as the value carried into the block.  The result equals the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16


def row_blocks(column: str, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a dense order column (line number, stream sequence)."""
    return F.expr(f"cast({column} div {rows} as bigint)")


def span_blocks(column: str, span: float) -> Column:
    """Block number of a sparse order column (time), `span` units per block."""
    return F.floor(F.col(column) / F.lit(span)).cast("bigint")


def depth_blocks(df: DataFrame, keys: Sequence[str], column: str, rows: int = BLOCK_ROWS, name: str = "depth_block") -> DataFrame:
    """`df` with `name`: blocks along `column` of about `rows` rows, however dense or sparse its values lie.

    A group is cut into as many equal spans as it needs blocks, from its exact count, least and greatest value; each
    span is then cut again by its own.  A minute that holds all rows of a year thus becomes many blocks, and sparse
    numbers do not become blocks of one row.  Rows of one value stay together.  Numbers depend on the rows alone, so
    a plan that computes them twice gets the same ones.  Keys and column must not be null.
    """
    v, low, high = F.col(column), F.col("__low"), F.col("__high")
    cells = F.ceil(F.col("__n") / F.lit(rows))
    inside = F.floor((v - low).cast("double") * cells / (high - low).cast("double"))
    at = F.when(high > low, F.least(inside, cells - 1)).otherwise(F.lit(0)).cast("bigint")
    out, known = df.withColumn(name, F.lit(0).cast("bigint")), [*keys, name]
    for _ in range(2):
        stats = out.groupBy(*known).agg(F.min(column).alias("__low"), F.max(column).alias("__high"), F.count(F.lit(1)).alias("__n"))
        out = out.join(stats, known).select(*df.columns, (F.col(name) * F.lit(1 << 31) + at).alias(name))
    return out


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    prior_max: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per `keys`, ordered by `order` (ascending, unique per group).

    sums       inclusive running sum (null counts as 0)
    prior_max  maximum over all earlier rows, null before the first non-null value
    lags       value of the row just before, null on the first row

    `block` must not decrease along `order`, and key columns must not be null.
    """
    sums, prior_max, lags = dict(sums or {}), dict(prior_max or {}), dict(lags or {})
    values = [
        *(F.coalesce(c, F.lit(0)).alias(f"__s_{n}") for n, c in sums.items()),
        *(c.alias(f"__m_{n}") for n, c in prior_max.items()),
        *(c.alias(f"__l_{n}") for n, c in lags.items()),
    ]
    base = df.select("*", block.alias("__block"), *values)
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = base.select(
        *df.columns, "__block",
        *(F.sum(f"__s_{n}").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__s_{n}")
          for n in sums),
        *(F.max(f"__m_{n}").over(before).alias(f"__m_{n}") for n in prior_max),
        *(F.lag(f"__l_{n}").over(inside).alias(f"__l_{n}") for n in lags),
        F.lag(F.lit(True)).over(inside).isNull().alias("__first"),
    )
    # One order column keeps the aggregation buffers fixed-width, hence hashed and not sorted.
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    summary = base.groupBy(*keys, "__block").agg(
        *(F.sum(f"__s_{n}").alias(f"__ps_{n}") for n in sums),
        *(F.max(f"__m_{n}").alias(f"__pm_{n}") for n in prior_max),
        *(F.max_by(f"__l_{n}", position).alias(f"__pl_{n}") for n in lags),
        F.count(F.lit(1)).alias("__rows"),
    )
    across = Window.partitionBy(*keys).orderBy("__block")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, "__block",
        *(F.sum(f"__ps_{n}").over(earlier).alias(f"__ps_{n}") for n in sums),
        *(F.max(f"__pm_{n}").over(earlier).alias(f"__pm_{n}") for n in prior_max),
        *(F.lag(f"__pl_{n}").over(across).alias(f"__pl_{n}") for n in lags),
    )
    joined = local.join(carried, [*keys, "__block"], "left")
    return joined.select(
        *df.columns,
        *((F.col(f"__s_{n}") + F.coalesce(F.col(f"__ps_{n}"), F.lit(0))).alias(n) for n in sums),
        *(F.greatest(F.col(f"__m_{n}"), F.col(f"__pm_{n}")).alias(n) for n in prior_max),
        *(F.when(F.col("__first"), F.col(f"__pl_{n}")).otherwise(F.col(f"__l_{n}")).alias(n)
          for n in lags),
    )


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A filter on a projected column is pushed below the projection together with a copy of its
    expression; for parsed text, with columns built on columns, the copies multiply.  A one-row
    generator is a boundary that neither filters nor projections cross.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = False) -> DataFrame:
    """One row per key, the first (or last) along `order`, by partial aggregation, not a window.

    Copies of a hot key are combined before the shuffle, so they never meet in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if descending else F.min_by
    if len(order) == 1:  # one value per buffer: hashed, not sorted, for fixed-width columns
        return df.groupBy(*keys).agg(*(pick(c, order[0]).alias(c) for c in rest)).select(*df.columns)
    best = pick(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percents: Mapping[str, float],
    block: Column,
) -> DataFrame:
    """Exact percentiles per key, linear between the neighbours of position (N-1)*p.

    The built-in exact `percentile` keeps all values of a group in one buffer.  Here equal values
    are counted first, positions are running counts over value blocks, and only the rows that
    hold a wanted position are looked at again.  `block` must not decrease with `value`.
    """
    for p in percents.values():
        if not 0 <= p <= 100:
            raise ValueError("percentile outside 0..100")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__count"))
    running = carry(counted, keys, [value], block, sums={"__upto": F.col("__count")})
    sizes = counted.groupBy(*keys).agg(F.sum("__count").alias("__size"))
    placed = running.join(sizes, list(keys))
    at = lambda i: (F.col("__upto") - F.col("__count") <= i) & (i < F.col("__upto"))
    position = {n: (F.col("__size") - 1) * F.lit(p) / 100 for n, p in percents.items()}
    low = {n: F.floor(c) for n, c in position.items()}
    high = {n: F.least(low[n] + 1, F.col("__size") - 1) for n in percents}
    wanted = F.lit(False)
    for n in percents:
        wanted = wanted | at(low[n]) | at(high[n])
    picked = placed.filter(wanted).groupBy(*keys, "__size").agg(
        *(F.max(F.when(at(low[n]), F.col(value))).alias(f"__lo_{n}") for n in percents),
        *(F.max(F.when(at(high[n]), F.col(value))).alias(f"__hi_{n}") for n in percents))
    return picked.select(*keys, *(
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * (position[n] - low[n])).alias(n)
        for n in percents))
