"""Skew-safe building blocks for ordered series.

One series may hold a large share of all rows, so no operator may put a whole series into one task. Rows are cut
into blocks of ``size`` consecutive positions and every window runs inside ``(key, block)``. What a row needs from
outside its block is either

* a fold over other blocks (min, max, sum, last state): computed on one summary row per block, then joined back
  on ``(key, block)``, which spreads a hot series over many tasks; or
* a few neighbouring rows: those are copied into the block (``halo``).

Positions of a series are dense and start at 0, as ``number_rows`` assigns them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewise.sources.shared import written

BLOCK_ROWS = 1 << 16
GROUP_LIMIT = 1000  # Spark's default windowGroupLimitThreshold
KEY = ("series_id",)

_PARTIAL = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
_MERGE = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}


def block_of(position: str, size: int = BLOCK_ROWS) -> Column:
    return F.expr(f"cast({position} as bigint) div {int(size)}")


def with_block(df: DataFrame, position: str = "idx", size: int = BLOCK_ROWS) -> DataFrame:
    return df.withColumn("blk", block_of(position, size))


def within(keys: Sequence[str], *order) -> Window:
    """Window inside one block of one key."""
    w = Window.partitionBy(*keys, "blk")
    return w.orderBy(*order) if order else w


def _summaries(df: DataFrame, keys: Sequence[str], folds: dict[str, tuple[str, Column]]) -> DataFrame:
    return df.groupBy(*keys, "blk").agg(*[_PARTIAL[fn](col).alias(name) for name, (fn, col) in folds.items()])


def solid(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows without a key, as the join on ``(key, block)`` would. Said on both of its inputs, the condition
    keeps their plans equal, so that a shuffle they share is made once."""
    for c in (*keys, "blk"):
        df = df.filter(F.col(c).isNotNull())
    return df


def with_totals(df: DataFrame, keys: Sequence[str], **folds: tuple[str, Column]) -> DataFrame:
    """Attach whole-key folds, e.g. ``n=("count", F.lit(1))``, to rows that carry a ``blk`` column."""
    df = solid(df, keys)
    whole = Window.partitionBy(*keys)
    totals = _summaries(df, keys, folds).select(
        *keys, "blk", *[_MERGE[fn](F.col(name)).over(whole).alias(name) for name, (fn, _) in folds.items()]
    )
    return df.join(totals, [*keys, "blk"])


def with_prior(df: DataFrame, keys: Sequence[str], **folds: tuple[str, Column]) -> DataFrame:
    """Attach folds over all earlier blocks of the key; null in the first block."""
    df = solid(df, keys)
    before = Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    prior = _summaries(df, keys, folds).select(
        *keys, "blk", *[_MERGE[fn](F.col(name)).over(before).alias(name) for name, (fn, _) in folds.items()]
    )
    return df.join(prior, [*keys, "blk"])


def halo(
    df: DataFrame, keys: Sequence[str], before: int = 0, after: int = 0, position: str = "idx", size: int = BLOCK_ROWS
) -> DataFrame:
    """Copy rows into each block that needs them as one of ``before`` / ``after`` neighbours.

    ``core`` is true for the one copy that lies in its own block; keep only core rows after the window.
    """
    first = F.expr(f"greatest(cast({position} as bigint) - {int(after)}, 0L) div {int(size)}")
    last = F.expr(f"(cast({position} as bigint) + {int(before)}) div {int(size)}")
    copies = df.withColumn("blk", F.explode(F.sequence(first, last)))
    return copies.withColumn("core", F.col("blk") == block_of(position, size))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, name: str = "idx", start: int = 0
) -> DataFrame:
    """Consecutive numbers per key in ``order`` without sorting a whole key in one task.

    ``bucket`` is any deterministic expression that never decreases along ``order`` (a quantile bucket, a hash
    prefix, a block number): rows are ranked inside a bucket and shifted by the sizes of the buckets before it.
    ``keys`` may be empty for a global numbering.
    """
    rows = df.withColumn("blk", bucket)
    shifted = with_prior(rows, keys, _before=("count", F.lit(1)))
    number = F.row_number().over(within(keys, *order)) - F.lit(1 - start) + F.coalesce("_before", F.lit(0))
    return shifted.withColumn(name, number.cast("long")).drop("blk", "_before")


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], ranges: int | None = None) -> DataFrame:
    """The rows cut by Spark into ranges of (keys, order) and put in order (ascending, nulls first), as a written table.

    ``blk`` numbers the ranges and ``_at`` the rows, both rising along the order. A key with many rows gets many ranges, and
    rows that tie in the first columns of the order are told apart by the others. ``ranges`` is the number of ranges; by
    default it follows the session's shuffle settings. The table is written because a range must not change its number
    between the plans that read it; the input is evaluated here, and only here.
    """
    place = [F.col(c) if isinstance(c, str) else c for c in (*keys, *order)]
    cut = df.repartitionByRange(ranges, *place) if ranges else df.repartitionByRange(*place)
    numbers = {"blk": F.spark_partition_id().cast("long"), "_at": F.monotonically_increasing_id()}
    return written(cut.sortWithinPartitions(*place).withColumns(numbers), "ranged")


def _with_prior(cut: DataFrame, keys: Sequence[str], parts: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """Attach ``values`` of the ranges of a key, windows and columns over their ``parts``, to the rows of ``ranged``."""
    prior = cut.groupBy(*keys, "blk").agg(*[c.alias(n) for n, c in parts.items()])
    prior = prior.select(*[F.col(c).alias(f"_p_{c}") for c in (*keys, "blk")], *[c.alias(n) for n, c in values.items()])
    return cut.join(prior, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in (*keys, "blk")])


def earlier_ranges(keys: Sequence[str]) -> Window:
    """The ranges of a key before the present one: one row per range, whatever the number of rows."""
    return Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)


def prefix_by_range(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], ranges: int | None = None,
    totals: Sequence[str] = (), **sums: Column,
) -> DataFrame:
    """Attach sums over the rows strictly earlier in ``order`` (ascending, nulls first), for keys of any size.

    Sums run inside the ranges of ``ranged``; what lies before a range comes from one row per range and key. ``totals``
    names sums to attach for the whole key too, as ``all_<name>``.
    """
    cut = ranged(df, keys, order, ranges)
    parts = {f"_{n}": F.sum(c) for n, c in sums.items()}
    values = {f"_{n}": F.sum(f"_{n}").over(earlier_ranges(keys)) for n in sums}
    values |= {f"all_{n}": F.sum(f"_{n}").over(Window.partitionBy(*keys)) for n in totals}
    here = within(keys, "_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumns({f"_here_{n}": F.sum(c).over(here) for n, c in sums.items()})
    zero = F.lit(0)
    added = [(F.coalesce(f"_here_{n}", zero) + F.coalesce(f"_{n}", zero)).alias(n) for n in sums]
    return _with_prior(inside, keys, parts, values).select(*df.columns, *added, *[f"all_{n}" for n in totals])


def number_by_range(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "idx", start: int = 0,
    ranges: int | None = None,
) -> DataFrame:
    """``number_rows`` for keys of any size and any order. The rows are moved once, by range; their numbers come from their
    place in the range and from one row per range and key."""
    cut = ranged(df, keys, order, ranges)
    parts = {"_first": F.min("_at"), "_rows": F.count("*")}
    values = {"_from": F.coalesce(F.sum("_rows").over(earlier_ranges(keys)), F.lit(0)) - F.col("_first")}
    numbered = _with_prior(cut, keys, parts, values)
    kept = [c for c in df.columns if c != name]
    return numbered.select(*kept, (F.col("_at") + F.col("_from") + start).cast("long").alias(name))


def top_rows(
    df: DataFrame, keys: Sequence[str], k: int, score: str = "score", tie: str = "idx", name: str = "_rn",
) -> DataFrame:
    """The k best rows per key with their rank from 1: NaN above all numbers, null below them, ties to the lower ``tie``.

    For a k that the optimizer pushes below the shuffle, each task keeps k rows of a key first. A larger k is cut in
    three levels, in 4096 hashed parts of a key, then in 64, then in the key, so that one task merges 64 lists at most.
    """
    best = lambda *by: Window.partitionBy(*keys, *by).orderBy(F.desc_nulls_last(score), tie)
    first = lambda rows, *by: rows.withColumn(name, F.row_number().over(best(*by))).filter(F.col(name) <= k)
    if k <= GROUP_LIMIT:
        return first(df)
    rows = df.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(4096)))
    rows = first(rows, "_part").withColumn("_part", F.expr("_part div 64"))
    return first(first(rows, "_part").drop("_part"))


def disjoint_join(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str] = KEY,
    position: str = "idx",
    lo: str = "start_idx",
    hi: str = "end_idx",
    how: str = "inner",
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """``range_join`` for spans that do not overlap within a key: no row is compared with more than one span.

    Spans are cut at block borders; in each block rows and span starts are put in one order, and every row takes the
    latest span that began. Spans that do overlap fail the job. ``how`` is inner or left.
    """
    extra = [c for c in spans.columns if c not in keys]
    touched = F.expr(f"sequence(cast({lo} as bigint) div {int(size)}, cast({hi} as bigint) div {int(size)})")
    pieces = spans.filter(F.col(lo) <= F.col(hi)).withColumn("blk", F.explode(touched))
    place = lambda c: F.col(c).cast("long").alias("_at")
    span = F.struct(*[F.col(c) for c in extra])
    row = F.struct(*[F.col(c) for c in points.columns])
    opened = pieces.select(*keys, "blk", F.greatest(F.col(lo).cast("long"), F.col("blk") * size).alias("_at"), span.alias("_span"))
    passed = with_block(points, position, size).select(*keys, "blk", place(position), row.alias("_row"))
    both = opened.unionByName(passed, allowMissingColumns=True)
    in_order = within(keys, "_at", F.col("_span").isNull())
    earlier = F.max(F.col(f"_span.{hi}").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    met = both.withColumns({"_latest": F.last("_span", ignorenulls=True).over(in_order), "_reach": earlier})
    clash = F.col("_row").isNull() & F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False))
    met = met.withColumn("_clash", F.max(clash).over(in_order)).filter(F.col("_row").isNotNull())
    met = met.filter(F.assert_true(~F.col("_clash"), F.lit("spans overlap")).isNull())
    inside = F.coalesce(F.col("_at") <= F.col(f"_latest.{hi}"), F.lit(False))
    if how == "inner":
        met = met.filter(inside)
    elif how != "left":
        raise ValueError("how is 'inner' or 'left'")
    found = [F.when(inside, F.col(f"_latest.{c}")).alias(c) for c in extra]
    return met.select(*[F.col(f"_row.{c}") for c in points.columns], *found)


def next_event(
    points: DataFrame, events: DataFrame, keys: Sequence[str] = KEY, at: str = "start_idx", event: str = "idx",
    name: str = "_next", size: int = BLOCK_ROWS,
) -> DataFrame:
    """Attach to each point the first event of its key at or after its position; null when there is none.

    Points and events are put into one order inside their blocks, where a point takes the least event that comes behind it. What
    lies beyond its block comes from one row per block: the first event of all later blocks, carried backwards. No point meets
    more than one event, however many there are."""
    row = F.struct(*[F.col(c) for c in points.columns]).alias("_row")
    asked = points.select(*keys, F.col(at).cast("long").alias("_at"), row)
    told = events.select(*keys, F.col(event).cast("long").alias("_at"), F.col(event).cast("long").alias("_event"))
    rows = solid(with_block(asked.unionByName(told, allowMissingColumns=True), "_at", size), keys)
    behind = Window.partitionBy(*keys).orderBy("blk").rowsBetween(1, Window.unboundedFollowing)
    later = _summaries(rows, keys, {"_first": ("min", F.col("_event"))})
    later = later.select(*keys, "blk", F.min("_first").over(behind).alias("_later"))
    # an event at the position of a point counts, so it comes before the point in the falling order
    falling = within(keys, F.desc("_at"), F.col("_event").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_event", F.min("_event").over(falling)).join(later, [*keys, "blk"]).filter(F.col("_row").isNotNull())
    return met.select(*[F.col(f"_row.{c}").alias(c) for c in points.columns], F.coalesce("_event", "_later").alias(name))


LEVELS = (0, 4, 8, 12, 16)  # widths of the grids as powers of two; the widest is a block of rows


def range_join(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str] = KEY,
    position: str = "idx",
    lo: str = "start_idx",
    hi: str = "end_idx",
) -> DataFrame:
    """Rows whose position lies in a span of the same key, both ends inclusive; spans may overlap.

    Spans are sorted into grids by length: a span lies in the finest grid whose cells are at least as long as it, which
    it touches in two cells at most; spans longer than the widest cell touch one cell per ``2 ** 16`` positions. Rows
    are listed once per grid in use, and the join runs on (key, grid, cell), so a row meets only spans whose length is
    within a factor of sixteen of its cell, and a hot key is spread over its cells.
    """
    length = F.col(hi).cast("long") - F.col(lo).cast("long") + 1
    level = F.coalesce(*[F.when(length <= (1 << b), F.lit(b)) for b in LEVELS], F.lit(LEVELS[-1]))
    sized = spans.filter(F.col(lo) <= F.col(hi)).withColumn("_grid", level)
    cell = lambda c: F.expr(f"shiftright(cast({c} as bigint), _grid)")
    cut = sized.withColumn("blk", F.explode(F.sequence(cell(lo), cell(hi)))).alias("s")
    in_use = sized.agg(F.collect_set("_grid")).scalar()
    rows = points.withColumn("_grid", F.explode(in_use)).withColumn("blk", cell(position)).alias("p")
    same = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in (*keys, "_grid", "blk")]
    inside = F.col(f"p.{position}").between(F.col(f"s.{lo}"), F.col(f"s.{hi}"))
    matched = rows.join(cut, [*same, inside])
    extra = [F.col(f"s.{c}") for c in spans.columns if c not in keys]
    return matched.select(*[F.col(f"p.{c}") for c in points.columns], *extra)


def attach(rows: DataFrame, few: DataFrame, keys: Sequence[str], spread: Column, how: str = "left") -> DataFrame:
    """Join a table with one row per key onto rows of which one key may hold most. The table is listed once per part,
    and the rows of a key are dealt to the parts by a hash of ``spread``, so no task gets a whole key."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    return dealt.join(listed, [*keys, "_part"], how).drop("_part")


def explode_range(df: DataFrame, n: Column, keys: Sequence[str], name: str = "idx", chunk: int = BLOCK_ROWS) -> DataFrame:
    """One row per integer 0..n-1. Long ranges are cut into chunks that are spread before they are expanded."""
    chunks = df.withColumn("_upto", n.cast("long")).filter("_upto > 0")
    chunks = chunks.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_upto - 1) div {int(chunk)})")))
    # a fixed count: the chunk rows are small, and adaptive coalescing would expand them all in one task
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunks.repartition(tasks, *keys, "_chunk")
    numbers = F.expr(f"sequence(_chunk * {int(chunk)}, least((_chunk + 1) * {int(chunk)}, _upto) - 1)")
    return spread.withColumn(name, F.explode(numbers)).drop("_upto", "_chunk")
