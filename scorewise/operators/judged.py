"""Judged-run analysis: null-aware criterion means, paired comparisons, agreement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewise.functions.digests import md5_heads
from scorewise.functions.text import CRITERIA, word_count

from .blocks import prefix_by_range
from .sampling import hash_number

HELD = 1 << 24  # positions that a task holds at once


def _kept(criterion: str, drop_zero: bool) -> Column:
    value = F.col(criterion).cast("double")
    return F.when(value != 0, value) if drop_zero else value


def criterion_summary(
    df: DataFrame, by: Sequence[str] = (), criteria: Sequence[str] = CRITERIA, drop_zero: bool = False
) -> DataFrame:
    """Mean, population deviation, min, max and count per criterion; nulls (and zeros on request) are skipped.

    All criteria are folded in one aggregation and turned into rows afterwards.
    """
    folded = df.groupBy(*by).agg(*[
        F.struct(
            F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.count(v).alias("n"),
        ).alias(c)
        for c in criteria
        for v in [_kept(c, drop_zero)]
    ])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"{c}.*")) for c in criteria]))
    return folded.select(*by, rows)


def row_overall(criteria: Sequence[str] = CRITERIA) -> Column:
    """Mean of a row's criteria; null when one is null."""
    total = F.col(criteria[0])
    for c in criteria[1:]:
        total = total + F.col(c)
    return total / F.lit(float(len(criteria)))


def overall(
    df: DataFrame, mode: str = "criterion_means", by: Sequence[str] = (), criteria: Sequence[str] = CRITERIA
) -> DataFrame:
    """Overall score: mean of the criterion means, mean of all pooled values, or mean of complete rows' means."""
    if mode == "criterion_means":
        means = F.filter(F.array(*[F.avg(c) for c in criteria]), lambda x: x.isNotNull())
        value = F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(means), F.lit(0))
    elif mode == "pooled":
        zero = F.lit(0.0)
        total = sum((F.coalesce(F.sum(c), zero) for c in criteria[1:]), F.coalesce(F.sum(criteria[0]), zero))
        count = sum((F.count(c) for c in criteria[1:]), F.count(criteria[0]))
        value = total / F.nullif(count, F.lit(0))
    elif mode == "row_means":
        value = F.avg(row_overall(criteria))
    else:
        raise ValueError("mode is criterion_means, pooled or row_means")
    return df.groupBy(*by).agg(value.alias("overall"))


def ablation_summary(df: DataFrame, by: Sequence[str], criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """One row per run key: criterion means, their overall mean and the row count."""
    return df.groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in criteria], F.avg(row_overall(criteria)).alias("overall"), F.count("*").alias("n")
    )


def scene_summary(df: DataFrame, variants: Sequence[str], criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """Per scene and variant: criterion means and the number of rows with a first criterion."""
    folds = []
    for v in variants:
        own = F.col("variant") == v
        folds += [F.avg(F.when(own, F.col(c))).alias(f"{v}_{c}") for c in criteria]
        folds.append(F.count(F.when(own, F.col(criteria[0]))).alias(f"{v}_n"))
    return df.groupBy("scene").agg(*folds)


def widen(df: DataFrame, variants: Sequence[str], values: Sequence[str], id_col: str = "video_id") -> DataFrame:
    """One row per id with ``variant_value`` columns; absent variants are null."""
    pivoted = [
        F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{v}_{c}") for v in variants for c in values
    ]
    return df.groupBy(id_col).agg(*pivoted)


def lengthen(df: DataFrame, variants: Sequence[str], values: Sequence[str], id_col: str = "video_id") -> DataFrame:
    """One row per id and variant from ``variant_value`` columns."""
    rows = [F.struct(F.lit(v).alias("variant"), *[F.col(f"{v}_{c}").alias(c) for c in values]) for v in variants]
    return df.select(id_col, F.inline(F.array(*rows)))


# --- paired comparisons ----------------------------------------------------------------------------------------

def run_delta(a: DataFrame, b: DataFrame, criteria: Sequence[str] = CRITERIA, id_col: str = "video_id") -> DataFrame:
    """Criterion differences a - b per common id (null counts as 0) and their mean."""
    joined = a.select(id_col, *criteria).alias("a").join(b.select(id_col, *criteria).alias("b"), id_col)
    diffs = [(F.coalesce(f"a.{c}", F.lit(0)) - F.coalesce(f"b.{c}", F.lit(0))).alias(f"d_{c}") for c in criteria]
    rows = joined.select(id_col, *diffs)
    return rows.withColumn("d_mean", row_overall([f"d_{c}" for c in criteria]))


def mean_delta(df: DataFrame, a: str, b: str, run_col: str = "variant", criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """Means of two runs and their difference per criterion."""
    one, two = F.col(run_col) == a, F.col(run_col) == b
    folded = df.agg(*[
        F.struct(F.avg(F.when(one, F.col(c))).alias("mean_a"), F.avg(F.when(two, F.col(c))).alias("mean_b")).alias(c)
        for c in criteria
    ])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"{c}.*")) for c in criteria]))
    return folded.select(rows).withColumn("delta", F.col("mean_a") - F.col("mean_b"))


def _drawn_sums(by: list[str], resamples: int, seed: int, chunk: int, held: int = HELD):
    """Sum and count of what each resample draws from blocks of positions. Rows come by resamples and blocks; the blocks of
    a range of resamples are held together, up to ``held`` positions, and the draws are made once for all of them."""

    def drawn(key: tuple, n: int, first: int, some: list[pa.Array]) -> pa.RecordBatch:
        rep, step = key[-2:]
        there = np.concatenate([d.is_valid().to_numpy(zero_copy_only=False) for d in some])
        value = np.concatenate([d.fill_null(0.0).to_numpy(zero_copy_only=False) for d in some])
        reps = range(rep, min(rep + step, resamples))
        s, c = np.zeros(len(reps)), np.zeros(len(reps), np.int64)
        whole, full = len(value) == n, there.all()
        for k, r in enumerate(reps):
            for heads in md5_heads(f"{seed}:{r}:", n):
                at = heads.astype(np.int64) % n - first
                if not whole:
                    at = at[(at >= 0) & (at < len(value))]
                s[k] += value[at].sum()
                c[k] += len(at) if full else there[at].sum()
        keys = [pa.array([v] * len(reps), t) for v, t in zip(key, kinds)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(np.array(reps, np.int32)), pa.array(s), pa.array(c)], names=[*by, "rep", "s", "c"])

    kinds: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, some = None, []  # range of resamples, number of pairs, first position; its blocks so far
        for batch in batches:
            kinds[:] = [batch.column(b).type for b in by]
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in (*by, "rep", "step"))
                blk, n = (batch.column(c)[i].as_py() for c in ("blk", "n"))
                if some and (key != at[0] or (len(some) + 1) * chunk > held):
                    yield drawn(*at, some)
                    some = []
                if not some:
                    at = (key, n, blk * chunk)
                some.append(batch.column("diffs")[i].values)
        if some:
            yield drawn(*at, some)

    return run


def paired_bootstrap(
    pairs: DataFrame, resamples: int = 10_000, seed: int = 42, ci: str = "linear", by: Sequence[str] = (),
    id_col: str = "video_id", chunk: int = 1 << 18,
) -> DataFrame:
    """Paired bootstrap of ``value_a - value_b``: means, 95% interval, share of positive resamples.

    Positions follow the seeded order of the ids; draw d of resample r takes position ``md5(seed:r:d) mod n``.
    No draw is moved: differences travel as blocks of ``chunk`` positions to the ranges of resamples, a task makes the draws
    of its resamples once for every ``HELD`` positions, and one sum and count per resample leave it for those. ``ci`` is
    ``linear`` (interpolated percentile) or ``element`` (the sorted value at ``int(q * resamples)``).
    """
    diffs = pairs.select(*by, id_col, (F.col("value_a") - F.col("value_b")).alias("diff"), "value_a", "value_b")
    placed = hash_number(diffs, by, [id_col], seed, "pos").select(*by, (F.col("pos") - 1).alias("pos"), "diff")
    means = diffs.groupBy(*by).agg(
        F.count("*").alias("n_paired"), F.avg("value_a").alias("mean_a"), F.avg("value_b").alias("mean_b"),
        F.avg("diff").alias("delta"),
    )
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "diff"))), lambda p: p["diff"])
    blocks = placed.groupBy(*by, F.expr(f"pos div {int(chunk)}").alias("blk")).agg(held.alias("diffs"))
    sizes = means.select(*by, F.col("n_paired").alias("n"))
    blocks = blocks.join(sizes, list(by)) if by else blocks.withColumn("n", sizes.scalar())
    # a row per block and range of resamples: a range per task, and enough draws in each to be worth its while
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.greatest(F.lit(-(-resamples // tasks)), F.expr(f"{1 << 18} div n")).cast("int")
    first = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), step))
    work = blocks.select(*by, "blk", "n", "diffs", step.alias("step"), first.alias("rep"))
    work = work.repartitionById(tasks, F.expr("cast(rep div step as int)")).sortWithinPartitions(*by, "rep", "blk")
    kinds = [f"{c} {work.schema[c].dataType.simpleString()}" for c in by]
    sums = work.mapInArrow(_drawn_sums(list(by), resamples, seed, int(chunk)), ", ".join([*kinds, "rep int, s double, c long"]))
    deltas = sums.groupBy(*by, "rep").agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("d"))

    if ci == "linear":
        bounds = [F.percentile("d", F.lit(0.025)).alias("ci_lo"), F.percentile("d", F.lit(0.975)).alias("ci_hi")]
    elif ci == "element":
        ordered = F.array_sort(F.collect_list("d"))
        at = lambda q: F.get(ordered, F.lit(int(q * resamples)))
        bounds = [at(0.025).alias("ci_lo"), at(0.975).alias("ci_hi")]
    else:
        raise ValueError("ci is 'linear' or 'element'")
    spread = deltas.groupBy(*by).agg(*bounds, F.avg((F.col("d") > 0).cast("double")).alias("p_pos"))
    spread = spread.withColumn("significant", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))
    if by:
        return means.join(spread, list(by))
    cols = ["ci_lo", "ci_hi", "p_pos", "significant"]
    return means.withColumn("_s", spread.select(F.struct(*cols).alias("s")).scalar()).select(*means.columns, "_s.*")


def run_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], run_col: str = "variant", id_col: str = "video_id") -> DataFrame:
    """Common-id value pairs of the listed runs, labelled ``A vs B``. ``df`` has one ``overall`` per run and id."""
    sides = F.inline(F.array(*[
        F.struct(F.lit(f"{a} vs {b}").alias("pair"), F.lit(a).alias("_a"), F.lit(b).alias("_b")) for a, b in pairs
    ]))
    rows = df.select(id_col, run_col, "overall").select("*", sides)
    own = rows.filter((F.col(run_col) == F.col("_a")) | (F.col(run_col) == F.col("_b")))
    folded = own.groupBy("pair", id_col).agg(
        F.max(F.when(F.col(run_col) == F.col("_a"), F.col("overall"))).alias("value_a"),
        F.max(F.when(F.col(run_col) == F.col("_b"), F.col("overall"))).alias("value_b"),
    )
    return folded.filter("value_a is not null and value_b is not null")


def pairwise_significance(df: DataFrame, pairs: Sequence[tuple[str, str]], resamples: int = 10_000, **options) -> DataFrame:
    """Paired bootstrap of every listed pair of runs."""
    return paired_bootstrap(run_pairs(df, pairs), resamples, by=["pair"], **options)


# --- agreement -------------------------------------------------------------------------------------------------

def _average_ranks(counts: DataFrame, value: str, name: str, ranges: int | None) -> DataFrame:
    """Rank of each distinct value, ties sharing their mean rank."""
    per_value = counts.groupBy("criterion", value).agg(F.sum("w").alias("w"))
    placed = prefix_by_range(per_value, ["criterion"], [value], ranges, _below=F.col("w"))
    return placed.select("criterion", value, (F.col("_below") + (F.col("w") + 1) / 2).alias(name))


def _weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Correlation of values that are already centred on their weighted means."""
    cov, vx, vy = F.sum(w * x * y), F.sum(w * x * x), F.sum(w * y * y)
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def agreement(
    df: DataFrame, pairs: dict[str, tuple[str, str]], min_rows: int = 5, ranges: int | None = None
) -> DataFrame:
    """Pearson, Spearman (average ranks), mean absolute difference and both means per criterion.

    ``pairs`` maps a criterion to its two columns. Rows are first counted per distinct pair of values, so ratings
    shared by many rows cost one row in everything that follows.
    """
    entries = [
        F.struct(F.lit(c).alias("criterion"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for c, (a, b) in pairs.items()
    ]
    long = df.select(F.inline(F.array(*entries))).filter("x is not null and y is not null")
    counts = long.groupBy("criterion", "x", "y").agg(F.count("*").alias("w"))
    ranked = counts.join(_average_ranks(counts, "x", "rx", ranges), ["criterion", "x"])
    ranked = ranked.join(_average_ranks(counts, "y", "ry", ranges), ["criterion", "y"])
    w, x, y = F.col("w").cast("double"), F.col("x"), F.col("y")
    # one row per criterion, as many as are listed in the call; ranks of n rows have the mean (n + 1) / 2
    means = counts.groupBy("criterion").agg(
        F.sum("w").alias("n"), (F.sum(w * x) / F.sum(w)).alias("mean_x"), (F.sum(w * y) / F.sum(w)).alias("mean_y")
    )
    centred = ranked.join(F.broadcast(means), "criterion").withColumns({
        "_x": x - F.col("mean_x"), "_y": y - F.col("mean_y"),
        "_rx": F.col("rx") - (F.col("n") + 1) / 2, "_ry": F.col("ry") - (F.col("n") + 1) / 2,
    })
    result = centred.groupBy("criterion", "n", "mean_x", "mean_y").agg(
        _weighted_corr(F.col("_x"), F.col("_y"), w).alias("pearson"),
        _weighted_corr(F.col("_rx"), F.col("_ry"), w).alias("spearman"),
        (F.sum(w * F.abs(x - y)) / F.first("n")).alias("mae"),
    )
    return result.filter(F.col("n") >= min_rows)


def word_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, smallest and largest word count of a text column."""
    words = word_count(F.col(col))
    return df.groupBy(*by).agg(F.avg(words).alias("mean_words"), F.min(words).alias("min_words"), F.max(words).alias("max_words"))

