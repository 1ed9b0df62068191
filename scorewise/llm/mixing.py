"""Mixing sources to target weights, in DataFrame operations only.

Sources get weights; each source's target is its weight's share of all words, stopped at ``max_rate`` times what the
source has, and what is cut off goes to the other sources by weight. That fixed point has a closed form: with sources in
order of (size / weight), a source is stopped exactly if its cap is at most its share of what the earlier, stopped ones
leave. A document is then emitted floor(rate) times, plus once more if a number hashed from the seed and its id falls
below the fraction of the rate.

Null texts have no words. Null and empty sources are two ordinary sources; null sorts last. A source without words has
target 0 and its documents are not emitted. Rows with the same id share one hashed number, so repeated rows get the same
number of copies; an id that is null is hashed as the empty string. Other columns pass through, and one named like an
output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewise.sources.shared import written

from .schemas import passing, unpacked, whole_row

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_RATE = 3
OUTPUTS = ("source_size", "target", "rate", "copies")


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per source: its words, its weight, its target in words and the rate that reaches the target.

    Words are summed per source before anything is shuffled; the ordered part runs over one row per source.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(n_words(text)).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    listed = F.array(*[F.lit(int(w)) for w in weights])
    weighted = sizes.withColumn("weight", F.element_at(listed, (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")))

    everything = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = everything.rowsBetween(Window.unboundedPreceding, -1)
    later = everything.rowsBetween(0, Window.unboundedFollowing)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * max_rate
    filled = weighted.withColumns({
        "_left": F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(earlier), F.lit(0)),
        "_weights": F.sum("weight").over(later),
    })
    stopped = cap * F.col("_weights") <= F.col("weight") * F.col("_left")
    # the first source that is not stopped fixes what every later one shares
    share = lambda c: F.first(F.when(~stopped, F.col(c)), ignorenulls=True).over(whole)
    filled = filled.withColumns({"_stopped": stopped, "_share": share("_left"), "_among": share("_weights")})
    target = F.when(F.col("_stopped"), cap.cast("double")).otherwise(
        (F.col("weight") * F.col("_share")).cast("double") / F.col("_among")
    )
    return filled.withColumn("target", target).select(
        "source", "source_size", "weight", "target",
        F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate"),
    )


def hashed_unit(key: str, seed: int) -> Column:
    """A number in [0, 1) made from the seed and the key alone: 52 bits of an md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _counted(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, seed: int = 0, key: str = "doc_id",
    source: str = "source", text: str = "text",
) -> DataFrame:
    """``row`` (the document) with its source's size, target and rate, and how many copies of it the mix holds.

    The table of sources has one row each and is written, so the planner knows its size: as long as it is small it is
    broadcast and no document moves; beyond that a sort-merge join splits a source that holds much of the corpus.
    """
    targets = source_targets(docs, weights, max_rate, source, text).select(F.col("source").alias("of"), *OUTPUTS[:-1])
    targets = written(targets, "mix-targets")
    rows = docs.select(whole_row(docs), F.col(source).alias("source"), hashed_unit(key, seed).alias("coin"))
    joined = rows.join(targets, rows["source"].eqNullSafe(targets["of"]), "left")
    copies = F.floor("rate") + (F.col("coin") < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", copies.cast("long"))


def with_copies(docs: DataFrame, **options) -> DataFrame:
    """Every document with its source's size, target and rate, and how many copies of it the mix holds."""
    return _counted(docs, **options).select(*unpacked(passing(docs.columns, OUTPUTS)), *OUTPUTS)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once per copy, numbered by ``copy`` from 1."""
    counted = _counted(docs, **options).filter("copies > 0")
    numbered = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return numbered.select(*unpacked(passing(docs.columns, ["copy"])), "copy")
