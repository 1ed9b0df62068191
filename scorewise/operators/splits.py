"""Leak-free splits: every row of a recording lands on one side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import with_totals
from .sampling import hash_number, hash_order, hash_prefix


def group_split(
    df: DataFrame, fraction: float = 0.15, seed: int = 42, by: Sequence[str] = (), id_col: str = "video_id"
) -> DataFrame:
    """Add ``split``: the first ``max(1, round(n * fraction))`` ids in the seeded order go to ``eval``.

    Rounding is half to even. With ``by`` (one value per id, e.g. a type) the share is taken inside each value; null is a
    value of its own.
    """
    groups = df.select(*by, id_col).distinct()
    # one text per stratum, in which a null differs from an empty string; never null itself
    stratum = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(by)]), {"ignoreNullFields": "false"}) if by else F.lit("")
    ranked = hash_number(groups.withColumn("_stratum", stratum), ["_stratum"], [id_col], seed, "_pos")
    placed = ranked.withColumn("_h", hash_order(seed, id_col)).withColumn("blk", hash_prefix("_h"))
    sized = with_totals(placed, ["_stratum"], _n=("count", F.lit(1)))
    take = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction)).cast("int"))
    chosen = sized.filter(F.col("_pos") <= take).select(*[F.col(c).alias(f"_e_{c}") for c in (*by, id_col)], F.lit(True).alias("_eval"))
    same = [df[c].eqNullSafe(chosen[f"_e_{c}"]) for c in (*by, id_col)]
    marked = df.join(chosen, same, "left")
    return marked.withColumn("split", F.when(F.col("_eval"), "eval").otherwise("train")).select(*df.columns, "split")


def split_report(df: DataFrame, by: Sequence[str] = (), id_col: str = "video_id") -> DataFrame:
    """Rows and distinct ids per side (and per ``by``).

    Ids are reduced to one row each before they are counted, so no id set is built in one task.
    """
    per_id = df.groupBy("split", *by, id_col).agg(F.count("*").alias("_rows"))
    return per_id.groupBy("split", *by).agg(F.sum("_rows").alias("n_rows"), F.count("*").alias("n_videos"))


def positional_split(df: DataFrame, first: int, position: str = "line") -> DataFrame:
    """``abnormal`` for the first lines of an ordered list, ``normal`` for the rest; position counts from 0."""
    return df.withColumn("split", F.when(F.col(position) < first, "abnormal").otherwise("normal"))


def leaked_ids(df: DataFrame, id_col: str = "video_id") -> DataFrame:
    """Ids found on both sides; empty for a correct split."""
    sides = df.groupBy(id_col).agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return sides.filter("a <> b").select(id_col)
