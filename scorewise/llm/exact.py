"""Exact duplicates by most-significant-first radix partitioning, without digests.

Texts are compared with white space deleted, as UTF-8 bytes. They are first parted by (number of bytes, first ``FIRST``
bytes); a text that is alone there is unique. The others are parted again and again by their next bytes, ``GROWTH`` times
as many in each round, until a group has one member or its bytes have ended. As the members of a group have one length,
they end together, and then they are equal byte for byte. So only texts that still have company are read further.

A group may hold a third of all rows. No task gathers a group: sizes come from partial counts, and group numbers go back
to the rows by a sort-merge join whose large partitions the engine splits. Each round starts from a written table.

Null counts as empty, and all empty texts are equal. Of equal texts the one with the most characters stays, then the
smallest id (null last), then, for repeated rows, the one read first; exactly one row of each group is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewise.sources.shared import written

from .schemas import unpacked, whole_row

SPACES = r"[\x20\x09-\x0D]+"
FIRST = 32
GROWTH = 32


def packed(text: Column) -> Column:
    """The text without white space, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def _head(n: int) -> Column:
    return F.substring("_rest", 1, n)


def _tail(n: int) -> Column:
    return F.expr(f"substring(_rest, {n + 1})")


def _numbered_groups(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Groups of two rows or more, with a number each."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return written(groups.withColumn("_group", F.monotonically_increasing_id()), name)


def _first_parting(docs: DataFrame, key: str, text: str, whole: bool, first: int) -> DataFrame:
    """Rows with a number of their own and that of their first group (null: unique), and what follows the first bytes.
    ``whole``: with the whole document, as ``row``."""
    value = F.col("row")[text]
    bytes_of = packed(value).cast("binary")
    keyed = docs.select(whole_row(docs, docs.columns if whole else [*dict.fromkeys([key, text])])).withColumn("_rest", bytes_of)
    keyed = keyed.withColumns({"_bytes": F.octet_length("_rest"), "_head": _head(first)})
    groups = _numbered_groups(keyed.select("_bytes", "_head"), ["_bytes", "_head"], "exact-first")
    own = {"_row": F.monotonically_increasing_id(), "_id": F.col("row")[key], "_chars": F.coalesce(F.length(value), F.lit(0)),
           "_sha": F.sha2("_rest", 256)}
    # a merge join at every size: its large partitions can be split, and the groups are never sent to every task
    keyed = keyed.withColumns(own).select("row", *own, "_bytes", "_head")
    rows = keyed.join(groups.hint("merge"), ["_bytes", "_head"], "left")
    rest = F.when(F.col("_group").isNotNull(), F.expr("substring(_rest, 1 + octet_length(_head))"))
    return written(
        rows.withColumn("_rest", F.when(F.col("_group").isNotNull(), bytes_of)).withColumn("_rest", rest)
        .select(*["row"] * whole, *own, "_group", "_rest"), "exact-rows",
    )


def _equal_rows(rows: DataFrame, size: int, growth: int) -> DataFrame:
    """(_row, _chars, id, _class) of all rows that equal another row."""
    active, ended, turn = rows.filter(F.col("_group").isNotNull()), None, 0
    while True:
        label = F.concat_ws(".", F.lit(turn), F.col("_group"))
        done = active.filter(F.octet_length("_rest") == 0).select("_row", "_chars", "_id", label.alias("_class"))
        ended = done if ended is None else ended.unionByName(done)
        active = active.filter(F.octet_length("_rest") > 0)
        if active.isEmpty():
            return ended
        active = active.withColumn("_head", _head(size)).withColumnRenamed("_group", "_parent")
        groups = _numbered_groups(active.select("_parent", "_head"), ["_parent", "_head"], f"exact-groups-{turn}")
        joined = active.join(groups, ["_parent", "_head"])
        active = written(joined.select("_row", "_chars", "_id", "_group", _tail(size).alias("_rest")), f"exact-{turn}")
        size, turn = size * growth, turn + 1


def _decided(
    docs: DataFrame, key: str, text: str, whole: bool, first: int, growth: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The numbered rows; for every row that has an equal one its class; and per class the row that stays."""
    rows = _first_parting(docs, key, text, whole, first)
    classes = written(_equal_rows(rows, first * growth, growth), "exact-classes")
    order = F.struct(-F.col("_chars"), F.col("_id").isNull(), F.col("_id"), F.col("_row"))
    best = classes.groupBy("_class").agg(F.min(order.alias("o")).alias("o"), F.count("*").alias("_size"))
    best = written(best.select("_class", "_size", F.col("o._id").alias("_keep"), F.col("o._row").alias("_winner")), "exact-kept")
    return rows, classes, best


def duplicate_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", first: int = FIRST, growth: int = GROWTH
) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept and the SHA-256 of the text without white space."""
    rows, classes, best = _decided(docs, key, text, False, first, growth)
    alone = rows.filter(F.col("_group").isNull()).select("_row", "_id", "_sha")
    grouped = rows.filter(F.col("_group").isNotNull()).select("_row", "_id", "_sha")
    found = classes.select("_row", "_class").join(best, "_class").drop("_class")
    grouped = grouped.join(found, "_row", "left")
    unique = alone.withColumns({
        "_keep": F.col("_id"), "_size": F.lit(1).cast("long"), "_winner": F.col("_row"),
    })
    out = unique.unionByName(grouped.withColumns({
        "_keep": F.when(F.col("_winner").isNull(), F.col("_id")).otherwise(F.col("_keep")),
        "_size": F.coalesce("_size", F.lit(1)), "_winner": F.coalesce("_winner", "_row"),
    }))
    return out.select(
        F.col("_id").alias(key), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_winner") == F.col("_row")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def without_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", first: int = FIRST, growth: int = GROWTH
) -> DataFrame:
    """The documents that stay, with all their columns. Unique documents are not moved again after the first join."""
    rows, classes, best = _decided(docs, key, text, True, first, growth)
    lost = classes.join(best, "_class").filter("_row <> _winner").select("_row")
    alone, grouped = rows.filter(F.col("_group").isNull()), rows.filter(F.col("_group").isNotNull())
    kept = alone.select("row").unionByName(grouped.join(lost, "_row", "left_anti").select("row"))
    return kept.select(*unpacked(docs.columns))
