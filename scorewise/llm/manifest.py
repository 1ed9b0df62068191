"""Merkle manifest of a dataset, with a proof for every row.

Leaves: the SHA-256 of a row's columns, each written as the number of its UTF-8 bytes, a colon and its value, null as ``-``.

Levels: the leaves of a group stand in one order, and every ``FAN`` consecutive nodes hash to their parent. The order is cut
into aligned blocks of ``FAN ** DEPTH`` nodes. A block keeps each of its levels as one string of hexadecimal digests, so
that fixed-width substrings of a level are what its parents hash, and the substrings beside a node are its siblings in the
proof. What remains of the blocks are the leaves of the next round, ``FAN ** DEPTH`` times fewer, until every group is one
node; the groups' nodes then make a tree of their own. So no task sees more than a block of a group, however many rows that
group has, and a group with a third of all rows is many blocks.

Proofs are several times as large as the levels they come from. So blocks are written and joined with their levels and the
way up from their root only, and proofs are made where a block becomes rows. The tables of blocks have small row groups, as
Spark reads thousands of rows at once, but never more than a row group.

The order comes from Spark's range partitioning and the sizes of the ranges (``number_by_range``). Rows of one group with the
same key are ordered by their leaf; rows that agree in that as well are interchangeable, and each has a proof of its own.

Null groups come first and are one group, null keys come first in their group. Null texts are told from empty ones. An empty
table has an empty manifest. Columns that are not named do not count, and none of them is passed on, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewise.operators.blocks import number_by_range
from scorewise.sources.shared import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
DEPTH = 5
WIDTH = 64  # hexadecimal digits of a digest

GROUP_BYTES = 8 << 20  # of a table of blocks, in one row group

_SEGMENTS = "array<struct<before:string,behind:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def entry(value: Column) -> Column:
    """A value as its size in bytes, a colon and its text; null as ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[str] = COLUMNS, **instead: Column) -> Column:
    """The leaf of a row; ``instead`` gives other values for some columns."""
    return digest(*[entry(instead.get(c, F.col(f"`{c}`"))) for c in columns])


def _parents(level: Column, fan: int) -> Column:
    """The next level of a level, both as one string."""
    count = F.ceil(F.length(level) / (WIDTH * fan)).cast("int")
    run = lambda i: F.sha2(F.substring(level, i * (WIDTH * fan) + 1, F.lit(WIDTH * fan)), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), run), "")


def _siblings(text: Column, at: Column, fan: int) -> Column:
    """The digests before and behind node ``at`` in its run of a level."""
    start = F.floor(at / fan).cast("int") * fan
    return F.struct(
        F.substring(text, start * WIDTH + 1, (at - start) * WIDTH).alias("before"),
        F.substring(text, (at + 1) * WIDTH + 1, (start + fan - 1 - at) * WIDTH).alias("behind"),
    )


def _depth(n: Column, fan: int, depth: int) -> Column:
    """Levels above the nodes of a block of a group with n nodes."""
    return sum((F.when(n > fan**i, 1).otherwise(0) for i in range(depth)), F.lit(0))


def _tree(nodes: DataFrame, fan: int, depth: int, name: str) -> DataFrame:
    """Nodes (group, at, n, node, held), numbered from 0 to n - 1 in their group, to blocks: group, root, ``held`` of their
    nodes by place, the ``levels`` of the block and the ``way`` from there up to the root of its group."""
    size = fan**depth
    listed = F.array_sort(F.collect_list(F.struct("at", "node", "held")))
    blocks = nodes.groupBy("group", F.expr(f"at div {size}").alias("block")).agg(F.first("n").alias("n"), listed.alias("nodes"))
    first = F.array(F.array_join(F.col("nodes")["node"], ""))
    grow = lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1), fan)))
    rounds = F.slice(F.array(*[F.lit(i) for i in range(depth)]), 1, _depth(F.col("n"), fan, depth))
    blocks = blocks.select("group", "block", "n", F.col("nodes")["held"].alias("held"), F.aggregate(rounds, first, grow).alias("levels"))
    blocks = written(blocks, f"manifest-{name}", GROUP_BYTES)
    top = F.element_at("levels", -1)
    upper = blocks.select("group", F.col("block").alias("at"), top.alias("node"), F.col("n"))
    divided = F.col("n") > size
    on = upper.filter(divided).withColumn("n", F.expr(f"(n - 1) div {size} + 1")).withColumn("held", F.col("at"))
    none = F.array().cast(_SEGMENTS)
    if on.isEmpty():
        return blocks.select("group", "held", "levels", none.alias("way"), top.alias("root"))
    # a block of the level above holds many of these: their numbers, and the way up from each
    above = _opened(_tree(on, fan, depth, f"{name}-up"), fan, depth)
    above = above.select(F.col("group").alias("g"), F.col("held").alias("b"), F.col("segments").alias("way"), F.col("root").alias("r"))
    joined = blocks.join(above, blocks["group"].eqNullSafe(above["g"]) & (blocks["block"] == above["b"]), "left")
    return joined.select("group", "held", "levels", F.coalesce("way", none).alias("way"), F.coalesce("r", top).alias("root"))


def _opened(blocks: DataFrame, fan: int, depth: int) -> DataFrame:
    """One row per node of the blocks: group, root, ``held``, and the ``segments`` of its proof, from the node up to the root."""
    at = lambda i, k: F.floor(i / fan**k).cast("int")
    own = lambda i: F.filter(F.array(*[
        F.when(F.size("levels") > k + 1, _siblings(F.get("levels", F.lit(k)), at(i, k), fan)) for k in range(depth)
    ]), lambda s: s.isNotNull())
    segments = F.transform(F.sequence(F.lit(0), F.size("held") - 1), lambda i: F.concat(own(i), "way"))
    return blocks.select("group", "root", F.inline(F.arrays_zip("held", segments.alias("segments"))).alias("held", "segments"))


def fold(start: Column, segments: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(segments, start, lambda node, s: F.sha2(F.concat(s["before"], node, s["behind"]), 256))


def manifest(
    rows: DataFrame, key: str = "doc_id", group: str = "source", columns: Sequence[str] = COLUMNS,
    candidate: Column | None = None, fan: int = FAN, depth: int = DEPTH,
) -> DataFrame:
    """One row per row: key, leaf, subroot (of its group), root, ``segments`` (the siblings before and behind it on each level,
    from the leaf up), and ``candidate``, another leaf to try against the proof (by default the leaf itself)."""
    own = leaf(columns)
    hashed = rows.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").cast("string").alias("group"), own.alias("leaf"),
        (own if candidate is None else candidate).alias("candidate"),
    )
    hashed = written(hashed.withColumn("row", F.monotonically_increasing_id()), "manifest-leaves")
    numbered = number_by_range(hashed, ["group"], ["key", "leaf", "row"], "at")
    # one row per group; a group of many rows has its total attached by a join whose large side Spark can split
    totals = hashed.groupBy("group").agg(F.count("*").alias("n")).withColumnRenamed("group", "g")
    placed = numbered.join(totals, F.col("group").eqNullSafe(F.col("g")))
    held = F.struct("key", "leaf", "candidate")
    below = _tree(placed.select("group", "at", "n", F.col("leaf").alias("node"), held.alias("held")), fan, depth, "rows")
    below = written(below, "manifest-blocks", GROUP_BYTES)
    groups = below.groupBy("group").agg(F.first("root").alias("node"))
    ordered = number_by_range(groups.withColumn("all", F.lit(0)), ["all"], ["group"], "at")
    n = ordered.agg(F.count("*").alias("n")).scalar()
    top = ordered.select(F.col("all").alias("group"), "at", n.alias("n"), "node", F.col("group").alias("held"))
    top = _tree(top, fan, depth, "groups")
    top = _opened(top, fan, depth).select(F.col("root").alias("r"), F.col("held").alias("g"), F.col("segments").alias("up"))
    joined = below.join(top, below["group"].eqNullSafe(top["g"]))
    joined = joined.select("group", "held", "levels", F.concat("way", "up").alias("way"), F.struct(F.col("root").alias("sub"), "r").alias("root"))
    each = _opened(joined, fan, depth)
    return each.select(
        F.col("held.key").alias(key), F.col("held.leaf").alias("leaf"), F.col("root.sub").alias("subroot"), F.col("root.r").alias("root"),
        "segments", F.col("held.candidate").alias("candidate"),
    )


def verified(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """A manifest with the digest of each proof, the root that the candidate leaf leads to, and whether that is the root."""
    proof = F.array_join(F.transform("segments", lambda s: F.concat(s["before"], s["behind"])), "")
    folded = found.select(
        F.col(f"`{key}`"), "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"),
        fold(F.col("candidate"), F.col("segments")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_feeds(key: str = "doc_id", text: str = "text") -> Column:
    """The text as tampering leaves it: rows whose key has an even CRC-32 lose their line feeds."""
    even = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
