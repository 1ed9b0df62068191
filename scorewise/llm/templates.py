"""Line dedup by a tree of log templates, in DataFrame operations only.

The tree has a fixed depth: lines are parted by their number of tokens, then by their ``LEADING`` first tokens, where a token
with a digit counts as variable. In a leaf, a token is kept as constant where it stands at its position in lines of
``MIN_DOCS`` documents or more; all others, and tokens with a digit, are variable fields. The result is the line's template.
A template that occurs in ``MIN_DOCS`` documents and is constant in at least ``CONSTANT`` of its tokens is recurring, and its
lines are dropped from all documents.

Leaves with lines of too few documents hold no recurring template, so only lines of the other leaves go further. Lines are
counted per distinct line before tokens are listed, and a common line or leaf is only ever counted by partial sums or joined
by sort-merge, so none is gathered in one task.

Lines end at a line feed. Lines without tokens are kept and never parsed. Null counts as empty, an empty text has no line.
Documents are told apart by id in the counts (all null ids count as one); what is dropped from a text depends on
the text only, so repeated rows are treated alike. Other columns pass through, one named like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewise.sources.shared import written

from .schemas import passing, whole_row

LEADING = 4
MIN_DOCS = 5
CONSTANT = 0.6
FIELD = "<*>"
SPACES = r"[\x20\x09-\x0D]+"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _words(line: str) -> Column:
    """Tokens of a line that is not blank."""
    return F.split(F.btrim(F.col(line), F.lit(" \t\n\x0b\x0c\r")), SPACES, -1)


def _masked(tokens: Column) -> Column:
    """Tokens with a digit as variable fields."""
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))


def _leaf(words: str, leading: int) -> Column:
    return F.xxhash64(F.size(words), _masked(F.slice(F.col(words), 1, leading)))


def recurring_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", leading: int = LEADING, min_docs: int = MIN_DOCS,
    constant: float = CONSTANT,
) -> tuple[DataFrame, DataFrame]:
    """The lines to drop, as line numbers from 0 per text (known by hash and bytes), and the recurring templates."""
    whole = F.coalesce(F.col(text), F.lit(""))
    known = docs.select(
        F.col(key).alias("_id"), whole.alias("_text"), F.xxhash64(whole).alias("_hash"), F.octet_length(whole).alias("_len")
    )
    lines = known.select("_id", "_hash", "_len", F.posexplode(_lines("_text")).alias("no", "line"))
    lines = lines.filter(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")) != "").withColumn("_words", _words("line"))
    lines = lines.withColumn("leaf", _leaf("_words", leading)).drop("_words")

    leaves = lines.select("leaf", "_id").distinct().groupBy("leaf").count().filter(F.col("count") >= min_docs).select("leaf")
    leaves = written(leaves, "template-leaves")
    candidates = written(lines.join(leaves, "leaf"), "template-lines")

    counted = candidates.select("leaf", "line", "_id").distinct().groupBy("leaf", "line").agg(F.count("*").alias("docs"))
    counted = written(counted.withColumn("line_no", F.monotonically_increasing_id()), "template-counts")
    placed = counted.select("leaf", "line_no", "docs", F.posexplode(_masked(_words("line"))).alias("place", "token"))
    support = placed.filter(F.col("token") != FIELD).groupBy("leaf", "place", "token").agg(F.sum("docs").alias("held"))
    support = written(support.filter(F.col("held") >= min_docs).drop("held"), "template-tokens").withColumn("fixed", F.lit(1))
    formed = placed.join(support, ["leaf", "place", "token"], "left").groupBy("line_no").agg(
        F.sort_array(F.collect_list(F.struct("place", F.when(F.col("fixed") == 1, F.col("token")).otherwise(FIELD).alias("t")))).alias("parts"),
        F.coalesce(F.sum("fixed"), F.lit(0)).alias("fixed"), F.count("*").alias("size"),
    )
    formed = formed.filter(F.col("fixed") >= F.lit(constant) * F.col("size"))
    formed = formed.select("line_no", F.array_join("parts.t", " ").alias("template"))
    formed = written(counted.select("leaf", "line", "line_no").join(formed, "line_no").drop("line_no"), "template-formed")

    seen = candidates.select("leaf", "line", "_id").distinct().join(formed, ["leaf", "line"])
    templates = seen.select("leaf", "template", "_id").distinct().groupBy("leaf", "template").agg(F.count("*").alias("docs"))
    templates = written(templates.filter(F.col("docs") >= min_docs), "template-found")
    dropped = written(formed.join(templates, ["leaf", "template"]).select("leaf", "line"), "template-dropped")
    lost = candidates.join(dropped, ["leaf", "line"]).groupBy("_hash", "_len").agg(F.collect_set("no").alias("_lost"))
    return lost, templates


def without_recurring_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", leading: int = LEADING, min_docs: int = MIN_DOCS,
    constant: float = CONSTANT, names: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """The documents with all their columns, the text without its recurring lines, the lines it had and those dropped."""
    lost, _ = recurring_lines(docs, key, text, leading, min_docs, constant)
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(whole_row(docs), F.xxhash64(whole).alias("_hash"), F.octet_length(whole).alias("_len"))
    joined = keyed.join(lost, ["_hash", "_len"], "left").withColumn("_text", F.col("row")[text])
    some = F.coalesce("_text", F.lit("")) != ""
    split = joined.withColumn("_all", F.when(some, _lines("_text")).otherwise(F.array().cast("array<string>")))
    kept = F.filter("_all", lambda line, no: ~F.array_contains("_lost", no))
    out = F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    columns = [out.alias(c) if c == text else F.col("row")[c].alias(c) for c in passing(docs.columns, names)]
    return split.select(
        *columns, F.size("_all").cast("long").alias(names[0]),
        F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias(names[1]),
    )
