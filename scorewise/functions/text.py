"""Text and JSON expressions; every one reads the whole text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JUDGEMENT_SCHEMA = "correctness STRING, specificity STRING, completeness STRING, fluency STRING, justification STRING"
_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
CRITERIA = ("correctness", "specificity", "completeness", "fluency")
FAILURE = "ERROR"


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace, line breaks included."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def valid_text(text: Column) -> Column:
    """Non-empty and not a recorded failure."""
    return F.coalesce((text != "") & ~F.startswith(text, F.lit(FAILURE)), F.lit(False))


def score_text(scores: Column, digits: int = 4) -> Column:
    """``0.1234, 0.5678``"""
    return F.array_join(F.transform(scores, lambda s: F.format_string(f"%.{digits}f", s)), ", ")


def labelled_score_text(pairs: Column, label: str, digits: int) -> Column:
    """``label i=0.123, label j=0.456`` from an array of ``(idx, score)`` structs."""
    fmt = f"{label} %d=%.{digits}f"
    return F.array_join(F.transform(pairs, lambda p: F.format_string(fmt, p["idx"], p["score"])), ", ")


def word_count(text: Column) -> Column:
    """Whitespace-separated words of the whole text."""
    return F.regexp_count(text, F.lit(r"\S+"))


def is_json_object(body: Column) -> Column:
    """Whether the whole text is one JSON object in double quotes, with nothing after it.

    The parser stops at the end of a first value. So the text is read once as the only element of a list and once as a
    member of an object: whatever follows it breaks one of the two."""
    listed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>", _STRICT)
    member = F.from_json(F.concat(F.lit('{"v":'), body, F.lit("}")), "v string", _STRICT)
    whole = F.startswith(body, F.lit("{")) & (F.size(listed) == 1) & F.get(listed, F.lit(0)).isNotNull() & member["v"].isNotNull()
    return F.coalesce(whole, F.lit(False))


def parse_reply(raw: Column) -> Column:
    """``explanation`` of a strict JSON reply, with or without a code fence; else the raw text."""
    text = strip(raw)
    fenced = F.split_part(text, F.lit("```"), F.lit(2))
    fenced = F.when(F.startswith(fenced, F.lit("json")), F.substring(fenced, 5, 2147483647)).otherwise(fenced)
    body = F.when(F.startswith(text, F.lit("```")), fenced).otherwise(text)
    body = strip(body)
    return F.coalesce(F.when(is_json_object(body), F.get_json_object(body, "$.explanation")), text)


def turn_label(turns: Column) -> Column:
    """Label carried by the first assistant turn; its raw text when that is not one strict JSON object."""
    value = F.get(F.filter(turns, lambda t: t["from"] == "assistant"), F.lit(0))["value"]
    return F.coalesce(F.when(is_json_object(strip(value)), F.get_json_object(value, "$.explanation")), value)


def explanation_json(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("explanation")))


def judge_prompt(human: Column, ai: Column) -> Column:
    """Message to the judge."""
    # fixed value: the form its rubric expects
    return F.concat(
        F.lit('HUMAN ground-truth explanation:\n"'), human,
        F.lit('"\n\nAI-generated explanation:\n"'), ai, F.lit('"'),
    )


def parse_judgement(reply: Column) -> Column:
    """Struct of four ratings and a justification.

    Ratings may be written as ``4``, ``4.0`` or ``"4"``; one outside 1..5 or between two numbers becomes null. A reply that
    is not one strict JSON object keeps its row with null ratings and an ``ERROR:`` justification.
    """
    body = strip(reply)
    parsed, usable = F.from_json(body, JUDGEMENT_SCHEMA, _STRICT), is_json_object(body)
    number = {c: parsed[c].try_cast("double") for c in CRITERIA}
    ratings = [
        F.when(usable & number[c].between(1, 5) & (number[c] == F.floor(number[c])), number[c].cast("int")).alias(c) for c in CRITERIA
    ]
    failure = F.concat(F.lit(f"{FAILURE}: "), F.coalesce(reply, F.lit("no reply")))
    return F.struct(*ratings, F.when(usable, parsed["justification"]).otherwise(failure).alias("justification"))
