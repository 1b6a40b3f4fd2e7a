"""Typed requests: validation as rows of violations, decoding, rendering, answers from distributions.

A request is ``id, state, questions``; a question is a struct of id, type, instructions and options
(struct of label and description). Where a service would raise an error, a batch returns rows
``(id, path, reason)``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.functions import distributions as D
from credence.functions.draws import digest

# Limits of requests.
STATE_LIMIT = 8000
CHOICE_OPTIONS = (2, 26)
SCORE_LEVELS = (2, 10)
QUESTION_ID = "^[a-z0-9_]+$"
TYPES = ("noul", "choice", "score")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OPTION = T.StructType([T.StructField("label", T.StringType()), T.StructField("description", T.StringType())])
QUESTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("instructions", T.StringType()), T.StructField("options", T.ArrayType(OPTION)),
])
REQUEST = T.StructType([T.StructField("id", T.LongType()), T.StructField("state", T.StringType()), T.StructField("questions", T.ArrayType(QUESTION))])


def render_state(state_json: Column) -> Column:
    """JSON objects and arrays as text with two spaces of indent, other characters kept; strings as
    they are; null for what is neither or not JSON. No built-in function writes this form."""
    def one(x: str | None) -> str | None:
        try:
            v = json.loads(x, parse_constant=lambda c: 1 / 0) if x is not None else None
        except (ValueError, ZeroDivisionError):
            return None
        return v if isinstance(v, str) else json.dumps(v, indent=2, ensure_ascii=False) if isinstance(v, (dict, list)) else None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(state_json)


def line_reason(text: Column) -> Column:
    """Why a line is refused: empty, line breaks, then white space at its ends."""
    return F.when(text == "", "must not be empty").when(text.rlike("[\r\n]"), "must not contain line breaks").when(text.rlike(r"^\s|\s$"), "must not have leading or trailing whitespace")


def instruction_reason(text: Column) -> Column:
    return F.when(text.isNull() | text.rlike(r"^\s*$"), "must be a non-empty string").otherwise(line_reason(text))


def _first(reasons: Column) -> Column:
    return F.get(F.filter(reasons, lambda x: x.isNotNull()), F.lit(0))


def question_reason(q: Column) -> Column:
    """The first rule that a question breaks, or null."""
    o, t = q["options"], q["type"]
    labels = F.transform(o, lambda x: x["label"])
    distinct = F.size(F.array_distinct(labels)) == F.size(labels)
    keys = F.when((t == "noul") & (F.size(F.array_except(labels, F.array(F.lit("true"), F.lit("false")))) > 0), "criteria may hold true and false only")
    choice = F.when((t == "choice") & ~F.size(o).between(*CHOICE_OPTIONS), "must have 2 to 26 options").when((t == "choice") & ~distinct, "labels must be unique")
    score = F.when((t == "score") & ~F.size(o).between(*SCORE_LEVELS), "must have 2 to 10 levels")
    lines = _first(F.transform(labels, line_reason))
    texts = _first(F.transform(o, lambda x: F.when(x["description"].isNotNull(), line_reason(x["description"]))))
    kind = F.when(t.isNull(), "missing type").when(~t.isin(*TYPES), "unknown type")
    return F.coalesce(kind, instruction_reason(q["instructions"]), keys, choice, score, F.when(t != "score", lines), texts)


def violations(requests: DataFrame) -> DataFrame:
    """One row for each request that breaks a rule, with the first: its state, then its questions in order."""
    ids = F.transform("questions", lambda q: q["id"])
    checked = F.transform("questions", lambda q: F.struct(q["id"].alias("path"), F.coalesce(F.when(~q["id"].rlike(QUESTION_ID), "bad question id"), question_reason(q)).alias("reason")))
    first = F.get(F.filter(checked, lambda x: x["reason"].isNotNull()), F.lit(0))
    whole = F.when(F.col("state").isNull(), "missing state").when(F.length("state") > STATE_LIMIT, "state is too long")
    counts = F.when(F.size("questions") == 0, "needs a question").when(F.size(F.array_distinct(ids)) < F.size(ids), "question ids must be unique")
    v = requests.select("id", F.when(whole.isNotNull(), F.struct(F.lit("state").alias("path"), whole.alias("reason"))).when(counts.isNotNull(), F.struct(F.lit("questions").alias("path"), counts.alias("reason"))).otherwise(first).alias("v"))
    return v.where("v is not null").select("id", "v.path", "v.reason")


ANSWER_SCHEMA = "type string, value double, label string, confidence double, probabilities map<string,double>"


def decoded_answers(lines: DataFrame) -> DataFrame:
    """Answers from JSON text (columns id, line) with the path of the first missing field, if any."""
    a = F.from_json("line", ANSWER_SCHEMA)
    missing = F.when(F.col("a").isNull() | F.col("a.type").isNull(), "type").when((F.col("a.type") == "noul") & F.col("a.value").isNull(), "value")
    missing = missing.when((F.col("a.type") == "choice") & F.col("a.label").isNull(), "label").when((F.col("a.type") != "noul") & F.col("a.probabilities").isNull(), "probabilities")
    return lines.withColumn("a", a).select("id", "a.type", missing.alias("missing"), F.when(missing.isNull(), F.coalesce("a.value", F.col("a.probabilities")[F.col("a.label")])).alias("value"))


def record_mismatches(records: DataFrame) -> DataFrame:
    """Records whose gold keys (column gold: map) are not exactly their question ids."""
    ids = F.array_sort(F.transform("questions", lambda q: q["id"]))
    return records.where(ids != F.array_sort(F.map_keys("gold"))).select("id")


def repeated_keys(body: Column) -> Column:
    """True for JSON text that is malformed or repeats a key at any depth."""
    return F.try_parse_json(body).isNull()


def answer(qtype: Column, labels: Column, probs: Column) -> Column:
    """The answer to one question from its distribution, renormalised; values rounded to 4 decimals after deriving."""
    r4 = lambda x: F.round(x, 4)

    def build(p: Column) -> Column:
        best = D.argmax(p)
        return F.struct(
            F.when(qtype == "noul", r4(p[0])).when(qtype == "score", r4(D.expected_level(p))).alias("value"), F.when(qtype == "choice", F.get(labels, best)).alias("label"),
            F.when(qtype != "noul", F.map_from_arrays(labels, F.transform(p, r4))).alias("probabilities"), F.when(qtype != "noul", r4(D.entropy_confidence(p))).alias("confidence"),
        )

    return D.let(D.let(D.total(probs), lambda s: F.transform(probs, lambda x: x / s)), build)


def route(confidence: Column, threshold: float) -> Column:
    return F.when(confidence >= threshold, "automatic").otherwise("escalate")


def option_lines(options: Column) -> Column:
    """One line an option: letter, label, and the description after a colon where there is one."""
    letters = F.array(*map(F.lit, LETTERS))
    return F.transform(options, lambda o, i: F.concat(F.get(letters, i), F.lit(". "), o["label"], F.when(o["description"].isNull(), "").otherwise(F.concat(F.lit(": "), o["description"]))))


def render_question(q: Column) -> Column:
    default = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(None).cast("string").alias("description")) for x in ("yes", "no")])
    options = F.when((q["type"] == "noul") & (F.size(q["options"]) == 0), default).otherwise(q["options"])
    return F.concat_ws("\n", q["instructions"], F.array_join(option_lines(options), "\n"))


def render_text(requests: DataFrame) -> DataFrame:
    parts = F.transform("questions", render_question)
    return requests.select("id", F.concat_ws("\n\n", F.col("state"), F.array_join(parts, "\n\n")).alias("text"))


def shuffle_options(rows: DataFrame, stream: str) -> DataFrame:
    """Choice options in a seeded order; the gold index moves with its label (columns record_id, qtype, labels, gold)."""
    k = F.col("record_id")
    order = F.array_sort(F.transform("labels", lambda x: F.struct(digest(stream, k, x).alias("d"), x.alias("x"))))
    moved = F.when(F.col("qtype") == "choice", F.transform(order, lambda s: s["x"])).otherwise(F.col("labels"))
    return rows.select("record_id", moved.alias("labels"), (F.array_position(moved, F.get("labels", F.col("gold"))) - 1).cast("int").alias("gold"))
