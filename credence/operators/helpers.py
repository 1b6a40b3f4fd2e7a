"""Small operators with data semantics: record texts, point metrics, run names, latest replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_text(state: Column, state_format: Column) -> Column:
    """The ``text`` field of a JSON state, else the state."""
    return F.when(state_format == "json", F.coalesce(F.get_json_object(state, "$.text"), state)).otherwise(state)


def is_form(kind: Column) -> Column:
    """Yes/no kinds that depend on the text's form only."""
    from credence.functions.text import FORM_KINDS

    return kind.isin(*FORM_KINDS)


def display_kind(qtype: Column, question_id: Column) -> Column:
    return F.when(qtype == "noul", question_id).otherwise(qtype)


def splits_in_order(results: DataFrame, order: str) -> DataFrame:
    """Splits with their counts, numbered by first appearance."""
    g = results.groupBy("split").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    from pyspark.sql import Window

    return g.withColumn("place", F.row_number().over(Window.orderBy("first"))).drop("first")  # one row a split


def run_name(size: Column, arm: Column, n: Column, seed: Column, noise: Column) -> Column:
    return F.concat(F.lit("v3_"), size, F.lit("_"), arm, F.lit("_n"), n.cast("string"), F.lit("_s"), seed.cast("string"), F.coalesce(F.concat(F.lit("_"), noise), F.lit("")))


def parsed_run_name(name: Column) -> list[Column]:
    """The parts of a run's name; a name of another form has an empty size and arm, and nulls."""
    e = "^v3_([^_]+)_(.+)_n([0-9]+)_s([0-9]+)(?:_(.+))?$"
    part = lambda i: F.regexp_extract(name, e, i)
    return [part(1).alias("size"), part(2).alias("arm"), part(3).try_cast("int").alias("n"), part(4).try_cast("int").alias("seed"), F.nullif(part(5), F.lit("")).alias("noise")]


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    from credence.operators.replies import last_wins

    return last_wins(rows, keys, order)


def long_metrics(table: DataFrame, keys: list[str]) -> DataFrame:
    """Wide metrics as rows of name and value."""
    names = [c for c, t in table.dtypes if c not in keys and t in ("double", "bigint", "int")]
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])
    return table.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.name", "m.value")


def with_label_names(rows: DataFrame, names: DataFrame, index: str = "label") -> DataFrame:
    """Utterances whose label is an index, with the label's name (``names`` has index, name); an index
    without a name is refused where it is found, by a null that later checks see."""
    return rows.join(names.select(F.col("index").alias(index), F.col("name").alias("intent")), index, "left")


def label_gaps(labels: DataFrame, described: DataFrame) -> DataFrame:
    """Labels without a description and descriptions without a label (one column each)."""
    a, b = labels.toDF("label").distinct(), described.toDF("label").distinct()
    missing = a.join(b, "label", "left_anti").withColumn("gap", F.lit("not described"))
    return missing.unionByName(b.join(a, "label", "left_anti").withColumn("gap", F.lit("not a label")))


#: Fixed value: the flip rate of logs that do not state one.
FLIP_RATE = 0.2


def log_metadata(text: Column) -> list[Column]:
    """From a log's JSON metadata: seed, flip rate, and the noise of the run's targets, which older
    runs state as a yes or no."""
    at = lambda path: F.get_json_object(text, path)
    return [at("$.sampling.seed").cast("int").alias("seed"), F.coalesce(at("$.sampling.flip_rate").cast("double"), F.lit(FLIP_RATE)).alias("flip_rate"),
            F.coalesce(at("$.v3.noise"), F.when(at("$.v3.noisy") == "true", "fixed")).alias("noise")]
