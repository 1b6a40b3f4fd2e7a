"""Building question sets from records, and the gates that check them.

A record is ``record_id, source, intent, domain, text``. Randomness comes from seeded draws per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.draws import digest, uniform
from credence.operators.sampling import exact_sample, option_subset, seeded_rank, share_count, shuffled
from credence.session import discard, ship_code, stored

#: Fixed values of the gates.
BALANCE = (0.4, 0.6)
PHRASING_ONLY = 0.55
POSITION_SD = 4.0
MIN_COUNT = 100
JSON_SHARE, JSON_SLACK = 0.2, 0.005
LIFT_FAIL, LIFT_TEST = 0.10, 0.03
#: Of shuffles: rows of a part that is sorted, about, ranks of a chunk, rows a task holds before it sends
#: them on, and rows of parts that one task gets, about.
PART_ROWS, CHUNK, HELD_ROWS, TASK_ROWS = 1 << 16, 1 << 16, 1 << 20, 1 << 22


def held_out(labels: DataFrame, per_domain: int, seed: str) -> DataFrame:
    """A few intents of each domain, without replacement (columns domain, intent)."""
    return exact_sample(labels, per_domain, f"{seed}:held", F.col("intent"), ["domain"])


def domain_conflicts(pairs: DataFrame) -> DataFrame:
    """Intents that are in more than one domain."""
    return pairs.groupBy("intent").agg(F.countDistinct("domain").alias("n_domains")).where("n_domains > 1")


def pool(records: DataFrame, held: DataFrame, inside: bool = False) -> DataFrame:
    return records.join(held.select("intent"), "intent", "left_semi" if inside else "left_anti")


def choice_questions(records: DataFrame, labels: list[str], k_min: int, k_max: int, keep_gold: float, stream: str) -> DataFrame:
    """Records with options and answer; K is uniform between its bounds, or fixed where they agree."""
    k = F.col("record_id")
    size: Column | int = k_min if k_min == k_max else k_min + F.floor(uniform(f"{stream}:k", k) * (k_max - k_min + 1)).cast("int")
    q = option_subset(F.array(*map(F.lit, labels)), F.col("intent"), k, size, keep_gold, stream)
    return records.withColumn("q", q).select(*records.columns, "q.options", F.col("q.gold").alias("answer"))


def asked_labels(questions: DataFrame, labels: list[str], stream: str, p_distractor: float = 0.8) -> DataFrame:
    """Yes/no questions about a label: half of the rows, exactly, ask for the true one; the others ask
    for another option with a probability, else for a label that is not offered."""
    k = F.col("record_id")
    n = questions.count()
    ranked = seeded_rank(questions, [], digest(f"{stream}:half", k), rows=n)
    yes = F.col("rank") <= F.floor(F.lit(n) / 2)
    offered = F.filter("options", lambda x: (x != F.col("intent")) & (x != "other"))
    outside = F.filter(F.array(*map(F.lit, labels)), lambda x: (x != F.col("intent")) & ~F.array_contains(F.col("options"), x))
    near = (uniform(f"{stream}:near", k) < p_distractor) & (F.size(offered) > 0) | (F.size(outside) == 0)
    pick = lambda a: F.get(shuffled(a, f"{stream}:ask", k), F.lit(0))
    asked = F.when(yes, F.col("intent")).when(near, pick(offered)).otherwise(pick(outside))
    return ranked.select(*questions.columns, asked.alias("asked"), yes.alias("underlying"))


def doubled(records: DataFrame, where: Column) -> DataFrame:
    """Rows that match appear twice."""
    return records.withColumn("copy", F.explode(F.when(where, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))


def rescaled(records: DataFrame, level: str, share: float, stream: str) -> DataFrame:
    """An exact share of the five-level rows moves to three levels (0 0 1 2 2)."""
    n = records.count()
    ranked = seeded_rank(records, [], digest(stream, F.col("record_id")), rows=n)
    short = F.col("rank") <= share_count(share, F.lit(n))
    mapped = F.array(*map(F.lit, [0, 0, 1, 2, 2]))[F.col(level)]
    return ranked.select("record_id", F.when(short, 3).otherwise(5).alias("scale"), F.when(short, mapped).otherwise(F.col(level)).cast("int").alias("level"))


def with_phrasings(questions: DataFrame, templates: int, stream: str) -> DataFrame:
    """Template and polarity for each yes/no question (columns record_id, kind, underlying): in each
    kind and answer, consecutive seeded blocks hold every (template, polarity) pair once."""
    pairs = 2 * templates
    ranked = seeded_rank(questions, ["kind", "underlying"], digest(f"{stream}:rank", F.col("record_id")))
    block = F.floor((F.col("rank") - 1) / pairs)
    every = F.array(*[F.lit(i) for i in range(pairs)])
    order = shuffled(every.cast("array<string>"), f"{stream}:block", F.concat_ws("|", "kind", F.col("underlying").cast("string"), block.cast("string")))
    pick = F.get(order, ((F.col("rank") - 1) % pairs).cast("int")).cast("int")
    negated = pick % 2 == 1
    return ranked.select("record_id", "kind", "underlying", F.floor(pick / 2).cast("int").alias("template"), negated.alias("negated"), (F.col("underlying") != negated).alias("gold"))


def balance(questions: DataFrame) -> DataFrame:
    return questions.groupBy("kind").agg(F.sum(F.col("gold").cast("int")).alias("n_true"), F.sum((~F.col("gold")).cast("int")).alias("n_false"))


def phrasing_report(phrased: DataFrame) -> DataFrame:
    """By kind: shares, and the accuracy of answering each phrasing with its majority."""
    cells = phrased.groupBy("kind", "template", "negated").agg(F.count("*").alias("c"), F.sum(F.col("gold").cast("int")).alias("yes"))
    return cells.groupBy("kind").agg(
        F.sum("c").alias("n"), (F.sum("yes") / F.sum("c")).alias("yes_share"), (F.sum(F.when(F.col("negated"), F.col("c")).otherwise(0)) / F.sum("c")).alias("negated_share"),
        (F.sum(F.greatest("yes", F.col("c") - F.col("yes"))) / F.sum("c")).alias("phrasing_only_accuracy"),
    )


def gold_positions(questions: DataFrame) -> DataFrame:
    """Counts of the answer's position by K, absent positions as 0."""
    at = questions.select(F.size("options").alias("k"), (F.array_position("options", F.col("answer")) - 1).cast("int").alias("position"))
    counts = at.groupBy("k", "position").agg(F.count("*").alias("n"))
    every = counts.select("k").distinct().withColumn("position", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return every.join(counts, ["k", "position"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def position_deviations(positions: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Largest deviation of a position's share from 1/K in binomial standard deviations."""
    total = positions.groupBy("k").agg(F.sum("n").alias("total"), F.max("n").alias("hi"), F.min("n").alias("lo")).where(F.col("total") >= min_count)
    p = 1 / F.col("k")
    sd = F.sqrt(p * (1 - p) / F.col("total"))
    return total.select("k", "total", (F.greatest(F.col("hi") / F.col("total") - p, p - F.col("lo") / F.col("total")) / sd).alias("deviation"))


def held_out_leaks(questions: DataFrame, held: DataFrame) -> DataFrame:
    """Records whose intent, an option or the asked label is held out."""
    used = questions.select("record_id", F.explode(F.array_union("options", F.array("intent", "asked"))).alias("used"))
    return used.join(held.select(F.col("intent").alias("used")).distinct(), "used", "left_semi").select("record_id").distinct()


def order_violations(records: DataFrame) -> DataFrame:
    """Records that break the order rule (column questions: array of type, form): of the questions
    that are no form questions the first is not yes/no, one at most is, and exactly one is not."""
    dependent = F.filter("questions", lambda q: ~q["form"])
    nouls = F.size(F.filter(dependent, lambda q: q["type"] == "noul"))
    bad = (F.get(dependent, F.lit(0))["type"] == "noul") | (nouls > 1) | (F.size(dependent) - nouls != 1)
    return records.where(F.coalesce(bad, F.lit(True))).select("record_id")


def build_gate(phrased: DataFrame, questions: DataFrame, states: DataFrame) -> DataFrame:
    """Failing checks as rows; an empty table passes."""
    rows = []
    b = balance(phrased).withColumn("value", F.col("n_true") / (F.col("n_true") + F.col("n_false")))
    rows.append(b.where(~F.col("value").between(*BALANCE)).select(F.lit("balance").alias("check"), F.col("kind").alias("item"), "value"))
    p = phrasing_report(phrased).where(F.col("phrasing_only_accuracy") > PHRASING_ONLY)
    rows.append(p.select(F.lit("phrasing only"), "kind", "phrasing_only_accuracy"))
    d = position_deviations(gold_positions(questions)).where(F.col("deviation") > POSITION_SD)
    rows.append(d.select(F.lit("position"), F.col("k").cast("string"), "deviation"))
    twice = questions.groupBy("record_id").count().where("count > 1")
    rows.append(twice.select(F.lit("unique id"), F.col("record_id").cast("string"), F.col("count").cast("double")))
    share = states.agg(F.avg((F.col("state_format") == "json").cast("int")).alias("s")).where(F.abs(F.col("s") - JSON_SHARE) > JSON_SLACK)
    rows.append(share.select(F.lit("json share"), F.lit("all"), "s"))
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out


def majority(rows: DataFrame, by: list[str], target: str) -> DataFrame:
    c = rows.groupBy(*by, target).agg(F.count("*").alias("c"))
    return c.groupBy(*by).agg(F.sum("c").alias("n"), (F.max("c") / F.sum("c")).alias("majority"), F.count("*").alias("n_targets"))


def usable_groups(rows: DataFrame, by: list[str], target: str, min_n: int) -> DataFrame:
    return majority(rows, by, target).where((F.col("n") >= min_n) & (F.col("n_targets") >= 2))


def probe_features(questions: DataFrame) -> DataFrame:
    """Sparse features of a question without its text: tokens of the instruction, K, options' tokens."""
    from credence.functions.text import tokens

    words = F.transform(tokens(F.col("instructions")), lambda t: F.concat(F.lit("w:"), t))
    extra = F.array(F.concat(F.lit("k:"), F.size("options").cast("string")))
    options = F.transform("options", lambda o: F.concat(F.lit("o:"), o))
    return questions.withColumn("features", F.array_distinct(F.concat(words, extra, options)))


def cell_lift(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of a probe that answers every ``cell`` with its most common ``target``: accuracy over that of the
    most common target of the group."""
    return lift_of_counts(rows.groupBy(*by, "cell", "target").agg(F.count("*").alias("c")), by)


def lift_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """The lift of that probe from the counts ``c`` of each cell and target."""
    hits = counts.groupBy(*by, "cell").agg(F.max("c").alias("m"), F.sum("c").alias("n")).groupBy(*by).agg((F.sum("m") / F.sum("n")).alias("accuracy"))
    top = counts.groupBy(*by, "target").agg(F.sum("c").alias("c")).groupBy(*by).agg((F.max("c") / F.sum("c")).alias("majority"))
    return hits.join(top, by).select(*by, F.round(F.col("accuracy") - F.col("majority"), 9).alias("lift"))


def _coded(rows: DataFrame, columns: list[str], name: str, values: list[tuple]) -> DataFrame:
    """``rows`` with the number of their values of some columns, nulls included, in place of these."""
    kinds = ", ".join(f"__{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    table = F.broadcast(rows.sparkSession.createDataFrame([(*v, i) for i, v in enumerate(values)], f"{kinds}, __n int"))
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    rest = [c for c in rows.columns if c not in columns]
    return rows.join(table, same).select(*rest, F.col("__n").alias(name))


def dealt_counts(rows: DataFrame, by: list[str], times: int, stream: str) -> DataFrame:
    """``(*by, b, cell, target, c)``: counts of cells and targets after the targets of a group were dealt out
    anew, for b = 1, 2, ...: the target of the k-th row by the ``deal`` digest goes to the k-th by ``seat``.

    What is shuffled of a row and an order is its digest and one code, packed: parts of an order, by the
    first bits of the digest, are sorted in tasks. Then only the sorted codes are cut into chunks of
    equal ranks, where cells meet their targets. Groups, cells and targets must be few.
    """
    spark = rows.sparkSession
    base = rows.groupBy(*by, "cell", "target").agg(F.count("*").alias("c")).collect()  # a row a group, cell and target
    sizes: dict[tuple, int] = {}
    for r in base:
        sizes[tuple(r[c] for c in by)] = sizes.get(tuple(r[c] for c in by), 0) + r["c"]
    groups, cells, targets = list(sizes), list({(r["cell"],) for r in base}), list({(r["target"],) for r in base})
    digits = np.array([max(0, n // PART_ROWS).bit_length() for n in sizes.values()], dtype=np.uint64)
    code = np.dtype(f"<u{1 if max(len(cells), len(targets)) <= 1 << 8 else 4}")
    packed = np.dtype([("high", "<u8"), ("low", "<u8"), ("code", code)])
    coded = _coded(_coded(_coded(rows.select(*by, "record_id", "cell", "target"), by, "g", groups), ["cell"], "cell", cells), ["target"], "target", targets)
    many = coded.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(times))))
    order = lambda name: F.unhex(digest(f"{stream}:{name}", F.col("b"), F.col("record_id"))).alias(name)

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        part, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        place = np.argsort(part, kind="stable")
        parts, at = np.unique(part[place], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(parts), pa.array([x.tobytes() for x in np.split(rows[place], at[1:])], pa.binary())], names=["part", "rows"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            g, b, cell, target = (batch.column(c).to_numpy().astype(np.int64) for c in ("g", "b", "cell", "target"))
            for side, (name, codes) in enumerate((("seat", cell), ("deal", target))):
                halves = np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
                one = np.empty(len(g), dtype=packed)
                one["high"], one["low"], one["code"] = halves[:, 0], halves[:, 1], codes
                bucket = (halves[:, 0] >> np.uint64(1)) >> (np.uint64(63) - digits[g])
                held.append(((g * times + b - 1) << 32 | bucket.astype(np.int64) << 1 | side, one))
            n += batch.num_rows
            if n >= HELD_ROWS:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)

    def sort(part: pa.Table) -> pa.Table:
        got = np.frombuffer(b"".join(part.column("rows").to_pylist()), dtype=packed)
        codes = got["code"][np.lexsort((got["low"], got["high"]))]
        return pa.table({"part": part.column("part").slice(0, 1), "n": pa.array([len(codes)], pa.int64()), "codes": pa.array([codes.tobytes()], pa.binary())})

    def count(chunk: pa.Table) -> pa.Table:
        pieces = sorted(zip(*(chunk.column(c).to_pylist() for c in ("side", "start", "codes")), strict=True))
        cell, target = (np.frombuffer(b"".join(p[2] for p in pieces if p[0] == side), dtype=code).astype(np.int64) for side in (0, 1))
        both, c = np.unique(cell * len(targets) + target, return_counts=True)
        return pa.table({"order": pa.array([chunk.column("order")[0].as_py()] * len(both), pa.int64()), "cell": (both // len(targets)).astype(np.int32), "target": (both % len(targets)).astype(np.int32), "c": c.astype(np.int64)})

    ship_code(spark)
    tasks = max(spark.sparkContext.defaultParallelism, -(-2 * times * sum(sizes.values()) // TASK_ROWS))
    parts = many.select("g", "b", "cell", "target", order("seat"), order("deal")).mapInArrow(split, "part long, rows binary")
    ranked = stored(parts.repartition(tasks, "part").groupBy("part").applyInArrow(sort, "part long, n long, codes binary"))
    before = Window.partitionBy("order", "side").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as parts
    keyed = ranked.select("part", "n", F.shiftright("part", 32).alias("order"), (F.col("part") % 2).cast("int").alias("side"))
    begins = keyed.select("part", "order", "side", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    cut = ranked.join(begins, "part").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("begin") / CHUNK), F.floor((F.col("begin") + F.col("n") - 1) / CHUNK))))
    start = F.greatest("begin", F.col("chunk") * CHUNK)
    size = F.least(F.col("begin") + F.col("n"), (F.col("chunk") + 1) * CHUNK) - start
    piece = F.substring("codes", ((start - F.col("begin")) * code.itemsize + 1).cast("int"), (size * code.itemsize).cast("int"))
    pieces = cut.select("order", "chunk", "side", start.alias("start"), piece.alias("codes")).repartition(max(1, tasks // 4), "order", "chunk")
    met = pieces.groupBy("order", "chunk").applyInArrow(count, "order long, cell int, target int, c long").groupBy("order", "cell", "target").agg(F.sum("c").alias("c"))
    counts = stored(met)
    discard(ranked)
    named = counts
    for columns, name, values in ((by, "g", groups), (["cell"], "cell", cells), (["target"], "target", targets)):
        kinds = ", ".join(f"__{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
        table = F.broadcast(spark.createDataFrame([(*v, i) for i, v in enumerate(values)], f"{kinds}, __n int"))
        key = F.floor(F.col("order") / times) if name == "g" else F.col(name)
        named = named.join(table, key == F.col("__n")).drop("__n")
    return named.select(*[F.col(f"__{c}").alias(c) for c in by], (F.col("order") % times + 1).cast("int").alias("b"), F.col("__cell").alias("cell"), F.col("__target").alias("target"), "c")


def lift_gate(lifts: DataFrame, nulls: DataFrame, by: list[str]) -> DataFrame:
    """``lifts`` (by, lift) against permutation lifts (by, lift): p-value and verdict. Fails above the
    hard limit, or above the soft one and the 99th order statistic of the permutations."""
    j = lifts.join(nulls.select(*by, F.col("lift").alias("null_lift")), by, "left")
    g = j.groupBy(*by, "lift").agg(F.count("null_lift").alias("b"), F.sum((F.col("null_lift") >= F.col("lift")).cast("int")).alias("above"),
                                   F.sort_array(F.collect_list("null_lift")).alias("sorted"))
    p99 = F.get("sorted", F.greatest(F.lit(0), F.ceil(F.col("b") * 0.99).cast("int") - 1))
    fail = (F.col("lift") > LIFT_FAIL) | ((F.col("lift") > LIFT_TEST) & (F.col("lift") > p99))
    return g.select(*by, "lift", ((1 + F.coalesce("above", F.lit(0))) / (1 + F.col("b"))).alias("p_value"), F.coalesce(fail, F.lit(False)).alias("fails"))


def epoch(rows: DataFrame, length: str, longest: int, size: int, seed: str) -> DataFrame:
    """A seeded order of the rows that fit, cut into micro-batches."""
    ranked = seeded_rank(rows.where(F.col(length) <= longest), [], digest(f"{seed}:epoch", F.col("record_id")))
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size))


def assembled(verbatim: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """The verbatim rows, then those of the rest that are not among them."""
    return verbatim.unionByName(rest.join(verbatim.select(key), key, "left_anti"))


def fixed_subset(records: DataFrame, limit: int, smaller: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """A stratified subset, and a smaller one of the rows in it."""
    from credence.operators.sampling import stratified_sample

    one = stratified_sample(records, limit, seed)
    return one, stratified_sample(one, smaller, f"{seed}:sub")


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; the limit is applied before the shuffle."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__i") <= n).drop("__i")
