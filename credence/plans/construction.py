"""Queries of the construction and sampling section and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from credence.operators import construction as C
from credence.operators import probes as P
from credence.operators import sampling as S
from credence.operators import text as X
from credence.plans import text as PT
from credence.plans.fixtures import oracle, sql_uniform
from credence.plans.metrics import r, rounded
from credence.session import tables

LABELS = [f"src{i}" for i in range(20)]
#: Shuffles of the targets that a lift is held against.
NULLS = 200


def records(s, d):
    t = tables(s, d, "documents")
    return t.select(F.col("doc_id").alias("record_id"), F.col("lang").alias("source"), F.when(F.col("source") == "src0", "oos").otherwise(F.col("source")).alias("intent"),
                    F.concat(F.lit("d"), F.regexp_extract("source", "[0-9]+", 0).cast("int") % 4).alias("domain"), F.col("n_chars"), "text")


def intents(s, d):
    return records(s, d).select("domain", "intent").distinct()


def held(s, d):
    return C.held_out(intents(s, d), 2, "s0")


def known(s, d):
    return records(s, d).where("intent <> 'oos'").drop("text")


def questions(s, d):
    return C.choice_questions(known(s, d), LABELS[1:], 3, 8, 0.8, "c6")


def asked(s, d):
    return C.asked_labels(questions(s, d), LABELS[1:], "c8")


def phrased(s, d):
    return C.with_phrasings(asked(s, d).select("record_id", F.col("source").alias("kind"), "underlying"), 2, "c17")


def shown(df, *cols):
    return df.select(*cols, F.array_join("options", ",").alias("options"))


def halves(s, d):
    q = C.doubled(records(s, d).select("record_id", "intent"), F.col("intent") == "oos")
    q = q.join(asked(s, d).select("record_id", "underlying"), "record_id", "left")
    return q.groupBy((F.col("intent") == "oos").alias("oos")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("underlying").cast("int"), F.lit(0))).alias("n_yes"))


def structure(s, d):
    """Question lists of each record, some of them in a bad order."""
    k = F.col("record_id")
    q = lambda t, f=False: F.struct(F.lit(t).alias("type"), F.lit(f).alias("form"))
    lists = F.when(k % 7 == 0, F.array(q("noul"), q("choice"))).when(k % 7 == 1, F.array(q("choice"), q("noul"), q("noul"))).when(k % 7 == 2, F.array(q("noul", True), q("score"), q("noul")))
    lists = lists.when(k % 7 == 3, F.array(q("choice"), q("score"))).otherwise(F.array(q("choice"), q("noul"), q("noul", True)))
    return records(s, d).select("record_id", lists.alias("questions"))


def leaks(s, d):
    return C.held_out_leaks(asked(s, d), held(s, d))


def celled(s, d):
    """Records with the class of their length, the one feature of a small probe for the domain."""
    return known(s, d).select("source", "record_id", F.least(F.floor(F.col("n_chars") / 700), F.lit(6)).alias("cell"), F.col("domain").alias("target"))


def lifts(s, d):
    """The gate on the lift of that probe, which answers each class with its most common domain: over
    the majority of the source, against the lifts of the same probe on shuffled domains."""
    base = celled(s, d)
    null = C.lift_of_counts(C.dealt_counts(base, ["source"], NULLS, "c28"), ["source", "b"])
    return C.lift_gate(C.cell_lift(base, ["source"]), null.drop("b"), ["source"])


def broken(s, d):
    """Questions and states that fail every check: one kind always true, answers first, repeated ids, too much JSON."""
    p = phrased(s, d).withColumn("gold", (F.col("kind") == "en") | F.col("gold"))
    q = questions(s, d).withColumn("options", F.concat(F.array("answer"), F.array_except("options", F.array("answer"))))
    w = X.wrap_states(tables(s, d, "documents").select("doc_id", "text"), "doc_id")
    w = w.withColumn("state_format", F.when(F.col("doc_id") % 2 == 0, "json").otherwise(F.col("state_format")))
    return p, q.unionByName(q.where("record_id % 97 = 0")), w


def gates(s, d):
    good = C.build_gate(phrased(s, d), questions(s, d), X.wrap_states(tables(s, d, "documents").select("doc_id", "text"), "doc_id"))
    return good.withColumn("data", F.lit("built")).unionByName(C.build_gate(*broken(s, d)).withColumn("data", F.lit("broken")))


def probed(s, d):
    """Yes/no questions with their features, by the record's source."""
    q = asked(s, d).withColumn("instructions", F.concat(F.lit("Does this fit: "), "asked", F.lit("?")))
    return C.probe_features(q).withColumn("t", F.col("underlying").cast("string"))


#: Prefixes of the features of a family, which is probed by itself.
FAMILIES = {"words": "w:", "options": "k:", "labels": "o:"}


def families(s, d):
    """The questions once for each family of features, with a few columns more for the structure."""
    q = probed(s, d)
    parts = F.array(*[F.struct(F.lit(n).alias("family"), F.expr(f"filter(features, f -> startswith(f, '{p}'))").alias("features")) for n, p in FAMILIES.items()])
    return q.select("record_id", "source", "t", F.explode(parts).alias("p")).select("record_id", "source", "t", "p.*")


def probe(s, d):
    q = probed(s, d).withColumn("probe", F.lit("asked"))
    return P.probe_lifts(q, ["probe"], "t").select(F.col("g").alias("probe"), "model", "n", "majority", "accuracy", "lift")


def probe_split(s, d):
    """Lift of each model for each source and family of features, and the gate's verdict on it."""
    g = F.split("g", "/")
    got = P.gated_probes(families(s, d), ["source", "family"], "t", permutations=NULLS, min_n=20)
    return got.select(g[0].alias("source"), g[1].alias("family"), "model", "n", "majority", "accuracy", "lift", "p_value", "fails")


def scaled(s, d):
    o = tables(s, d, "orders").select(F.col("o_orderkey").alias("record_id"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("level"))
    return C.rescaled(o, "level", 0.3, "c10")


def allocated(s, d):
    """Parts of 37 by source, and of 40 by a finer key whose groups of one record overshoot."""
    by_source = S.allocate(records(s, d).groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")), 37)
    fine = records(s, d).select(F.concat("source", F.least(F.floor(F.col("n_chars") / 500), F.lit(60)).cast("string")).alias("name"))
    return by_source.unionByName(S.allocate(fine.groupBy("name").agg(F.count("*").alias("n")), 40)).select("name", "n", "given")


QUERIES = {
    "c2_option_order": lambda s, d: known(s, d).select("record_id", F.array_join(S.shuffled(F.array(*map(F.lit, LABELS)), "c2", F.col("record_id")), ",").alias("options")),
    "c3_held_out": held,
    "c4_domain_conflicts": lambda s, d: C.domain_conflicts(records(s, d).select("intent", F.col("source").alias("domain"))),
    "c5_pool": lambda s, d: X.keep(C.pool(records(s, d), held(s, d)), PT.excluded(s, d)).select("record_id"),
    "c6_option_subset": lambda s, d: shown(questions(s, d), "record_id", "answer"),
    "c7_fixed_options": lambda s, d: shown(C.choice_questions(known(s, d), LABELS[1:], 5, 5, 1.0, "c7"), "record_id", "answer"),
    "c8_asked_labels": lambda s, d: asked(s, d).select("record_id", "asked", "underlying"),
    "c9_exact_halves": halves,
    "c10_rescaled": scaled,
    "c11_stratified": lambda s, d: S.exact_sample(records(s, d).where("n_chars <= 2000"), 10, "c11", F.col("record_id"), ["source"]).select("record_id", "source"),
    "c12_uniform_sample": lambda s, d: S.exact_sample(records(s, d), 100, "c12", F.col("record_id")).select("record_id"),
    "c13_matched_asks": lambda s, d: S.matched_asks(known(s, d).select("record_id", "intent"), "intent", "record_id", "c13"),
    "c14_allocate": allocated,
    "c15_sample_records": lambda s, d: S.stratified_sample(records(s, d).select("record_id", "source", "intent"), 150, "c15"),
    "c16_fixed_subset": lambda s, d: C.fixed_subset(records(s, d).select("record_id", "source", "intent"), 150, 60, "c15")[1],
    "c17_phrasings": phrased,
    "c18_balance": lambda s, d: C.balance(phrased(s, d)),
    "c19_phrasing_report": lambda s, d: rounded(C.phrasing_report(phrased(s, d))),
    "c20_gold_positions": lambda s, d: C.gold_positions(questions(s, d)),
    "c20_position_deviations": lambda s, d: rounded(C.position_deviations(C.gold_positions(questions(s, d)), 50)),
    "c21_held_out_leaks": leaks,
    "c22_order_violations": lambda s, d: C.order_violations(structure(s, d)),
    "c23_score_distribution": lambda s, d: scaled(s, d).groupBy("scale", "level").agg(F.count("*").alias("n")),
    "c24_build_gate": lambda s, d: rounded(gates(s, d)),
    "c25_probe_features": lambda s, d: C.probe_features(asked(s, d).withColumn("instructions", F.concat(F.lit("Does this fit: "), "asked", F.lit("?")))).select("record_id", F.size("features").alias("n_features")),
    "c26_usable_groups": lambda s, d: rounded(C.usable_groups(known(s, d), ["source"], "domain", 20)),
    "c27_probe_accuracy": probe,
    "c28_lift_gate": lambda s, d: rounded(lifts(s, d)),
    "c29_probe_split": probe_split,
    "c30_epoch": lambda s, d: C.epoch(records(s, d).select("record_id", "n_chars"), "n_chars", 2000, 16, "c30"),
    "c31_assembled": lambda s, d: C.assembled(S.exact_sample(records(s, d), 50, "c31", F.col("record_id")).select("record_id", "source"), records(s, d).select("record_id", "source").where("record_id % 2 = 0"), "record_id"),
}


def sql_shuffled(items: str, stream: str, key: str) -> str:
    return f"list_transform(list_sort(list_transform({items}, lambda x: {{'d': md5('{stream}:' || CAST({key} AS VARCHAR) || ':' || x), 'x': x}})), lambda s: s.x)"


def sql_options(k: str, keep: float, stream: str) -> str:
    wrong = sql_shuffled(f"list_filter({LABELS[1:]}, lambda x: x <> intent)", f"{stream}:pick", "record_id")
    return f"""
    SELECT *, {sql_shuffled(f"list_concat(list_concat(wrong[1:k - 1 - CAST(kept AS INT)], CASE WHEN kept THEN [intent] ELSE [] END), ['other'])", f"{stream}:order", "record_id")} AS options,
      CASE WHEN kept THEN intent ELSE 'other' END AS answer
    FROM (SELECT *, {wrong} AS wrong, {sql_uniform(f"{stream}:keep", "record_id")} < {keep} AS kept, {k} AS k FROM known)"""


def sql_sample(limit: int, seed: str, of: str) -> str:
    """Shares by largest remainder (enough for totals that the one-at-least rule does not overshoot), then rounds."""
    return f"""
    SELECT record_id, source, intent FROM (
      SELECT t.*, CASE WHEN intent = 'oos' THEN depth <= n_oos ELSE row_number() OVER (PARTITION BY t.source, intent = 'oos' ORDER BY depth, md5('{seed}:intents:' || t.source || ':' || intent)) <= want - n_oos END AS chosen
      FROM (SELECT *, row_number() OVER (PARTITION BY source, intent ORDER BY md5('{seed}:depth:' || record_id)) AS depth FROM {of}) t
      JOIN (SELECT source, want, CASE WHEN oos > 0 THEN least(oos, greatest(1, round_even(want * oos / n, 0))) ELSE 0 END AS n_oos FROM (
        SELECT a.*, whole + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, source) <= {limit} - sum(whole) OVER () THEN 1 ELSE 0 END AS want
        FROM (SELECT source, count(*) AS n, sum(CAST(intent = 'oos' AS INT)) AS oos, {limit} * count(*) / (SELECT count(*) FROM {of}) AS share, greatest(1, floor({limit} * count(*) / (SELECT count(*) FROM {of}))) AS whole FROM {of} GROUP BY source) a)) p USING (source)
    ) WHERE chosen"""


def sql_allocated(of: str, total: int) -> str:
    """Units one by one: each group has its first units (the whole share, one at least), all its next
    units are lined up by fraction, and what is too much is taken from a line of all units."""
    return f"""
    WITH shared AS (SELECT name, n, {total} * n / (SELECT sum(n) FROM {of}) AS share FROM {of}),
    begun AS (SELECT *, CAST(least(n, greatest(1, floor(share))) AS BIGINT) AS whole FROM shared),
    missing AS (SELECT {total} - sum(whole) AS m FROM begun),
    plus AS (SELECT name FROM begun WHERE whole < n QUALIFY row_number() OVER (ORDER BY share - floor(share) DESC, name) <= (SELECT m FROM missing)),
    units AS (SELECT name, whole - u - share AS worth FROM (SELECT *, unnest(range(whole)) AS u FROM begun)),
    minus AS (SELECT name, count(*) AS back FROM (SELECT name FROM units QUALIFY row_number() OVER (ORDER BY worth DESC, name) <= -(SELECT m FROM missing)) GROUP BY name)
    SELECT name, n, whole + CAST(name IN (SELECT name FROM plus) AS INT) - coalesce(back, 0) AS given FROM begun LEFT JOIN minus USING (name)"""


#: A permutation, then the rows that got their own label in the order of labels; no label has more
#: than half of those in the test tables, which the query checks by giving no row otherwise.
_ASKS = """
WITH dealt AS (
  SELECT a.record_id, a.intent AS own, b.intent AS got FROM (SELECT *, row_number() OVER (ORDER BY md5('c13:seat:' || record_id)) AS i FROM known) a
  JOIN (SELECT *, row_number() OVER (ORDER BY md5('c13:deal:' || record_id)) AS i FROM known) b USING (i)
), clash AS (
  SELECT *, row_number() OVER (ORDER BY own, md5('c13:turn:' || record_id)) - 1 AS place, count(*) OVER () AS total, (SELECT max(c) FROM (SELECT count(*) AS c FROM dealt WHERE own = got GROUP BY own)) AS most FROM dealt WHERE own = got
)
SELECT d.record_id, own AS intent, coalesce(t.asked, d.got) AS asked FROM dealt d
LEFT JOIN (SELECT x.record_id, y.own AS asked FROM clash x JOIN clash y ON y.place = (x.place + x.most) % x.total) t USING (record_id)
WHERE NOT EXISTS (SELECT 1 FROM clash WHERE 2 * most > total)"""
def sql_cell_lift(by: str, of: str) -> str:
    cells = f"(SELECT {by}, cell, target, count(*) AS c FROM {of} GROUP BY ALL)"
    return f"""
    SELECT h.*, round(hits / n - majority, 9) AS lift FROM (SELECT {by}, sum(m) AS hits, sum(n) AS n FROM (SELECT {by}, cell, max(c) AS m, sum(c) AS n FROM {cells} GROUP BY {by}, cell) GROUP BY {by}) h
    JOIN (SELECT {by}, max(c) / sum(c) AS majority FROM (SELECT {by}, target, sum(c) AS c FROM {cells} GROUP BY {by}, target) GROUP BY {by}) USING ({by})"""


_POSITIONS = "SELECT CAST(k.k AS INT) AS k, CAST(p AS INT) AS position, coalesce(n, 0) AS n FROM (SELECT DISTINCT len(options) AS k, unnest(range(len(options))) AS p FROM {q}) k LEFT JOIN (SELECT len(options) AS k, list_position(options, answer) - 1 AS p, count(*) AS n FROM {q} GROUP BY ALL) c USING (k, p)"


def sql_gate(data: str, phrased: str, questions: str, wrapped: str) -> str:
    only = f"(SELECT kind, sum(greatest(yes, c - yes)) / sum(c) AS alone FROM (SELECT kind, count(*) AS c, sum(CAST(gold AS INT)) AS yes FROM {phrased} GROUP BY kind, template, negated) GROUP BY kind)"
    off = f"(SELECT k, sum(n) AS total, max(abs(n / t - 1 / k)) / sqrt(1 / k * (1 - 1 / k) / sum(n)) AS deviation FROM (SELECT *, sum(n) OVER (PARTITION BY k) AS t FROM ({_POSITIONS.format(q=questions)})) GROUP BY k)"
    parts = [
        f"SELECT 'balance' AS \"check\", kind AS item, avg(CAST(gold AS INT)) AS value FROM {phrased} GROUP BY kind HAVING avg(CAST(gold AS INT)) NOT BETWEEN 0.4 AND 0.6",
        f"SELECT 'phrasing only', kind, alone FROM {only} WHERE alone > 0.55", f"SELECT 'position', CAST(k AS VARCHAR), deviation FROM {off} WHERE total >= 100 AND deviation > 4",
        f"SELECT 'unique id', CAST(record_id AS VARCHAR), count(*) FROM {questions} GROUP BY record_id HAVING count(*) > 1",
        f"SELECT 'json share', 'all', avg(CAST(json AS INT)) FROM {wrapped} HAVING abs(avg(CAST(json AS INT)) - 0.2) > 0.005",
    ]
    return f"SELECT '{data}' AS data, * FROM ({' UNION ALL '.join(parts)})"


_FX = PT._FX | {
    "records": "SELECT doc_id AS record_id, lang AS source, CASE WHEN source = 'src0' THEN 'oos' ELSE source END AS intent, 'd' || CAST(regexp_extract(source, '[0-9]+') AS INT) % 4 AS domain, n_chars, text FROM documents",
    "known": "SELECT * FROM records WHERE intent <> 'oos'",
    "held": "SELECT domain, intent FROM (SELECT domain, intent, row_number() OVER (PARTITION BY domain ORDER BY md5('s0:held:' || intent)) AS i FROM (SELECT DISTINCT domain, intent FROM records)) WHERE i <= 2",
    "questions": sql_options(f"3 + CAST(floor({sql_uniform('c6:k', 'record_id')} * 6) AS INT)", 0.8, "c6"),
    "fixed": sql_options("5", 1.0, "c7"),
    "asked": f"""
    SELECT *, CASE WHEN underlying THEN intent WHEN near THEN ({sql_shuffled("offered", "c8:ask", "record_id")})[1] ELSE ({sql_shuffled("outside", "c8:ask", "record_id")})[1] END AS asked
    FROM (SELECT *, {sql_uniform("c8:near", "record_id")} < 0.8 AND len(offered) > 0 OR len(outside) = 0 AS near FROM (
      SELECT *, row_number() OVER (ORDER BY md5('c8:half:' || record_id)) <= (count(*) OVER ()) // 2 AS underlying, list_filter(options, lambda x: x <> intent AND x <> 'other') AS offered,
        list_filter({LABELS[1:]}, lambda x: x <> intent AND NOT list_contains(options, x)) AS outside FROM questions))""",
    "phrased": f"""
    SELECT record_id, kind, underlying, CAST(pick // 2 AS INT) AS template, pick % 2 = 1 AS negated, underlying <> (pick % 2 = 1) AS gold FROM (
      SELECT *, CAST(({sql_shuffled("['0', '1', '2', '3']", "c17:block", "kind || '|' || CAST(underlying AS VARCHAR) || '|' || CAST((i - 1) // 4 AS VARCHAR)")})[(i - 1) % 4 + 1] AS INT) AS pick FROM (
        SELECT record_id, source AS kind, underlying, row_number() OVER (PARTITION BY source, underlying ORDER BY md5('c17:rank:' || record_id)) AS i FROM asked))""",
    "positions": "SELECT CAST(k.k AS INT) AS k, CAST(p AS INT) AS position, coalesce(n, 0) AS n FROM (SELECT DISTINCT len(options) AS k, unnest(range(len(options))) AS p FROM questions) k LEFT JOIN (SELECT len(options) AS k, list_position(options, answer) - 1 AS p, count(*) AS n FROM questions GROUP BY ALL) c USING (k, p)",
    "deviations": "SELECT k, CAST(sum(n) AS BIGINT) AS total, max(abs(n / t - 1 / k)) / sqrt(1 / k * (1 - 1 / k) / sum(n)) AS deviation FROM (SELECT *, sum(n) OVER (PARTITION BY k) AS t FROM positions) GROUP BY k",
    "scaled": "SELECT record_id, CASE WHEN i <= round_even(0.3 * n, 0) THEN 3 ELSE 5 END AS scale, CASE WHEN i <= round_even(0.3 * n, 0) THEN [0, 0, 1, 2, 2][level + 1] ELSE level END AS level FROM (SELECT o_orderkey AS record_id, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS level, row_number() OVER (ORDER BY md5('c10:' || o_orderkey)) AS i, count(*) OVER () AS n FROM orders)",
    "report": "SELECT kind, CAST(sum(c) AS BIGINT) AS n, sum(yes) / sum(c) AS yes_share, sum(c) FILTER (WHERE negated) / sum(c) AS negated_share, sum(greatest(yes, c - yes)) / sum(c) AS phrasing_only_accuracy FROM (SELECT kind, template, negated, count(*) AS c, sum(CAST(gold AS INT)) AS yes FROM phrased GROUP BY ALL) GROUP BY kind",
    "balance": "SELECT kind, CAST(sum(CAST(gold AS INT)) AS BIGINT) AS n_true, CAST(sum(CAST(NOT gold AS INT)) AS BIGINT) AS n_false FROM phrased GROUP BY kind",
    "by_name": "SELECT source AS name, count(*) AS n FROM records GROUP BY source",
    "by_part": "SELECT source || CAST(least(n_chars // 500, 60) AS VARCHAR) AS name, count(*) AS n FROM records GROUP BY 1",
    "sampled": sql_sample(150, "c15", "records"),
    "celled": "SELECT source, record_id, least(n_chars // 700, 6) AS cell, domain AS target FROM known",
    "lift": sql_cell_lift("source", "celled"),
    "many": f"SELECT *, row_number() OVER (PARTITION BY source, b ORDER BY md5('c28:seat:' || b || ':' || record_id)) AS seat, row_number() OVER (PARTITION BY source, b ORDER BY md5('c28:deal:' || b || ':' || record_id)) AS deal FROM celled, (SELECT unnest(range(1, {NULLS + 1})) AS b)",
    "nulls": sql_cell_lift("source, b", "(SELECT x.source, x.b, x.cell, y.target FROM many x JOIN many y ON x.source = y.source AND x.b = y.b AND x.seat = y.deal)"),
    "broken_phrased": "SELECT * REPLACE (kind = 'en' OR gold AS gold) FROM phrased",
    "moved": "SELECT * REPLACE (list_concat([answer], list_filter(options, lambda x: x <> answer)) AS options) FROM questions",
    "broken_questions": "SELECT * FROM moved UNION ALL SELECT * FROM moved WHERE record_id % 97 = 0",
    "broken_wrapped": "SELECT * REPLACE (json OR doc_id % 2 = 0 AS json) FROM wrapped",
}


def q(body: str) -> str:
    return oracle(body, **_FX)


ORACLES = {
    "c2_option_order": q(f"SELECT record_id, array_to_string({sql_shuffled(str(LABELS), 'c2', 'record_id')}, ',') AS options FROM known"),
    "c3_held_out": q("SELECT * FROM held"),
    "c4_domain_conflicts": q("SELECT intent, count(DISTINCT source) AS n_domains FROM records GROUP BY intent HAVING count(DISTINCT source) > 1"),
    "c5_pool": q(f"SELECT record_id FROM records WHERE intent NOT IN (SELECT intent FROM held) AND md5({PT.K}) NOT IN (SELECT key FROM excluded)"),
    "c6_option_subset": q("SELECT record_id, answer, array_to_string(options, ',') AS options FROM questions"),
    "c7_fixed_options": q("SELECT record_id, answer, array_to_string(options, ',') AS options FROM fixed"),
    "c8_asked_labels": q("SELECT record_id, asked, underlying FROM asked"),
    "c9_exact_halves": q("SELECT intent = 'oos' AS oos, CAST(sum(CASE WHEN intent = 'oos' THEN 2 ELSE 1 END) AS BIGINT) AS n, CAST(sum(coalesce(CAST(underlying AS INT), 0)) AS BIGINT) AS n_yes FROM records LEFT JOIN (SELECT record_id, underlying FROM asked) USING (record_id) GROUP BY 1"),
    "c10_rescaled": q("SELECT * FROM scaled"),
    "c11_stratified": q("SELECT record_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('c11:' || record_id)) AS i FROM records WHERE n_chars <= 2000) WHERE i <= 10"),
    "c12_uniform_sample": q("SELECT record_id FROM records ORDER BY md5('c12:' || record_id) LIMIT 100"),
    "c13_matched_asks": q(f"SELECT * FROM ({_ASKS})"),
    "c14_allocate": q(f"SELECT * FROM ({sql_allocated('by_name', 37)}) UNION ALL SELECT * FROM ({sql_allocated('by_part', 40)})"),
    "c15_sample_records": q("SELECT * FROM sampled"),
    "c16_fixed_subset": q(sql_sample(60, "c15:sub", "sampled")),
    "c17_phrasings": q("SELECT * FROM phrased"),
    "c18_balance": q("SELECT * FROM balance"),
    "c19_phrasing_report": r("SELECT * FROM report", "kind n", "yes_share negated_share phrasing_only_accuracy", **_FX),
    "c20_gold_positions": q("SELECT * FROM positions"),
    "c20_position_deviations": r("SELECT * FROM deviations WHERE total >= 50", "k total", "deviation", **_FX),
    "c21_held_out_leaks": q("SELECT record_id FROM asked WHERE list_has_any(list_concat(options, [intent, asked]), (SELECT list(intent) FROM held))"),
    "c22_order_violations": q("SELECT record_id FROM records WHERE record_id % 7 IN (0, 1, 3)"),
    "c23_score_distribution": q("SELECT scale, level, count(*) AS n FROM scaled GROUP BY ALL"),
    "c24_build_gate": r(f"{sql_gate('built', 'phrased', 'questions', 'wrapped')} UNION ALL {sql_gate('broken', 'broken_phrased', 'broken_questions', 'broken_wrapped')}", 'data "check" item', "value", **_FX),
    "c25_probe_features": q(
        "SELECT record_id, CAST(len(list_distinct(list_concat(list_concat(list_concat(list_transform(w, lambda t: 'w:' || t), list_transform(range(1, len(w)), lambda i: 'w:' || w[i] || '_' || w[i + 1])), ['k:' || len(options)]), list_transform(options, lambda o: 'o:' || o)))) AS INT) AS n_features FROM (SELECT *, regexp_extract_all(lower('Does this fit: ' || asked || '?'), '[a-z0-9]+') AS w FROM asked)"
    ),
    "c26_usable_groups": r("SELECT source, CAST(sum(c) AS BIGINT) AS n, max(c) / sum(c) AS majority, count(*) AS n_targets FROM (SELECT source, domain, count(*) AS c FROM known GROUP BY ALL) GROUP BY source HAVING sum(c) >= 20 AND count(*) >= 2", "source n n_targets", "majority", **_FX),
    "c28_lift_gate": r(
        "SELECT l.source, l.lift, (1 + count(*) FILTER (WHERE n.lift >= l.lift)) / (1 + count(*)) AS p_value, l.lift > 0.10 OR (l.lift > 0.03 AND l.lift > (list(n.lift ORDER BY n.lift))[CAST(ceil(count(*) * 0.99) AS INT)]) AS fails FROM lift l JOIN nulls n USING (source) GROUP BY l.source, l.lift",
        "source fails", "lift p_value", **_FX,
    ),
    "c30_epoch": q("SELECT record_id, n_chars, i AS rank, (i - 1) // 16 AS batch FROM (SELECT record_id, n_chars, row_number() OVER (ORDER BY md5('c30:epoch:' || record_id)) AS i FROM records WHERE n_chars <= 2000)"),
    "c31_assembled": q("SELECT record_id, source FROM (SELECT record_id, source, row_number() OVER (ORDER BY md5('c31:' || record_id)) AS i FROM records) WHERE i <= 50 OR record_id % 2 = 0"),
}
