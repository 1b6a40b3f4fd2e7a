"""Queries of the text and deduplication section and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from credence.functions import text as T
from credence.operators import text as X
from credence.plans.fixtures import oracle, sql_uniform
from credence.plans.metrics import r, rounded
from credence.session import stored, tables


def docs(s, d):
    return tables(s, d, "documents")


def excluded(s, d):
    b, t = tables(s, d, "benchmark", "documents")
    return X.excluded_keys(b.select("text"), t.where("doc_id % 50 = 7").select("text"))


def wide(text):
    """A text with full-width letters and digits and ligatures, which NFKC undoes."""
    plain = "".join(chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123)))
    joined = F.replace(F.replace(text, F.lit("ffi"), F.lit("\ufb03")), F.lit("fi"), F.lit("\ufb01"))
    return F.translate(joined, plain, "".join(chr(ord(c) + 0xFEE0) for c in plain))


def measured(s, d):
    """The measures of every text, made once and stored, for settings and answers."""
    return stored(X.form_measures(docs(s, d).select("doc_id", "source", "text")))


def answered(s, d, of, *more):
    m = measured(s, d)
    return of(m, X.form_settings(m, ["source"], 0.2), ["source"], *more)


def settings(s, d):
    return X.form_settings(docs(s, d).select("source", "text"), ["source"], 0.2)


def instructions(s, d):
    """Rendered instructions: a kind, template and polarity for each document, its length as the slot."""
    kinds = F.array(*map(F.lit, X.TEMPLATES))
    t = X.template_table(s)
    rows = docs(s, d).select(F.col("doc_id").alias("id"), kinds[(F.col("doc_id") % len(X.TEMPLATES)).cast("int")].alias("kind"),
                             (F.floor(F.col("doc_id") / len(X.TEMPLATES)) % 2).cast("int").alias("template"), (F.floor(F.col("doc_id") / (2 * len(X.TEMPLATES))) % 2 == 1).alias("negated"),
                             F.col("n_chars").cast("string").alias("slot"))
    return rows.join(F.broadcast(t), ["kind", "template", "negated"]).select("id", "kind", X.render(F.col("pattern"), F.col("slot")).alias("instructions"))


def parts(s, d):
    return tables(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "’s.").otherwise("..")).alias("text"))


def described(s, d):
    g = parts(s, d).select(F.col("id").alias("label"), "text")
    return X.descriptions(g, g.where("label % 7 = 0").select("label", F.concat(F.lit("override of "), F.col("text")).alias("text")))


def lines(s, d):
    p = tables(s, d, "part")
    k = F.col("p_partkey")
    n = F.when(k % 5 == 0, F.array("p_name", "p_name", "p_type")).when(k % 5 == 1, F.array("p_name", "p_type")).when(k % 5 == 2, F.array("p_name", F.lit("  "), "p_type"))
    n = n.when(k % 5 == 3, F.array("p_name", F.concat(F.col("p_type"), F.lit("\nx")), "p_brand")).otherwise(F.array("p_name", "p_type", "p_brand"))
    return X.check_lines(p.select(k.alias("id"), n.alias("lines")), 22, 3)


def applied(s, d):
    t = docs(s, d)
    q = answered(s, d, X.add_form_questions, "doc_id")
    w = X.wrap_states(t.select("doc_id", "text"), "doc_id")
    n = q.groupBy("doc_id").agg(F.count("*").alias("n_form"), F.sum(F.col("answer").cast("int")).alias("n_yes"))
    return w.join(n, "doc_id", "left").groupBy("state_format").agg(F.count("*").alias("n"), F.sum(F.coalesce("n_form", F.lit(0))).alias("n_form"), F.sum(F.coalesce("n_yes", F.lit(0))).alias("n_yes"))


_ID = lambda s, d: docs(s, d).select(F.col("doc_id").alias("id"), "text")

QUERIES = {
    "b1_normalise": lambda s, d: docs(s, d).select("doc_id", X.text_key(F.col("text")).alias("key"), X.text_key(wide(F.col("text"))).alias("key_of_wide")),
    "b2_excluded_keys": excluded,
    "b3_keep": lambda s, d: X.keep(docs(s, d), excluded(s, d)).select("doc_id"),
    "b4_dedupe": lambda s, d: X.dedupe(docs(s, d), excluded(s, d), "doc_id"),
    "b5_ngrams": lambda s, d: docs(s, d).select("doc_id", F.size(T.ngrams(T.normalise(F.col("text")))).alias("n_ngrams")),
    "b6_overlap": lambda s, d: rounded(X.overlap(tables(s, d, "benchmark"), _ID(s, d))),
    "b7_form_measures": lambda s, d: X.form_measures(docs(s, d).select("doc_id", "text")),
    "b8_best_threshold": lambda s, d: rounded(X.best_threshold(docs(s, d).select("source", T.word_count(F.col("text")).cast("long").alias("value")), ["source"])),
    "b9_form_settings": lambda s, d: rounded(settings(s, d)),
    "b10_form_answers": lambda s, d: answered(s, d, X.form_answers).select("doc_id", "kind", "answer"),
    "b11_form_questions": lambda s, d: answered(s, d, X.add_form_questions, "doc_id"),
    "b12_wrap_states": lambda s, d: X.wrap_states(docs(s, d).select("doc_id", "text"), "doc_id").select("doc_id", "state_format", F.array_join("state_fields", ",").alias("fields")),
    "b13_apply_form": applied,
    "b14_render": instructions,
    "b14_parse": lambda s, d: X.parse(instructions(s, d)),
    "b14_negate": lambda s, d: X.negate(X.parse(instructions(s, d))),
    "b15_descriptions": described,
    "b16_check_lines": lines,
    "b17_tokens": lambda s, d: docs(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).alias("n_distinct")),
}

_KEY = "trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'))"
K = _KEY.format(t="text")
_SPACE = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_WORDS = f"list_filter(regexp_split_to_array(text, '[{_SPACE}]+'), lambda w: w <> '')"
_GRAMS = "list_distinct(list_transform(range(1, greatest(1, len(w) - 6)), lambda i: array_to_string(w[i:i + 7], ' ')))"
_SPLIT = f"(SELECT *, string_split({K}, ' ') AS w FROM {{}})"
_FX = {
    "excluded": f"SELECT DISTINCT md5({K}) AS key FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents WHERE doc_id % 50 = 7)",
    "measured": f"""
    SELECT doc_id, source, CAST(len({_WORDS}) AS INT) AS word_count_over, CAST(length(text) AS INT) AS char_count_over,
      CAST(coalesce(list_max(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w))), 0) AS INT) AS longest_word_over,
      CAST(regexp_matches(text, '[0-9]') AS INT) AS contains_number, CAST(contains(text, ',') AS INT) AS contains_comma,
      CAST(regexp_matches(text, '\\?[{_SPACE}]*$') AS INT) AS ends_with_question_mark FROM documents""",
    "unpivoted": "SELECT doc_id, source, kind, CAST(value AS BIGINT) AS value FROM measured UNPIVOT (value FOR kind IN (word_count_over, char_count_over, longest_word_over, contains_number, contains_comma, ends_with_question_mark))",
    "shares": "SELECT source, kind, value AS t, (SELECT 1) AS one, 1 - sum(c) OVER (PARTITION BY source, kind ORDER BY value) / sum(c) OVER (PARTITION BY source, kind) AS share FROM (SELECT source, kind, value, count(*) AS c FROM unpivoted WHERE kind LIKE '%over' GROUP BY ALL)",
    "steps": "SELECT source, kind, t, share FROM shares UNION ALL SELECT source, kind, min(value) - 1, 1.0 FROM unpivoted WHERE kind LIKE '%over' GROUP BY source, kind",
    "thresholds": "SELECT source, kind, t AS threshold, share AS yes_share FROM (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY abs(share - 0.5), t) AS i FROM steps) WHERE i = 1",
    "settings": "SELECT *, abs(yes_share - 0.5) <= 0.2 AS used FROM (SELECT source, kind, threshold, CAST(yes_share AS DOUBLE) AS yes_share FROM thresholds UNION ALL SELECT source, kind, NULL, avg(value) FROM unpivoted WHERE kind NOT LIKE '%over' GROUP BY source, kind)",
    "form_answers": "SELECT doc_id, kind, CASE WHEN threshold IS NOT NULL THEN value > threshold ELSE value > 0 END AS answer FROM unpivoted JOIN settings USING (source, kind) WHERE used",
    "form_questions": f"SELECT doc_id, kind, CAST(slot AS INT) AS slot, answer, {sql_uniform('form:before', 'doc_id', 'kind')} < 1.0 / 3 AS before FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('form:kind:' || doc_id || ':' || kind)) AS slot FROM form_answers) WHERE slot <= floor({sql_uniform('form:count', 'doc_id')} * 3)",
    "wrapped": """
    SELECT doc_id, i <= round_even(0.2 * n, 0) AS json, fields, CAST(floor({place} * (len(fields) + 1)) AS INT) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('wrap:' || doc_id)) AS i, count(*) OVER () AS n,
      list_transform(list_sort(list_transform(['channel', 'timestamp', 'message_id', 'user_id', 'thread_id', 'locale'], lambda f: {{'d': md5('wrap:field:' || CAST(doc_id AS VARCHAR) || ':' || f), 'f': f}})), lambda s: s.f)[1:1 + CAST(floor({count} * 3) AS INT)] AS fields FROM documents)""".format(place=sql_uniform("wrap:place", "doc_id"), count=sql_uniform("wrap:count", "doc_id")),
}
_TEMPLATE_ROWS = ", ".join(
    f"('{k}', {i}, {str(n).lower()}, '{p}')" for k, pairs in X.TEMPLATES.items() for i, pair in enumerate(pairs) for n, p in ((False, pair[0]), (True, pair[1]))
)
_NK = len(X.TEMPLATES)
_FX |= {
    "templates": f"SELECT * FROM (VALUES {_TEMPLATE_ROWS}) AS t(kind, template, negated, pattern)",
    "instructions": f"""
    SELECT id, d.kind, replace(pattern, '{{slot}}', slot) AS instructions, slot FROM (
      SELECT doc_id AS id, {list(X.TEMPLATES)}[doc_id % {_NK} + 1] AS kind, (doc_id // {_NK}) % 2 AS template, (doc_id // {2 * _NK}) % 2 = 1 AS negated, CAST(n_chars AS VARCHAR) AS slot FROM documents) d
    JOIN templates t ON d.kind = t.kind AND d.template = t.template AND d.negated = t.negated""",
    "fitting": """
    SELECT i.id, i.kind, t.template, t.negated, pattern, CASE WHEN contains(pattern, '{slot}') THEN regexp_extract(instructions, '^' || regexp_replace(regexp_escape(pattern), '\\\\\\{slot\\\\\\}', '(.+)') || '$', 1) END AS slot,
      length(replace(pattern, '{slot}', '')) AS fixed FROM instructions i JOIN templates t USING (kind)
    WHERE regexp_full_match(instructions, regexp_replace(regexp_escape(pattern), '\\\\\\{slot\\\\\\}', '(.+)'))""",
    "parsed": "SELECT id, kind, CAST(template AS INT) AS template, negated, slot FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fixed DESC, template, negated) AS i FROM fitting) WHERE i = 1",
    "generated": "SELECT p_partkey AS label, p_name || CASE WHEN p_partkey % 2 = 0 THEN '’s.' ELSE '..' END AS text FROM part",
}
_BAD = "list_filter(list_transform(lines, lambda x: CASE WHEN trim(x) = '' THEN 'empty' WHEN contains(trim(x), chr(10)) THEN 'several lines' WHEN length(trim(x)) > 22 THEN 'too long' END), lambda y: y IS NOT NULL)"


def q(body: str) -> str:
    return oracle(body, **_FX)


ORACLES = {
    "b1_normalise": q(f"SELECT doc_id, md5({K}) AS key, md5({K}) AS key_of_wide FROM documents"),
    "b2_excluded_keys": q("SELECT key FROM excluded"),
    "b3_keep": q(f"SELECT doc_id FROM documents WHERE md5({K}) NOT IN (SELECT key FROM excluded)"),
    "b4_dedupe": q(
        f"SELECT doc_id AS \"index\", CASE WHEN key IN (SELECT key FROM excluded) THEN 'test_text' WHEN doc_id > first THEN 'repeat' ELSE 'kept' END AS reason, CASE WHEN key NOT IN (SELECT key FROM excluded) AND doc_id > first THEN first END AS first_kept FROM (SELECT doc_id, md5({K}) AS key, min(doc_id) OVER (PARTITION BY {K}) AS first FROM documents)"
    ),
    "b5_ngrams": q(f"SELECT doc_id, CAST(len({_GRAMS}) AS INT) AS n_ngrams FROM {_SPLIT.format('documents')}"),
    "b6_overlap": r(
        "SELECT (SELECT count(*) FROM documents) AS n_test, (SELECT count(*) FROM documents WHERE len(string_split({k}, ' ')) >= 8) AS n_with_ngrams, (SELECT count(*) FROM documents WHERE {k} IN (SELECT {k} FROM benchmark)) AS n_exact, (SELECT count(DISTINCT doc_id) FROM dg WHERE g IN (SELECT g FROM bg)) AS n_overlap, (SELECT count(DISTINCT doc_id) FROM dg WHERE g IN (SELECT g FROM bg)) / (SELECT count(*) FROM documents) AS overlap_rate".format(k=K),
        "n_test n_with_ngrams n_exact n_overlap", "overlap_rate", bg=f"SELECT unnest({_GRAMS}) AS g FROM {_SPLIT.format('benchmark')}", dg=f"SELECT doc_id, unnest({_GRAMS}) AS g FROM {_SPLIT.format('documents')}",
    ),
    "b7_form_measures": q("SELECT doc_id, word_count_over, char_count_over, longest_word_over, contains_number, contains_comma, ends_with_question_mark FROM measured"),
    "b8_best_threshold": r("SELECT * FROM thresholds WHERE kind = 'word_count_over'", "source threshold", "yes_share", **_FX),
    "b9_form_settings": r("SELECT * FROM settings", "source kind threshold used", "yes_share", **_FX),
    "b10_form_answers": q("SELECT * FROM form_answers"),
    "b11_form_questions": q("SELECT * FROM form_questions"),
    "b12_wrap_states": q("SELECT doc_id, CASE WHEN json THEN 'json' ELSE 'plain' END AS state_format, CASE WHEN json THEN array_to_string(list_concat(list_concat(fields[1:place], ['text']), fields[place + 1:]), ',') ELSE '' END AS fields FROM wrapped"),
    "b13_apply_form": q("SELECT CASE WHEN json THEN 'json' ELSE 'plain' END AS state_format, count(*) AS n, CAST(sum(coalesce(f, 0)) AS BIGINT) AS n_form, CAST(sum(coalesce(y, 0)) AS BIGINT) AS n_yes FROM wrapped LEFT JOIN (SELECT doc_id, count(*) AS f, sum(CAST(answer AS INT)) AS y FROM form_questions GROUP BY doc_id) USING (doc_id) GROUP BY 1"),
    "b14_render": q("SELECT id, kind, instructions FROM instructions"),
    "b14_parse": q("SELECT * FROM parsed"),
    "b14_negate": q("SELECT p.id, p.kind, replace(pattern, '{slot}', coalesce(slot, '')) AS instructions FROM parsed p JOIN templates t ON p.kind = t.kind AND p.template = t.template AND p.negated <> t.negated"),
    "b15_descriptions": q("SELECT label, regexp_replace(replace(CASE WHEN label % 7 = 0 THEN 'override of ' || text ELSE text END, '’', ''''), '\\.$', '') AS text, label % 7 = 0 AS overridden FROM generated"),
    "b16_check_lines": q(
        f"SELECT id, CASE WHEN len(lines) <> 3 THEN 'wrong count' WHEN len({_BAD}) > 0 THEN {_BAD}[1] WHEN len(list_distinct(list_transform(lines, lambda x: lower(trim(x))))) < 3 THEN 'repeated' ELSE 'ok' END AS status FROM (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN [p_name, p_name, p_type] WHEN 1 THEN [p_name, p_type] WHEN 2 THEN [p_name, '  ', p_type] WHEN 3 THEN [p_name, p_type || chr(10) || 'x', p_brand] ELSE [p_name, p_type, p_brand] END AS lines FROM part)"
    ),
    "b17_tokens": q("SELECT doc_id, CAST(len(w) + greatest(len(w) - 1, 0) AS INT) AS n_tokens, CAST(len(list_distinct(list_concat(w, list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || '_' || w[i + 1])))) AS INT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)"),
}
