"""Queries on requests, replies, audits, helpers, files and streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from credence.functions import distributions as D
from credence.functions.draws import digest
from credence.operators import audit as J
from credence.operators import calibration as K
from credence.operators import feedback as B
from credence.operators import helpers as L
from credence.operators import metrics as M
from credence.operators import replies as I
from credence.operators import report as R
from credence.operators import validation as A
from credence.plans import fixtures as X
from credence.plans import learning as PL
from credence.plans import text as PT
from credence.plans.fixtures import oracle, sql_uniform
from credence.plans.metrics import choice, ece_sql, judged, r, rounded
from credence.sources import files
from credence.streaming import drift as W
from credence.streaming import feedback as S
from credence.session import shared_folder, tables

CASES = 16


def requests(s, d, case=None):
    """Requests of which each id modulo 16 breaks another rule."""
    k = F.col("id") % CASES if case is None else F.lit(case)
    opt = lambda label, text=None: F.struct(F.lit(label).alias("label"), F.lit(text).cast("string").alias("description"))
    none = F.array().cast("array<struct<label:string,description:string>>")
    q = lambda i, t, text, options: F.struct(F.lit(i).alias("id"), F.lit(t).cast("string").alias("type"), F.lit(text).cast("string").alias("instructions"), options.alias("options"))
    two = F.array(opt("a", "first"), opt("b"))
    good = q("topic", "choice", "Which one?", two)
    many = F.transform(F.sequence(F.lit(1), F.lit(27)), lambda i: F.struct(F.concat(F.lit("o"), i.cast("string")).alias("label"), F.lit(None).cast("string").alias("description")))
    bad = [
        F.array(good, q("ok", "noul", "Is it?", none)), F.array(), F.array(good, good), F.array(q("Bad Id", "noul", "Is it?", none)), F.array(q("x", None, "Is it?", none)),
        F.array(q("x", "other", "Is it?", none)), F.array(q("x", "noul", "  ", none)), F.array(q("x", "noul", "Is\nit?", none)), F.array(q("x", "noul", " Is it?", none)),
        F.array(q("x", "noul", "Is it?", F.array(opt("true", "yes"), opt("maybe")))), F.array(q("x", "choice", "Which?", F.array(opt("a")))), F.array(q("x", "choice", "Which?", many)),
        F.array(q("x", "choice", "Which?", F.array(opt("a"), opt("a")))), F.array(q("x", "score", "How much?", F.array(opt("low")))), F.array(q("x", "choice", "Which?", F.array(opt("a "), opt("b")))),
        F.array(q("x", "choice", "Which?", F.array(opt("a", ""), opt("b")))),
    ]
    questions = F.lit(None).cast(A.REQUEST["questions"].dataType)
    for i in reversed(range(CASES)):
        questions = F.when(k == i, bad[i].cast(A.REQUEST["questions"].dataType)).otherwise(questions)
    docs = tables(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.select("id", F.col("text").alias("state"), questions.alias("questions"))


def valid_requests(s, d):
    """The questions that break no rule, for every document."""
    return requests(s, d, 0)


REASONS = [
    None, ("questions", "needs a question"), ("questions", "question ids must be unique"), ("Bad Id", "bad question id"), ("x", "missing type"), ("x", "unknown type"),
    ("x", "must be a non-empty string"), ("x", "must not contain line breaks"), ("x", "must not have leading or trailing whitespace"), ("x", "criteria may hold true and false only"),
    ("x", "must have 2 to 26 options"), ("x", "must have 2 to 26 options"), ("x", "labels must be unique"), ("x", "must have 2 to 10 levels"),
    ("x", "must not have leading or trailing whitespace"), ("x", "must not be empty"),
]


def answer_lines(s, d):
    k = F.col("record_id")
    line = F.when(k % 5 == 0, F.to_json(F.struct(F.lit("noul").alias("type"), F.col("probs")[0].alias("value")))).when(k % 5 == 1, F.to_json(F.struct(F.lit("choice").alias("type"), F.lit("c0").alias("label"))))
    line = line.when(k % 5 == 2, F.to_json(F.struct(F.lit("choice").alias("type"), F.lit("c0").alias("label"), F.create_map(F.lit("c0"), F.col("probs")[0]).alias("probabilities"))))
    line = line.when(k % 5 == 3, '{"value": 1}').otherwise('{"type": "noul"}')
    return A.decoded_answers(X.results_choice(s, d).select(F.col("record_id").alias("id"), line.alias("line")))


def gold_records(s, d):
    n = X.results_noul(s, d).groupBy(F.col("record_id").alias("id")).agg(F.collect_list(F.struct(F.col("question_id").alias("id"))).alias("questions"))
    gold = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("q0"), F.lit("true"))).otherwise(F.create_map(F.lit("q0"), F.lit("true"), F.lit("q1"), F.lit("false")))
    return A.record_mismatches(n.withColumn("gold", gold))


def bodies(s, d):
    k = F.col("event_id")
    body = F.when(k % 4 == 0, F.col("props")).when(k % 4 == 1, '{"a": 1, "a": 2}').when(k % 4 == 2, '{"a": {"b": 1, "b": 1}}').otherwise('{"a": ')
    return tables(s, d, "events").select("event_id", A.repeated_keys(body).alias("refused"))


def answers_of(s, d):
    a = A.answer(F.col("qtype"), F.col("labels"), F.col("probs"))
    return X.results(s, d).select("record_id", "question_id", "qtype", a.alias("a")).select("record_id", "question_id", "qtype", "a.value", "a.label", "a.confidence", F.map_values("a.probabilities")[0].alias("p_first"))


def rendered(s, d):
    r = A.render_text(valid_requests(s, d))
    return r.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def replies(s, d):
    """A reply for each choice question, of a form by its id modulo 12."""
    j = choice(s, d)
    k = F.col("record_id") % 12
    label = F.get("labels", F.col("prediction"))
    entry = lambda a, c="0.75": F.concat(F.lit('{"q1": {"answer": '), a, F.lit(f', "confidence": {c}}}}}'))
    quoted = F.concat(F.lit('"'), label, F.lit('"'))
    forms = [
        entry(quoted), F.concat(F.lit("```json\n"), entry(quoted), F.lit("\n```")), entry(F.concat(F.lit('"'), label, F.lit(': a description"'))), F.lit('{"q2": {"answer": "c0"}}'),
        entry(F.lit('"nothing"')), F.lit('{"q1": {"answer": "c'), F.concat(F.lit('{"q1": '), quoted, F.lit("}")), entry(quoted, "true"), entry(F.lit("3")), entry(F.concat(F.lit('"  '), label, F.lit(' "')), "1.5"),
        F.lit("[1, 2]"), F.lit(None).cast("string"),
    ]
    reply = F.lit(None).cast("string")
    for i in reversed(range(len(forms))):
        reply = F.when(k == i, forms[i]).otherwise(reply)
    return I.parsed_replies(j.select("record_id", "split", "qtype", "labels", "gold", F.lit("q1").alias("shown_id"), reply.alias("reply")))


def typed_replies(s, d):
    """A yes/no or score reply for each event, its value of one JSON type or another, read strictly."""
    e, k = tables(s, d, "events"), F.get_json_object("props", "$.k").cast("int")
    number = (k % 7).cast("string")
    forms = [
        number, F.concat(F.lit('"'), number, F.lit('"')), F.concat(number, F.lit(".0")), F.concat(number, F.lit(".5")), (k % 2 == 0).cast("string"), F.lit('" false "'),
        F.lit("null"), F.concat(F.lit("["), number, F.lit("]")), F.concat(F.lit("-"), (k % 7 + 1).cast("string")),
    ]
    value = F.get(F.array(*forms), (F.col("event_id") % len(forms)).cast("int"))
    noul = F.floor(F.col("event_id") / len(forms)) % 2 == 0
    labels = F.when(noul, F.array(F.lit("true"), F.lit("false"))).otherwise(F.array(*[F.lit(str(i)) for i in range(5)]))
    rows = e.select(F.col("event_id").alias("record_id"), F.when(noul, "noul").otherwise("score").alias("qtype"), labels.alias("labels"), F.lit("q1").alias("shown_id"),
                    F.concat(F.lit('{"q1": {"answer": '), value, F.lit("}}")).alias("reply"))
    return I.parsed_replies(rows).select("record_id", "qtype", "status", "answer")


def latencies(s, d):
    e = tables(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "event_type", (F.col("value") / 10).alias("latency_s"), F.when(F.col("event_id") % 10 < 8, (k % 5 == 0).cast("long")).alias("retries"), k.alias("tokens"))


def verdicts(s, d):
    v = F.array(*map(F.lit, J.VERDICTS))
    pick = lambda name: F.get(v, F.conv(F.substring(digest(name, F.col("doc_id")), 1, 4), 16, 10).cast("int") % 7)
    l = tables(s, d, "labels")
    a = F.coalesce(pick("first"), F.lit("label_correct"))
    b = F.when(F.col("doc_id") % 3 == 0, F.coalesce(pick("second"), F.lit("label_correct"))).otherwise(a)
    g = F.when(F.col("doc_id") % 4 == 0, "a").when(F.col("doc_id") % 4 == 1, "b").when(F.col("doc_id") % 4 == 2, "a+b").otherwise("c")
    return l.select("doc_id", g.alias("group"), a.alias("first"), b.alias("second"))


def sheet(s, d):
    j = choice(s, d).select("record_id", "hit", "gold")
    from credence.operators.sampling import exact_sample

    parts = {"wrong": exact_sample(j.where("hit = 0"), 20, "j4:wrong", F.col("record_id")), "uniform": exact_sample(j, 30, "j4:uniform", F.col("record_id")), "zero": exact_sample(j.where("gold = 0"), 10, "j4:zero", F.col("record_id"))}
    return J.audit_sheet(parts, "record_id")


def digests(s, d):
    """A file for each nation, held against recorded digests of which every fifth is wrong and one has no file."""
    folder, key = scratch(s), F.col("n_nationkey")
    tables(s, d, "nation").select(F.col("n_name").alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(folder)
    found = J.file_digests(s, folder, "part-*").withColumn("name", F.split("name", "/")[0])
    right = F.sha2(F.concat("n_name", F.lit("\n")), 256)
    recorded = tables(s, d, "nation").select(F.concat(F.lit("n_nationkey="), key.cast("string")).alias("name"), F.when(key % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(right).alias("sha256"))
    return J.digest_mismatches(found, recorded.unionByName(s.createDataFrame([("absent", "0")], "name string, sha256 string")))


PINNED = ["doc_id", "text", "lang", "source", "n_chars"]


def pinned(s, d):
    """The digest of `documents` by source, read in any order and layout, and that of the whole."""
    by_source = J.table_digests(tables(s, d, "documents"), ["source"], PINNED)
    return by_source.unionByName(J.combined_digest(by_source).withColumn("source", F.lit("all"))).select("source", "n", "digest")


def pin_mismatches(s, d):
    """Sources whose documents are no longer those pinned: one text is changed, one row is repeated, one source is gone."""
    docs = tables(s, d, "documents").select(*PINNED)
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    now = changed.unionByName(docs.where("doc_id = 11")).where("source <> 'src3'")
    return J.pin_mismatches(J.table_digests(now, ["source"], PINNED), J.table_digests(docs, ["source"], PINNED), ["source"])


#: The run whose requests an event type stands for.
ASKED_BY = {"click": "a", "view": "api"}


def report(s, d):
    """Two runs with probabilities, one of replies that lacks a tenth of the records, one that is absent;
    latencies, and the fitted temperature of one, below."""
    two = PL.runs(s, d).where("run in ('a', 'b')")
    both = M.ece(two, ["run", "split"]).select("run", "split", "ece", "n").join(two.groupBy("run", "split").agg(F.avg("hit").alias("accuracy")), ["run", "split"])
    told = I.baseline_metrics(replies(s, d).where("record_id % 10 <> 3"), ["split"]).withColumn("parse_failure_rate", 1 - F.col("n_parsed") / F.col("n"))
    told = R.long_rows(told.withColumn("run", F.lit("api")), ["run", "split", "n"], ["accuracy_all", "lenient_accuracy_all", "ece", "parse_failure_rate"])
    by = F.element_at(F.create_map(*[F.lit(x) for pair in ASKED_BY.items() for x in pair]), F.col("event_type"))
    asked = I.latency_summary(latencies(s, d).withColumn("run", by).where("run is not null"), ["run"], 5.0)
    heat = K.fitted(X.results_choice(s, d), "nll", []).select(F.lit("a").alias("run"), F.lit("temperature").alias("metric"), F.col("temperature").alias("value"))
    feet = R.long_rows(asked, ["run"], ["median_ms", "p95_ms", "retried_requests"]).unionByName(heat)
    return rounded(R.report_rows(R.long_rows(both, ["run", "split", "n"], ["accuracy", "ece"]), told, feet, ["a", "b", "api", "absent"]))


#: Logs of the fixture: flip rate of the rows, and the metadata written beside them.
LOGS = {
    "first": (0.1, {"seed": 0, "flip_rate": 0.1}, None),
    "plain": (0.2, {"seed": 0}, {"noisy": False}),
    "noisy": (0.3, {"seed": 0, "flip_rate": 0.3}, {"noisy": True}),
    "soft": (0.4, {"seed": 0, "flip_rate": 0.4}, {"noise": "soft", "noisy": True}),
    "unknown": (0.2, None, None),
}


def metadata(s, d):
    """One log's flips redrawn at several rates, each written with its metadata, and all read back."""
    log, folder = PL.log(s, d), scratch(s)
    for name, (rate, sampling, v3) in LOGS.items():
        files.write_log(B.reflip(log, 0, rate), folder, name, sampling, v3)
    return files.read_log_metadata(s, folder)


def label_names(s):
    return s.createDataFrame([(i, n) for i, n in enumerate(X.LABELS)], "index long, name string")


def utterances(s, d):
    return L.with_label_names(tables(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label")), label_names(s))


def gaps(s, d):
    described = s.createDataFrame([(n,) for n in (*X.LABELS[2:], "extra")], "label string")
    return L.label_gaps(utterances(s, d).where("intent is not null").select("intent"), described)


def stored_round_trip(s, d):
    """Results through gzip JSON lines in a new folder, and the log through the same."""
    folder = scratch(s)
    files.write_lines(X.results_choice(s, d), f"{folder}/results")
    files.write_lines(X.interactions(s, d), f"{folder}/log")
    a = M.answers(files.read_results(s, f"{folder}/results")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    b = files.read_log(s, f"{folder}/log").agg(F.count("*").alias("n_log"), F.sum("outcome").alias("outcomes"))
    return a.join(b)  # one row each


def scratch(s):
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}"


def flattened(s, d):
    """Questions of each record as an array, exploded again with gold index and labels."""
    nested = X.results_noul(s, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("position", "question_id", "labels", "gold"))).alias("questions"))
    return nested.select("record_id", F.posexplode("questions").alias("i", "q")).select("record_id", F.col("q.question_id").alias("question_id"), F.col("i").alias("position"), F.get("q.labels", F.col("q.gold")).alias("gold_label"), F.col("q.gold").alias("gold"))


def texts(s, d):
    w = PT.X.wrap_states(tables(s, d, "documents").select("doc_id", "text"), "doc_id")
    return w.select("doc_id", F.md5(L.record_text(F.col("state"), F.col("state_format")).cast("binary")).alias("text_md5"))


def names(s, d):
    k = F.col("vec_id")
    e = tables(s, d, "embeddings").select("vec_id", L.run_name(F.lit("06b"), F.when(k % 2 == 0, "direct_brier").otherwise("full_sft"), k, k % 3, F.when(k % 5 == 0, "noisy")).alias("run"))
    return e.select("vec_id", "run", *L.parsed_run_name(F.col("run")))


def events_path(d):
    return f"{d}/events.parquet"


ODDS, LIMIT, QUIET = 2.0, 3.0, 3


def tracked(s, d):
    """Users whose share of errors drifts from that of the first week, and those who fall silent."""
    bad = F.col("event_type") == "error"
    usual = W.usual_share(S.event_batch(s, events_path(d)), bad)
    return rounded(W.resumed(W.cusum(S.event_stream(s, events_path(d)), "user_id", bad, usual, ODDS, LIMIT, QUIET), f"{shared_folder(s)}/drift-{uuid.uuid4().hex}"))


QUERIES = {
    "a1_render_state": lambda s, d: tables(s, d, "events").select("event_id", A.render_state(F.col("props")).alias("state")),
    "a2_line_rules": lambda s, d: tables(s, d, "documents").select("doc_id", A.line_reason(F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, F.col("text")).when(F.col("doc_id") % 5 == 2, F.concat("source", F.lit(" "))).otherwise(F.col("source"))).alias("reason")),
    "a3_to_a8_violations": lambda s, d: A.violations(requests(s, d)),
    "a9_decoded_answers": lambda s, d: rounded(answer_lines(s, d)),
    "a10_record_mismatches": gold_records,
    "a11_repeated_keys": bodies,
    "a12_answers": lambda s, d: rounded(answers_of(s, d)),
    "a13_entropy_confidence": lambda s, d: rounded(X.results_score(s, d).select("record_id", D.entropy_confidence(F.col("probs")).alias("confidence"))),
    "a14_route": lambda s, d: judged(s, d).groupBy("qtype", A.route(F.col("confidence"), 0.6).alias("route")).agg(F.count("*").alias("n")),
    "a15_render_text": rendered,
    "a16_shuffled_options": lambda s, d: A.shuffle_options(X.results_choice(s, d), "a16").select("record_id", F.array_join("labels", ",").alias("labels"), "gold"),
    "d22_flattened": flattened,
    "i1_i3_parsed_replies": lambda s, d: replies(s, d).select("record_id", "status", "answer", "confidence", "lenient_status", "lenient_answer"),
    "i2_typed_values": typed_replies,
    "i4_answer_schema": lambda s, d: valid_requests(s, d).select("id", F.array_join(I.shown_ids(F.col("questions")), ",").alias("ids"), I.answer_schema(F.col("questions")).alias("schema")),
    "i5_baseline_metrics": lambda s, d: rounded(I.baseline_metrics(replies(s, d), ["split"])),
    "i6_last_wins": lambda s, d: I.last_wins(tables(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id"),
    "i7_latency": lambda s, d: rounded(I.latency_summary(latencies(s, d), ["event_type"], 5.0)),
    "i8_cost": lambda s, d: rounded(tables(s, d, "lineitem").groupBy("l_returnflag").agg(F.sum(I.cost_usd(F.col("l_quantity") * 100, F.col("l_quantity") * 10, F.col("l_linenumber") * 10, 0.4, 0.1, 1.6)).alias("usd"), F.max(I.worst_case_usd(F.col("l_quantity") * 400, F.lit(300), 0.4, 1.6)).alias("worst"))),
    "i8_within_budget": lambda s, d: I.within_budget(latencies(s, d).withColumn("cost", F.round(F.col("tokens") / 64, 6)), "event_type", "event_id", "cost", 500.0).groupBy("event_type").agg(F.count("*").alias("n"), D.r6(F.max("spent")).alias("spent")),
    "i9_generation": lambda s, d: rounded(I.generation_summary(latencies(s, d), ["event_type"], 90)),
    "j1_wilson": lambda s, d: rounded(verdicts(s, d).groupBy("group").agg(F.count("*").alias("n"), F.sum((F.col("first") == "ambiguous").cast("long")).alias("k")).select("group", "n", "k", J.wilson(F.col("k"), F.col("n"))["lo"].alias("lo"), J.wilson(F.col("k"), F.col("n"))["hi"].alias("hi"))),
    "j2_kappa": lambda s, d: rounded(J.kappa(J.in_groups(verdicts(s, d)), ["group"], "first", "second")),
    "j3_shares": lambda s, d: rounded(J.shares(J.in_groups(verdicts(s, d)), ["group"], "second")),
    "j3_disagreements": lambda s, d: J.disagreements(verdicts(s, d), "first", "second"),
    "j4_audit_sheet": sheet,
    "j5_digest_check": digests,
    "j6_table_pin": pinned,
    "j6_pin_mismatches": pin_mismatches,
    "l_record_text": texts,
    "l_run_names": names,
    "l_splits": lambda s, d: L.splits_in_order(judged(s, d), "record_id"),
    "l_kinds": lambda s, d: judged(s, d).groupBy(L.display_kind(F.col("qtype"), F.col("question_id")).alias("kind"), L.is_form(F.col("kind")).alias("form")).agg(F.count("*").alias("n")),
    "l_long_metrics": lambda s, d: rounded(L.long_metrics(M.proper_scores(choice(s, d), ["split"]), ["split"])),
    "l_files_round_trip": stored_round_trip,
    "l_utterances": utterances,
    "l_label_gaps": gaps,
    "l_log_metadata": metadata,
    "l_report_rows": report,
    "m_tumbling": lambda s, d: S.streamed(s, events_path(d), S.tumbling),
    "m_sliding": lambda s, d: S.streamed(s, events_path(d), S.sliding),
    "m_sessions": lambda s, d: S.sessions(S.event_batch(s, events_path(d))),
    "m_running_rate": lambda s, d: S.streamed(s, events_path(d), S.running_rate),
    "m_drift": lambda s, d: S.streamed(s, events_path(d), S.drift),
    "m_drift_by_user": tracked,
    "m_first_of_each": lambda s, d: S.streamed(s, events_path(d), S.first_of_each, "append"),
}

_CASE = " ".join(f"WHEN {i} THEN {{'path': '{x[0]}', 'reason': '{x[1]}'}}" for i, x in enumerate(REASONS) if x)
_PICK = "['label_correct', 'ambiguous', 'label_wrong', 'convention'][CAST('0x' || substr(md5('{n}:' || doc_id), 1, 4) AS INT) % 7 + 1]"
_FX = PT._FX | {
    "verdicts": f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'a+b' ELSE 'c' END AS grp, coalesce({_PICK.format(n='first')}, 'label_correct') AS one, CASE WHEN doc_id % 3 = 0 THEN coalesce({_PICK.format(n='second')}, 'label_correct') ELSE coalesce({_PICK.format(n='first')}, 'label_correct') END AS two FROM labels",
    "members": "SELECT *, unnest(list_concat(string_split(grp, '+'), ['all'])) AS g FROM verdicts",
    "reply_rows": """
    SELECT record_id, split, gold, k, CASE WHEN k IN (0, 1, 2, 6, 7, 9) THEN prediction END AS lenient_answer, CASE WHEN k IN (0, 1, 6, 7, 9) THEN prediction END AS answer, CASE WHEN k IN (0, 1) THEN 0.75 END AS confidence,
      CASE WHEN k IN (5, 10, 11) THEN 'invalid_json' WHEN k = 3 THEN 'missing' WHEN k IN (0, 1, 6, 7, 9) THEN 'ok' ELSE 'invalid_answer' END AS status, CASE WHEN k IN (5, 10, 11) THEN 'invalid_json' WHEN k = 3 THEN 'missing' WHEN k IN (0, 1, 2, 6, 7, 9) THEN 'ok' ELSE 'invalid_answer' END AS lenient_status
    FROM (SELECT * EXCLUDE (k), record_id % 12 AS k FROM judged_choice)""",
    "latencies": "SELECT event_id, event_type, value / 10 AS latency_s, CASE WHEN event_id % 10 < 8 THEN CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 5 = 0 AS BIGINT) END AS retries, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens FROM events",
    "attempts": "SELECT *, CASE WHEN retries IS NOT NULL THEN retries > 0 ELSE latency_s > 5 END AS retried FROM latencies",
}


def q(body: str) -> str:
    return oracle(body, **_FX)


def rr(body: str, keys: str, values: str) -> str:
    return r(body, keys, values, **_FX)


_LO = "CASE WHEN n > 0 THEN greatest(0.0, (k / n + {z2} / (2 * n)) / (1 + {z2} / n) - {z} * sqrt(k / n * (1 - k / n) / n + {z2} / (4 * n * n)) / (1 + {z2} / n)) ELSE 0.0 END".format(z=J.Z, z2=J.Z * J.Z)
_HI = _LO.replace("greatest(0.0,", "least(1.0,").replace(f"- {J.Z} * sqrt", f"+ {J.Z} * sqrt")
_P = "list_transform(probs, lambda x: x / list_sum(probs))"
def sql_pin(of: str, by: str | None) -> str:
    """The digest of a table: counts, sums and exclusive ors of halves of its rows' digests."""
    row = "md5(concat(" + ", ".join(f"md5('{c}' || coalesce('=' || CAST({c} AS VARCHAR), ''))" for c in PINNED) + "))"
    half = lambda i: f"CAST('0x' || substr(h, {i}, 15) AS BIGINT)"
    parts = ", ':', ".join([f"sum(CAST({half(i)} AS HUGEINT))" for i in (1, 17)] + [f"bit_xor({half(i)})" for i in (1, 17)])
    return f"SELECT {by or chr(39) + 'all' + chr(39)} AS source, count(*) AS n, md5(concat(count(*), ':', {parts})) AS digest FROM (SELECT *, {row} AS h FROM {of}) {f'GROUP BY {by}' if by else ''}"


ORACLES = {
    "a1_render_state": q("SELECT event_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS state FROM events"),
    "a2_line_rules": q("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'must not be empty' WHEN doc_id % 5 = 1 THEN CASE WHEN contains(text, chr(10)) OR contains(text, chr(13)) THEN 'must not contain line breaks' WHEN text <> trim(text, ' ' || chr(9)) THEN 'must not have leading or trailing whitespace' END WHEN doc_id % 5 = 2 THEN 'must not have leading or trailing whitespace' END AS reason FROM documents"),
    "a3_to_a8_violations": q(f"SELECT id, v.path, v.reason FROM (SELECT doc_id AS id, CASE WHEN length(text) > 8000 THEN {{'path': 'state', 'reason': 'state is too long'}} ELSE CASE doc_id % 16 {_CASE} END END AS v FROM documents) WHERE v IS NOT NULL"),
    "a9_decoded_answers": rr("SELECT record_id AS id, CASE record_id % 5 WHEN 0 THEN 'noul' WHEN 3 THEN NULL WHEN 4 THEN 'noul' ELSE 'choice' END AS type, CASE record_id % 5 WHEN 1 THEN 'probabilities' WHEN 3 THEN 'type' WHEN 4 THEN 'value' END AS missing, CASE WHEN record_id % 5 IN (0, 2) THEN probs[1] END AS value FROM results_choice", "id type missing", "value"),
    "a10_record_mismatches": q("SELECT DISTINCT record_id AS id FROM results_noul WHERE record_id % 3 = 0"),
    "a11_repeated_keys": q("SELECT event_id, event_id % 4 <> 0 AS refused FROM events"),
    "a12_answers": rr(
        f"SELECT record_id, question_id, qtype, CASE qtype WHEN 'noul' THEN round(p[1], 4) WHEN 'score' THEN round(list_sum(list_transform(range(len(p)), lambda i: i * p[i + 1])), 4) END AS value, CASE WHEN qtype = 'choice' THEN labels[list_position(p, list_max(p))] END AS label, CASE WHEN qtype <> 'noul' THEN round(greatest(0.0, least(1.0, 1 + list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0.0 END)) / ln(len(p)))), 4) END AS confidence, CASE WHEN qtype <> 'noul' THEN round(p[1], 4) END AS p_first FROM (SELECT *, {_P} AS p FROM results)",
        "record_id question_id qtype label", "value confidence p_first",
    ),
    "a13_entropy_confidence": rr("SELECT record_id, confidence FROM judged WHERE qtype = 'score'", "record_id", "confidence"),
    "a14_route": q("SELECT qtype, CASE WHEN confidence >= 0.6 THEN 'automatic' ELSE 'escalate' END AS route, count(*) AS n FROM judged GROUP BY ALL"),
    "a15_render_text": q("SELECT doc_id AS id, md5(text || chr(10) || chr(10) || 'Which one?' || chr(10) || 'A. a: first' || chr(10) || 'B. b' || chr(10) || chr(10) || 'Is it?' || chr(10) || 'A. yes' || chr(10) || 'B. no') AS text_md5 FROM documents"),
    "a16_shuffled_options": q("SELECT record_id, array_to_string(l, ',') AS labels, CAST(list_position(l, labels[gold + 1]) - 1 AS INT) AS gold FROM (SELECT *, list_transform(list_sort(list_transform(labels, lambda x: {'d': md5('a16:' || CAST(record_id AS VARCHAR) || ':' || x), 'x': x})), lambda s: s.x) AS l FROM results_choice)"),
    "d22_flattened": q("SELECT record_id, question_id, position, labels[gold + 1] AS gold_label, gold FROM results_noul"),
    "i1_i3_parsed_replies": q("SELECT record_id, status, answer, CAST(confidence AS DOUBLE) AS confidence, lenient_status, lenient_answer FROM reply_rows"),
    "i2_typed_values": """SELECT record_id, qtype, CASE WHEN answer IS NULL THEN 'invalid_answer' ELSE 'ok' END AS status, CAST(answer AS INT) AS answer FROM (
      SELECT record_id, qtype, CASE WHEN qtype = 'score' AND form <= 2 AND v < 5 THEN v WHEN qtype = 'noul' AND form = 4 THEN k % 2 WHEN qtype = 'noul' AND form = 5 THEN 1 END AS answer FROM (
        SELECT event_id AS record_id, CASE WHEN event_id // 9 % 2 = 0 THEN 'noul' ELSE 'score' END AS qtype, event_id % 9 AS form, k, k % 7 AS v FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)))""",
    "i4_answer_schema": """SELECT doc_id AS id, 'q1,q2' AS ids, '{"q1":{"answer":{"type":"string","enum":["a","b"]},"confidence":{"type":"number"}},"q2":{"answer":{"type":"boolean"},"confidence":{"type":"number"}}}' AS schema FROM documents""",
    "i5_baseline_metrics": rr(
        "SELECT a.*, ece FROM (SELECT split, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS n_parsed, count(*) FILTER (WHERE status = 'invalid_json') AS invalid_json, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'invalid_answer') AS invalid_answer, avg(CAST(answer = gold AS INT)) FILTER (WHERE status = 'ok') AS accuracy, avg(coalesce(CAST(answer = gold AS INT), 0)) AS accuracy_all, avg(coalesce(CAST(lenient_answer = gold AS INT), 0)) AS lenient_accuracy_all, count(*) FILTER (WHERE lenient_status = 'ok' AND status <> 'ok') AS recovered, count(confidence) AS n_with_confidence FROM reply_rows GROUP BY split) a "
        "LEFT JOIN (SELECT split, sum(abs(h - c)) / sum(n) AS ece FROM (SELECT split, least(CAST(floor(confidence * 15) AS INT), 14) AS bin, count(*) AS n, sum(CAST(answer = gold AS INT)) AS h, sum(confidence) AS c FROM reply_rows WHERE confidence IS NOT NULL GROUP BY ALL) GROUP BY split) USING (split)",
        "split n n_parsed invalid_json missing invalid_answer recovered n_with_confidence", "accuracy accuracy_all lenient_accuracy_all ece",
    ),
    "i6_last_wins": q("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"),
    "i7_latency": rr("SELECT event_type, count(*) FILTER (WHERE NOT retried) AS n, quantile_cont(latency_s * 1000, 0.5) FILTER (WHERE NOT retried) AS median_ms, quantile_cont(latency_s * 1000, 0.95) FILTER (WHERE NOT retried) AS p95_ms, avg(latency_s * 1000) FILTER (WHERE NOT retried) AS mean_ms, count(*) FILTER (WHERE retried) AS retried_requests, CAST(sum(coalesce(retries, 0)) AS BIGINT) AS retries_total, count(*) FILTER (WHERE retries IS NULL) AS rows_without_retry_count, count(*) FILTER (WHERE retries IS NULL AND latency_s > 5) AS over_timeout FROM attempts GROUP BY event_type", "event_type n retried_requests retries_total rows_without_retry_count over_timeout", "median_ms p95_ms mean_ms"),
    "i8_cost": rr("SELECT l_returnflag, sum((l_quantity * 90 * 0.4 + l_quantity * 10 * 0.1 + l_linenumber * 10 * 1.6) / 1e6) AS usd, max((l_quantity * 200 * 0.4 + 300 * 1.6) / 1e6) AS worst FROM lineitem GROUP BY l_returnflag", "l_returnflag", "usd worst"),
    "i8_within_budget": rr("SELECT event_type, count(*) AS n, max(spent) AS spent FROM (SELECT *, sum(round(tokens / 64, 6)) OVER (PARTITION BY event_type ORDER BY event_id) AS spent FROM latencies) WHERE spent <= 500 GROUP BY event_type", "event_type n", "spent"),
    "i9_generation": rr("SELECT event_type, count(*) AS n, avg(tokens) AS mean_tokens, avg(CAST(tokens >= 90 AS INT)) AS truncated_rate FROM latencies GROUP BY event_type", "event_type n", "mean_tokens truncated_rate"),
    "j1_wilson": rr(f"SELECT *, {_LO} AS lo, {_HI} AS hi FROM (SELECT grp AS \"group\", count(*) AS n, count(*) FILTER (WHERE one = 'ambiguous') AS k FROM verdicts GROUP BY grp)", '"group" n k', "lo hi"),
    "j2_kappa": rr('SELECT g AS "group", n, po AS agreement, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM (SELECT g, count(*) AS n, avg(CAST(one = two AS INT)) AS po FROM members GROUP BY g) JOIN (SELECT g, sum(a.c * b.c) / max(m.n * m.n) AS pe FROM (SELECT g, one AS v, count(*) AS c FROM members GROUP BY ALL) a JOIN (SELECT g, two AS v, count(*) AS c FROM members GROUP BY ALL) b USING (g, v) JOIN (SELECT g, count(*) AS n FROM members GROUP BY g) m USING (g) GROUP BY g) USING (g)', '"group" n', "agreement kappa"),
    "j3_shares": rr(f"SELECT \"group\", n, verdict, k AS count, k / n AS share, {_LO} AS lo, {_HI} AS hi FROM (SELECT g AS \"group\", v AS verdict, count(*) AS n, count(*) FILTER (WHERE two = v OR (v = 'any_label_problem' AND two <> 'label_correct')) AS k FROM members, (SELECT unnest(['label_correct', 'ambiguous', 'label_wrong', 'convention', 'any_label_problem']) AS v) GROUP BY ALL)", '"group" n verdict count', "share lo hi"),
    "j3_disagreements": q('SELECT doc_id, grp AS "group", one AS first, two AS second FROM verdicts WHERE one <> two'),
    "j4_audit_sheet": q(
        "SELECT record_id, string_agg(part, '+' ORDER BY part) AS \"group\" FROM (SELECT record_id, 'wrong' AS part FROM (SELECT * FROM judged_choice WHERE hit = 0 ORDER BY md5('j4:wrong:' || record_id) LIMIT 20) UNION ALL SELECT record_id, 'uniform' FROM (SELECT * FROM judged_choice ORDER BY md5('j4:uniform:' || record_id) LIMIT 30) UNION ALL SELECT record_id, 'zero' FROM (SELECT * FROM judged_choice WHERE gold = 0 ORDER BY md5('j4:zero:' || record_id) LIMIT 10)) GROUP BY record_id"
    ),
    "l_record_text": q("SELECT doc_id, md5(text) AS text_md5 FROM documents"),
    "l_run_names": q("SELECT vec_id, 'v3_06b_' || arm || '_n' || vec_id || '_s' || vec_id % 3 || coalesce('_' || noise, '') AS run, '06b' AS size, arm, CAST(vec_id AS INT) AS n, CAST(vec_id % 3 AS INT) AS seed, noise FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'direct_brier' ELSE 'full_sft' END AS arm, CASE WHEN vec_id % 5 = 0 THEN 'noisy' END AS noise FROM embeddings)"),
    "l_splits": q("SELECT split, n, CAST(row_number() OVER (ORDER BY first) AS INT) AS place FROM (SELECT split, min(record_id) AS first, count(*) AS n FROM judged GROUP BY split)"),
    "l_kinds": q("SELECT CASE WHEN qtype = 'noul' THEN question_id ELSE qtype END AS kind, false AS form, count(*) AS n FROM judged GROUP BY ALL"),
    "l_long_metrics": rr("SELECT * FROM (SELECT split, unnest(['n', 'accuracy', 'brier', 'nll']) AS name, unnest([CAST(n AS DOUBLE), accuracy, brier, nll]) AS value FROM (SELECT split, count(*) AS n, avg(hit) AS accuracy, avg(list_sum(list_transform(range(len(probs)), lambda i: pow(probs[i + 1] - CAST(i = gold AS INT), 2)))) AS brier, avg(-ln(greatest(probs[gold + 1], 1e-12))) AS nll FROM judged_choice GROUP BY split))", "split name", "value"),
    "l_files_round_trip": r("SELECT (SELECT count(*) FROM judged_choice) AS n, (SELECT CAST(sum(hit) AS BIGINT) FROM judged_choice) AS hits, (SELECT count(*) FROM log) AS n_log, (SELECT CAST(sum(outcome) AS BIGINT) FROM log) AS outcomes", "n hits n_log outcomes", "", **PL._FX),
    "l_utterances": f"SELECT vec_id, CAST(label AS BIGINT) AS label, ({X.LABELS})[label + 1] AS intent FROM embeddings",
    "l_label_gaps": f"SELECT DISTINCT ({X.LABELS})[label + 1] AS label, 'not described' AS gap FROM embeddings WHERE label < 2 UNION ALL SELECT 'extra', 'not a label'",
    "l_log_metadata": oracle(
        " UNION ALL ".join(
            f"SELECT '{name}' AS log, count(*) AS n, count(*) FILTER (WHERE {sql_uniform('v3_flip:0', chr(34) + 'index' + chr(34))} < {rate}) AS n_flipped, {at is not None} AS known, CAST({'NULL' if at is None else at['seed']} AS INT) AS seed, CAST({'NULL' if at is None else at.get('flip_rate', 0.2)} AS DOUBLE) AS flip_rate, CAST({noise} AS VARCHAR) AS noise FROM log"
            for (name, (rate, at, _)), noise in zip(LOGS.items(), ["NULL", "NULL", "'fixed'", "'soft'", "NULL"], strict=True)
        ),
        **PL._FX,
    ),
    "j6_table_pin": f"SELECT * FROM ({sql_pin('documents', 'source')}) UNION ALL SELECT * FROM ({sql_pin('documents', None)})",
    "j6_pin_mismatches": f"""SELECT coalesce(a.source, b.source) AS source, a.digest AS now, b.digest AS pinned FROM ({sql_pin("(SELECT * REPLACE (CASE WHEN doc_id = 7 THEN text || '.' ELSE text END AS text) FROM documents WHERE source <> 'src3' UNION ALL SELECT * FROM documents WHERE doc_id = 11 AND source <> 'src3')", 'source')}) a
      FULL JOIN ({sql_pin('documents', 'source')}) b USING (source) WHERE a.digest IS DISTINCT FROM b.digest""",
    "j5_digest_check": "SELECT * FROM (SELECT 'n_nationkey=' || n_nationkey AS name, sha256('x') AS sha256, sha256(n_name || chr(10)) AS now FROM nation WHERE n_nationkey % 5 = 0) UNION ALL SELECT 'absent', '0', NULL",
    "m_tumbling": q("SELECT start, start + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT *, date_trunc('day', ts) AS start FROM events) GROUP BY ALL"),
    "m_sliding": q("SELECT start, start + INTERVAL 2 DAY AS \"end\", event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT *, date_trunc('day', ts) - to_days(CAST(unnest([0, 1]) AS INT)) AS start FROM events) GROUP BY ALL"),
    "m_sessions": q("SELECT min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS \"end\", user_id, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 1 HOUR, true) AS INT) AS new FROM events)) GROUP BY user_id, s"),
    "m_running_rate": q("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type"),
    "m_drift": q("SELECT day, count(*) AS n, round(avg(CAST(event_type = 'error' AS INT)), 6) AS rate, abs(avg(CAST(event_type = 'error' AS INT)) - 0.2) > 0.02 AS alarm FROM (SELECT *, date_trunc('day', ts) AS day FROM events) GROUP BY day"),
    "m_drift_by_user": f"""
    WITH RECURSIVE usual AS (SELECT coalesce(avg(CAST(event_type = 'error' AS INT)), 0) AS u FROM events WHERE ts < (SELECT date_trunc('day', min(ts)) + INTERVAL 7 DAY FROM events)),
    closed AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM events),
    days AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM (
      SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY ALL), closed WHERE day + INTERVAL 1 DAY <= w),
    moves AS (SELECT *, CAST(bad * round(1000000 * (ln({ODDS}) - ln(1 + {ODDS - 1} * u))) + (n - bad) * round(-1000000 * ln(1 + {ODDS - 1} * u)) AS BIGINT) AS move FROM days, usual),
    scores AS (SELECT user_id, i, greatest(0, move) AS score FROM moves WHERE i = 1
      UNION ALL SELECT m.user_id, m.i, greatest(0, CASE WHEN s.score > {round(LIMIT * 1000000)} THEN 0 ELSE s.score END + m.move) FROM scores s JOIN moves m ON m.user_id = s.user_id AND m.i = s.i + 1),
    scored AS (SELECT *, score > {round(LIMIT * 1000000)} AS alarm, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS following FROM moves JOIN scores USING (user_id, i))
    SELECT user_id, day, n, bad, round(score / 1000000.0, 6) AS score, CASE WHEN alarm THEN 'alarm' ELSE 'steady' END AS state FROM scored
    UNION ALL SELECT user_id, day + INTERVAL 1 DAY, 0, 0, CASE WHEN alarm THEN 0.0 ELSE round(score / 1000000.0, 6) END, 'silent' FROM scored WHERE coalesce(following, w) - (day + INTERVAL 1 DAY) >= INTERVAL {QUIET} DAY""",
    "m_first_of_each": q("SELECT DISTINCT event_id, event_type FROM events"),
}
_FEW = ORACLES["i5_baseline_metrics"].replace("record_id % 12 AS k FROM judged_choice", "record_id % 12 AS k FROM judged_choice WHERE record_id % 10 <> 3")
_TOLD = "unnest(['accuracy_all', 'lenient_accuracy_all', 'ece', 'parse_failure_rate']) AS metric, unnest([accuracy_all, lenient_accuracy_all, ece, round(1 - n_parsed / n, 6)]) AS value"
_ASKED = ORACLES["i7_latency"]
ORACLES["l_report_rows"] = oracle(
    f"""SELECT run, 'results' AS kind, split, unnest(['accuracy', 'ece']) AS metric, unnest([round(accuracy, 6), round(ece, 6)]) AS value, CAST(n AS BIGINT) AS n, false AS incomplete
      FROM ({ece_sql('run, split', 'all_runs')}) JOIN (SELECT run, split, avg(hit) AS accuracy FROM all_runs GROUP BY ALL) USING (run, split) WHERE run IN ('a', 'b')
    UNION ALL SELECT 'api', 'replies', split, {_TOLD}, CAST(n AS BIGINT), n < (SELECT count(*) FROM results_choice c WHERE c.split = t.split) FROM ({_FEW}) t
    UNION ALL SELECT 'absent', 'missing', NULL, NULL, NULL, NULL, NULL
    UNION ALL SELECT CASE event_type WHEN 'click' THEN 'a' ELSE 'api' END, 'footer', NULL, unnest(['median_ms', 'p95_ms', 'retried_requests']), unnest([median_ms, p95_ms, CAST(retried_requests AS DOUBLE)]), NULL, NULL FROM ({_ASKED}) WHERE event_type IN ('click', 'view')
    UNION ALL SELECT 'a', 'footer', NULL, 'temperature', temperature, NULL, NULL FROM ({PL.ORACLES["f4_fitted"]})
    UNION ALL SELECT unnest(['b', 'absent']), 'footer', NULL, NULL, NULL, NULL, NULL""",
    **PL._FX,
)
ORACLES = {k: v for k, v in ORACLES.items() if v}
