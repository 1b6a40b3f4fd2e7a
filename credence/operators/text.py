"""Deduplication, decontamination, n-gram overlap, form properties and instruction templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.functions import text as T
from credence.functions.draws import digest, uniform
from credence.operators.sampling import seeded_rank, share_count
from credence.session import ship_code, stored

# The yes/no instruction templates by kind, each with its negation.
ASSISTANT = "a banking, travel, home, work or everyday assistant"
TEMPLATES: dict[str, list[tuple[str, str]]] = {
    "about_domain": [
        ("Is this message about {slot}?", "Is this message about something other than {slot}?"),
        ("Does this message concern {slot}?", "Does this message concern something other than {slot}?"),
        ("Is the topic of this message {slot}?", "Is the topic of this message something other than {slot}?"),
    ],
    "out_of_scope": [
        (f"Is this request outside what {ASSISTANT} can help with?", f"Is this request something {ASSISTANT} can help with?"),
        (f"Would {ASSISTANT} be unable to help with this request?", f"Would {ASSISTANT} be able to help with this request?"),
        (f"Is this request out of scope for {ASSISTANT}?", f"Is this request within scope for {ASSISTANT}?"),
    ],
    "about_intent": [
        ("Does this description fit the message: {slot}?", "Does this description fail to fit the message: {slot}?"),
        ("Is this message an example of the following: {slot}?", "Is this message an example of something other than the following: {slot}?"),
    ],
    "is_positive": [
        ("Is the sentiment of this text positive?", "Is the sentiment of this text something other than positive?"),
        ("Does this text express a favourable opinion?", "Does this text express anything other than a favourable opinion?"),
    ],
    "is_negative": [
        ("Is the sentiment of this text negative?", "Is the sentiment of this text something other than negative?"),
        ("Does this text express an unfavourable opinion?", "Does this text express anything other than an unfavourable opinion?"),
    ],
    "expresses_emotion": [
        ("Does this message express {slot}?", "Does this message express something other than {slot}?"),
        ("Is {slot} the main emotion in this message?", "Is something other than {slot} the main emotion in this message?"),
    ],
    "word_count_over": [
        ("Does the text have more than {slot} words?", "Does the text have {slot} words or fewer?"),
        ("Is the text longer than {slot} words?", "Is the text at most {slot} words long?"),
    ],
    "char_count_over": [
        ("Does the text have more than {slot} characters?", "Does the text have {slot} characters or fewer?"),
        ("Is the text longer than {slot} characters?", "Is the text at most {slot} characters long?"),
    ],
    "longest_word_over": [
        ("Does the text contain a word longer than {slot} letters?", "Are all words in the text at most {slot} letters long?"),
        ("Does any word in the text have more than {slot} letters?", "Does every word in the text have {slot} letters or fewer?"),
    ],
    "contains_number": [
        ("Does the text contain a digit?", "Is the text free of digits?"),
        ("Does the text include a number written in digits?", "Does the text include no number written in digits?"),
    ],
    "contains_comma": [
        ("Does the text contain a comma?", "Is the text free of commas?"),
        ("Is there at least one comma in the text?", "Is there no comma in the text?"),
    ],
    "ends_with_question_mark": [
        ("Does the text end with a question mark?", "Does the text end with something other than a question mark?"),
        ("Is the last character of the text a question mark?", "Is the last character of the text something other than a question mark?"),
    ],
}


def text_key(text: Column) -> Column:
    """The digest of the normalised text; keys of 128 bits are shuffled in place of texts."""
    return F.md5(T.normalise(text).cast("binary"))


def excluded_keys(*texts: DataFrame) -> DataFrame:
    """Distinct keys of every text that a test split can draw from (one column each)."""
    out = None
    for t in texts:
        k = t.select(text_key(F.col(t.columns[0])).alias("key"))
        out = k if out is None else out.unionByName(k)
    return out.distinct()


def keep(rows: DataFrame, excluded: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("key", text_key(F.col(text))).join(excluded, "key", "left_anti").drop("key")


def dedupe(rows: DataFrame, excluded: DataFrame, index: str, text: str = "text") -> DataFrame:
    """Per row in the order of ``index``: ``test_text``, ``repeat`` with the first kept row, or ``kept``.

    The first row of a key comes from partial minima, not from a window over the key, and only keys
    that repeat or are excluded are joined back. A key with very many rows is then a long key of that
    join's row side, which adaptive execution splits.
    """
    keyed = rows.select(F.col(index).alias("index"), text_key(F.col(text)).alias("key"))
    first = keyed.groupBy("key").agg(F.min("index").alias("first"), F.count("*").alias("n")).join(excluded.withColumn("out", F.lit(True)), "key", "left")
    noted = first.where("n > 1 or out").select("key", "first", "out")
    reason = F.when(F.col("out"), "test_text").when(F.col("index") > F.col("first"), "repeat").otherwise("kept")
    return keyed.join(noted, "key", "left").select("index", reason.alias("reason"), F.when(reason == "repeat", F.col("first")).alias("first_kept"))


#: Bits of a Bloom filter for each entry, hash functions, and bits at least and at most (16 MB).
BLOOM_BITS, BLOOM_HASHES, BLOOM_SIZE = 16, 3, (1 << 10, 1 << 27)


def _bloom_places(h: Column, bits: int) -> list[Column]:
    """The bits of a 64-bit hash: sums of its halves, modulo a power of two."""
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)
    return [(low + i * high).bitwiseAND(bits - 1) for i in range(BLOOM_HASHES)]


def bloom_filter(hashes: DataFrame, entries: int) -> np.ndarray:
    """A Bloom filter, as 64-bit words, of a column ``h``. The words are or-ed by partial aggregation; the
    driver gets no more than ``BLOOM_SIZE`` allows, and more entries only make it let more pass."""
    least, most = BLOOM_SIZE
    bits = min(max(least, 1 << (max(BLOOM_BITS * entries - 1, 1)).bit_length()), most)
    places = hashes.select(F.explode(F.array(*_bloom_places(F.col("h"), bits))).alias("p"))
    one = F.expr("shiftleft(1L, int(p & 63))")
    words = np.zeros(bits // 64, dtype=np.int64)
    for r in places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("b")).toLocalIterator():
        words[r["w"]] = r["b"]
    return words


def bloom_passed(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """The rows whose hash ``h`` may be in the filter, all of those that are among them; no row is shuffled."""
    shared, bits = rows.sparkSession.sparkContext.broadcast(words), len(words) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            low, high, ok = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64), np.ones(len(h), dtype=bool)
            for i in range(BLOOM_HASHES):
                p = (low + i * high) & (bits - 1)
                ok &= (shared.value[p >> 6] >> (p & 63)) & 1 == 1
            yield batch.filter(pa.array(ok))

    ship_code(rows.sparkSession)
    return rows.mapInArrow(run, rows.schema)


#: Bytes of normalised texts that are hashed at a time.
HASHED = 1 << 20
#: Of the rolling hash: an odd factor, its inverse modulo 2**64, and a random number for each byte.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
BYTE_CODES = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(keys: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of every n-gram of words of normalised texts, repeats included: differences of running
    sums over the bytes, so a gram takes the same time whatever its length. Equal grams have equal hashes."""
    data = np.frombuffer(b" ".join(keys) + b" ", dtype=np.uint8)
    power = np.full(len(data), FACTOR, dtype=np.uint64)
    back = np.full(len(data), INVERSE, dtype=np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_CODES[data] * power)])
    ends = np.flatnonzero(data == 32)  # of words, one after each
    starts = np.concatenate([[0], ends[:-1] + 1])
    text = np.searchsorted(np.cumsum([len(k) + 1 for k in keys]), starts, side="right")
    one = text[: len(text) - n + 1] == text[n - 1 :] if len(text) >= n else np.zeros(0, dtype=bool)
    first = np.flatnonzero(one)
    begin, end = starts[first], ends[first + n - 1]
    h = (sums[end] - sums[begin]) * back[begin]
    return text[first], h ^ (h >> np.uint64(32))


def keyed_grams(rows: DataFrame, n: int, words: np.ndarray | None = None) -> DataFrame:
    """``rows`` (id, key) with the number of words, the digest of the key, and the distinct hashes of its grams;
    with a Bloom filter only those that pass it. One pass over the texts, which stay where they are."""
    out = f"id {rows.schema['id'].dataType.simpleString()}, n_words int, digest string, h array<long>"
    sc = rows.sparkSession.sparkContext
    shared, bits = sc.broadcast(words), 0 if words is None else len(words) * 64

    def hashes(keys: list[bytes]) -> list[list[int]]:
        text, h = gram_hashes(keys, n)
        if shared.value is not None:
            low, high, ok = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64), np.ones(len(h), dtype=bool)
            for i in range(BLOOM_HASHES):
                p = (low + i * high) & (bits - 1)
                ok &= (shared.value[p >> 6] >> (p & 63)) & 1 == 1
            text, h = text[ok], h[ok]
        at = np.searchsorted(text, np.arange(len(keys) + 1))
        return [np.unique(h[a:b].view(np.int64)).tolist() if b > a else [] for a, b in zip(at, at[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("key").to_pylist()
            keys = [(k or "").encode() for k in texts]
            found, some, held = [], [], 0
            for k in keys:
                some.append(k)
                held += len(k)
                if held >= HASHED:
                    found += hashes(some)
                    some, held = [], 0
            found += hashes(some) if some else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([0 if t is None else t.count(" ") + 1 for t in texts], pa.int32()), batch.column("digest"), pa.array(found, pa.list_(pa.int64()))], names=["id", "n_words", "digest", "h"])

    ship_code(rows.sparkSession)
    return rows.select("id", "key", F.md5(F.col("key").cast("binary")).alias("digest")).mapInArrow(run, out)


def overlap(reference: DataFrame, test: DataFrame, n: int = 8) -> DataFrame:
    """Exact matches and n-gram overlap of the test rows (columns id, text) with the reference (text).

    One pass over each side makes digests of the texts and 64-bit hashes of their grams; those of the
    side with more text are tested by a Bloom filter of the other's. What passes is joined by hash,
    and only texts that met are cut into grams, which are compared themselves. Nothing in proportion to
    all grams of the larger side is shuffled.
    """
    key = T.normalise(F.col("text"))
    sides = {"ref": reference.select(F.md5(F.col("text").cast("binary")).alias("id"), "text"), "own": test.select("id", "text")}
    sizes = {k: v.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for k, v in sides.items()}
    small, large = sorted(sides, key=lambda k: (sizes[k], k == "ref"))
    keyed = {small: stored(keyed_grams(sides[small].select("id", key.alias("key")), n))}
    few = keyed[small].select("id", F.explode("h").alias("h"))
    keyed[large] = stored(keyed_grams(sides[large].select("id", key.alias("key")), n, bloom_filter(few, few.count())))
    passed = keyed[large].select("id", F.explode("h").alias("h"))
    met = stored(passed.join(few.select("h").distinct(), "h", "left_semi"))
    found = {large: met, small: few.join(met.select("h").distinct(), "h", "left_semi")}
    grams = lambda df: df.select("id", F.explode(T.ngrams(key, n)).alias("gram"))
    of = {k: grams(sides[k].join(v.select("id").distinct(), "id", "left_semi")) for k, v in found.items()}
    hit = of["own"].join(of["ref"].select("gram").distinct(), "gram", "left_semi").select("id").distinct()
    exact = keyed["own"].join(keyed["ref"].select("digest").distinct(), "digest", "left_semi")
    counts = keyed["own"].agg(F.count("*").alias("n_test"), F.sum((F.col("n_words") >= n).cast("int")).alias("n_with_ngrams"))
    both = counts.join(exact.agg(F.count("*").alias("n_exact"))).join(hit.agg(F.count("*").alias("n_overlap")))  # one row each
    return both.withColumn("overlap_rate", F.try_divide("n_overlap", "n_test"))


def form_measures(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != text], *[f(F.col(text)).alias(k) for k, f in T.FORM_KINDS.items()])


def long_measures(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row per text and kind: kind, value. ``rows`` has the texts, or what ``form_measures`` made of them."""
    m = form_measures(rows, text) if text in rows.columns else rows
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("value")) for k in T.FORM_KINDS])
    return m.select(*[c for c in m.columns if c not in T.FORM_KINDS], F.explode(pairs).alias("m")).select("*", "m.kind", "m.value").drop("m")


def best_threshold(values: DataFrame, by: list[str]) -> DataFrame:
    """The threshold with a share above it closest to one half; the smaller on ties.

    Works on counts by value: distinct lengths of texts are few.
    """
    return threshold_of_counts(values.groupBy(*by, "value").agg(F.count("*").alias("c")), by)


def threshold_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """The same from the counts ``c`` of each value."""
    upto = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    steps = counts.select(*by, F.col("value").alias("t"), (1 - F.sum("c").over(upto) / F.sum("c").over(whole)).alias("share"))
    start = counts.groupBy(*by).agg((F.min("value") - 1).alias("t"), F.lit(1.0).alias("share"))
    return steps.unionByName(start).groupBy(*by).agg(F.min(F.struct(F.abs(F.col("share") - 0.5).alias("gap"), "t", "share")).alias("b")).select(*by, F.col("b.t").alias("threshold"), F.col("b.share").alias("yes_share"))


def form_settings(rows: DataFrame, by: list[str], max_imbalance: float = 0.1, text: str = "text") -> DataFrame:
    """Per group and kind: threshold (null for yes/no kinds), yes share, whether it is balanced enough.
    The texts are measured once, for counts by value that are stored."""
    of = rows.select(*by, *([text] if text in rows.columns else T.FORM_KINDS))
    counts = stored(long_measures(of, text).groupBy(*by, "kind", "value").agg(F.count("*").alias("c")))
    over = threshold_of_counts(counts.where(F.col("kind").endswith("_over")), [*by, "kind"])
    share = F.sum(F.col("value") * F.col("c")) / F.sum(F.when(F.col("value").isNotNull(), F.col("c")))
    flags = counts.where(~F.col("kind").endswith("_over")).groupBy(*by, "kind").agg(share.alias("yes_share"))
    both = over.unionByName(flags.withColumn("threshold", F.lit(None).cast("long")))
    return both.withColumn("used", F.abs(F.col("yes_share") - 0.5) <= max_imbalance)


def form_answers(rows: DataFrame, settings: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    m = long_measures(rows, text).join(settings.where("used"), [*by, "kind"])
    return m.withColumn("answer", F.when(F.col("threshold").isNotNull(), F.col("value") > F.col("threshold")).otherwise(F.col("value") > 0))


def add_form_questions(rows: DataFrame, settings: DataFrame, by: list[str], key: str, p_before: float = 1 / 3) -> DataFrame:
    """0 to 2 distinct used kinds for each row, with answers, and whether each comes before the first question."""
    a = form_answers(rows, settings, by)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(digest("form:kind", F.col(key), F.col("kind"))))  # six kinds a row at most
    wanted = F.floor(uniform("form:count", F.col(key)) * 3)
    chosen = a.withColumn("slot", rank).where(F.col("slot") <= wanted)
    return chosen.select(key, "kind", "slot", "answer", (uniform("form:before", F.col(key), F.col("kind")) < p_before).alias("before"))


STATE_FIELDS = ["channel", "timestamp", "message_id", "user_id", "thread_id", "locale"]


def wrap_states(rows: DataFrame, key: str, share: float = 0.2, text: str = "text") -> DataFrame:
    """Exactly ``round(share * n)`` rows get a JSON state: 1 to 3 random fields and the text at a random place."""
    n = rows.count()
    ranked = seeded_rank(rows, [], digest("wrap", F.col(key)), rows=n)
    wrapped = F.col("rank") <= share_count(share, F.lit(n))
    order = F.array_sort(F.transform(F.array(*map(F.lit, STATE_FIELDS)), lambda f: F.struct(digest("wrap:field", F.col(key), f).alias("d"), f.alias("f"))))
    fields = F.slice(F.transform(order, lambda s: s["f"]), F.lit(1), 1 + F.floor(uniform("wrap:count", F.col(key)) * 3).cast("int"))
    place = F.floor(uniform("wrap:place", F.col(key)) * (F.size(fields) + 1)).cast("int")
    keys = F.concat(F.slice(fields, F.lit(1), place), F.array(F.lit("text")), F.slice(fields, place + 1, F.size(fields)))
    values = F.transform(keys, lambda f: F.concat(F.to_json(F.struct(f.alias("x"))).substr(F.lit(6), F.length(f) + 2), F.lit(": "),
                                                  F.when(f == "text", F.regexp_extract(F.to_json(F.struct(F.col(text).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)).otherwise(F.concat(F.lit('"'), F.substring(digest("wrap:value", F.col(key), f), 1, 8), F.lit('"')))))
    state = F.when(wrapped, F.concat(F.lit("{"), F.array_join(values, ", "), F.lit("}"))).otherwise(F.col(text))
    return ranked.select(F.col(key), F.when(wrapped, "json").otherwise("plain").alias("state_format"),
                         F.when(wrapped, keys).otherwise(F.array().cast("array<string>")).alias("state_fields"), state.alias("state"))


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(k, i, n, p, p.partition("{slot}")[0], p.partition("{slot}")[2], "{slot}" in p) for k, pairs in TEMPLATES.items() for i, pair in enumerate(pairs) for n, p in ((False, pair[0]), (True, pair[1]))]
    return spark.createDataFrame(rows, "kind string, template int, negated boolean, pattern string, prefix string, suffix string, slotted boolean")


def render(pattern: Column, slot: Column) -> Column:
    return F.when(F.contains(pattern, F.lit("{slot}")), F.replace(pattern, F.lit("{slot}"), slot)).otherwise(pattern)


def parse(rows: DataFrame) -> DataFrame:
    """Template, polarity and slot of rendered instructions (columns id, kind, instructions); where
    several patterns fit, that with most fixed text. The templates are a few dozen constants."""
    t = F.broadcast(template_table(rows.sparkSession))
    i = F.col("instructions")
    fits = F.when(F.col("slotted"), F.startswith(i, F.col("prefix")) & F.endswith(i, F.col("suffix")) & (F.length(i) > F.length("prefix") + F.length("suffix"))).otherwise(i == F.col("pattern"))
    m = rows.join(t, "kind").where(fits)
    fixed = F.when(F.col("slotted"), F.length("prefix") + F.length("suffix")).otherwise(F.length("pattern"))
    slot = F.when(F.col("slotted"), F.substring(i, F.length("prefix") + 1, F.length(i) - F.length("prefix") - F.length("suffix")))
    best = m.groupBy("id", "kind").agg(F.max_by(F.struct("template", "negated", slot.alias("slot")), F.struct(fixed.alias("fixed"), (-F.col("template")).alias("t"), (~F.col("negated")).alias("n"))).alias("b"))
    return best.select("id", "kind", "b.*")


def negate(parsed: DataFrame) -> DataFrame:
    """The same template and slot in the other polarity."""
    t = template_table(parsed.sparkSession).select("kind", "template", (~F.col("negated")).alias("negated"), "pattern")
    return parsed.join(F.broadcast(t), ["kind", "template", "negated"]).select("id", "kind", render(F.col("pattern"), F.col("slot")).alias("instructions"))


def descriptions(generated: DataFrame, overrides: DataFrame) -> DataFrame:
    """Generated texts normalised, an override in place of a label's text (columns label, text)."""
    o = overrides.select("label", F.col("text").alias("override"))
    return generated.join(o, "label", "left").select("label", T.plain_description(F.coalesce("override", "text")).alias("text"), F.col("override").isNotNull().alias("overridden"))


def check_lines(rows: DataFrame, longest: int, count: int) -> DataFrame:
    """Refusals of generated line lists (columns id, lines): wrong count, a bad line, repeats."""
    problems = F.filter(F.transform("lines", lambda x: T.line_problem(x, longest)), lambda x: x.isNotNull())
    distinct = F.size(F.array_distinct(F.transform("lines", lambda x: F.lower(F.trim(x)))))
    why = F.when(F.size("lines") != count, "wrong count").when(F.size(problems) > 0, problems[0]).when(distinct < count, "repeated")
    return rows.select("id", F.coalesce(why, F.lit("ok")).alias("status"))
