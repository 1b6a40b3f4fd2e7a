"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Features are the words of a text (letters, lower case) and the beginnings of words, which stand for
stems; a feature's value is ``1 + ln(count)``. The model is ``P(grade <= k) = sigmoid(t[k] - w.x)``
with one weight vector ``w`` for all the ordered thresholds ``t``; it gives the expected grade.

Training uses a bounded sample of labelled documents, ``PER_CLASS`` of each label by a hash of the
id, and of near copies among them (an equal least hash of their 3-word shingles, for any of four
hash functions) only one, since a copied text would pass its chance words off as evidence. Features
are chosen by the likelihood ratio of their association with the label. Labels are yes or no, so
grades are made of them and of evidence from other documents: the sample is halved by a hash of the
id, each half gives a lexicon of whole words tied to its toxic label, and a toxic document gets grade
1, 2 or 3 by the thirds of the number of its words that are in the lexicon of the half it is not in.
Documents labelled clean have grade 0. A document's grade so depends on neither its own words' part
in the statistics nor on the features and weights of the model.

The model has a weight for each feature of the bounded sample above the likelihood ratio, none cut, and
travels with the function.

Where labels of one id clash, it counts as toxic; labels that are null or neither 0 nor 1 count for
nothing. Columns other than id and text are not read.

Defined results: a null or empty text, or one without a letter, has no feature, so it gets the
expected grade of the thresholds alone, near 0. Without labels of both kinds every text gets
grade 0 and expected grade 0. Rows are independent, so repeated rows and null ids pass through.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from credence.llm.common import checkpointed, documents, map_rows

PER_CLASS = 3000
GRADES = 4
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Likelihood ratio beyond which a feature is chosen (a chance of about 1 in 10**8, as there are
#: millions of features), and that beyond which a word of one half enters its lexicon.
RATIO = 32.0
LEXICON_RATIO = 16.0
#: Weight of all clean documents in training, as a multiple of that of all others.
CLEAN_WEIGHT = 8.0
STEPS = 400
L2 = 1e-4
_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 400_000


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class OrdinalModel:
    """Cumulative-link regression; ``names`` gives the index of a feature."""

    def __init__(self, names: dict[str, int]) -> None:
        self.names = names
        self.weights = np.zeros(len(names))
        self.cuts = np.arange(GRADES - 1, dtype=float) + 1
        self._memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memo": {}}

    def hits(self, text: str | None) -> list[tuple[int, ...]]:
        """The chosen features of each word that has any."""
        memo, out = self._memo, []
        for w in words(text):
            got = memo.get(w)
            if got is None:
                got = tuple(self.names[f] for f in features_of(w) if f in self.names)
                if len(memo) > _MEMO:
                    memo.clear()
                memo[w] = got
            if got:
                out.append(got)
        return out

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(feature indices, values)."""
        counts: dict[int, int] = {}
        for h in self.hits(text):
            for j in h:
                counts[j] = counts.get(j, 0) + 1
        at = np.fromiter(counts, dtype=np.int64, count=len(counts))
        return at, 1 + np.log(np.fromiter(counts.values(), dtype=float, count=len(counts)))

    def at_least(self, score: float) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        return [1 / (1 + math.exp(min(700.0, max(-700.0, c - score)))) for c in self.cuts]

    def predict(self, text: str | None) -> tuple[list[float], int]:
        if not len(self.weights):
            return [0.0] * (GRADES - 1), 0
        at, x = self.vector(text)
        p = self.at_least(float(self.weights[at] @ x))
        return p, sum(q > 0.5 for q in p)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> None:
        """Gradient ascent (Adam) on the log-likelihood; thresholds stay ordered by their gaps."""
        row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
        col = np.concatenate([a for a, _ in rows]) if rows else np.zeros(0, dtype=np.int64)
        val = np.concatenate([x for _, x in rows]) if rows else np.zeros(0)
        n, k = len(rows), GRADES - 1
        clean = grades == 0
        weight = np.where(clean, CLEAN_WEIGHT * (~clean).sum() / max(1, clean.sum()), 1.0)
        first, gaps = 1.0, np.zeros(k - 1)
        params = np.concatenate([self.weights, [first], gaps])
        m, v = np.zeros_like(params), np.zeros_like(params)
        d = len(self.weights)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        for step in range(1, STEPS + 1):
            w, steps = params[:d], np.exp(params[d + 1 :])
            cuts = params[d] + np.concatenate([[0], np.cumsum(steps)])
            s = np.bincount(row, val * w[col], minlength=n)
            below = sigmoid(cuts[None] - s[:, None])  # P(grade <= k)
            edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
            hi, lo = edge[np.arange(n), grades + 1], edge[np.arange(n), grades]
            p = np.maximum(hi - lo, 1e-12)
            dhi, dlo = weight * hi * (1 - hi) / p, weight * lo * (1 - lo) / p
            grad_cut = np.bincount(grades, dhi, minlength=GRADES)[:k] - np.bincount(grades, dlo, minlength=GRADES)[1:]
            grad_s = -(dhi - dlo)
            grad = np.concatenate([
                np.bincount(col, val * grad_s[row], minlength=d) / n - L2 * w,
                [grad_cut.sum() / n],
                np.array([grad_cut[i + 1 :].sum() for i in range(k - 1)]) * steps / n,
            ])
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            params = params + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights = params[:d]
        self.cuts = params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])


def signature(text: str, functions: int = 4) -> list[int]:
    """The least hash of the text's 3-word shingles under each of several hash functions."""
    w = text.lower().split()
    first = np.fromiter((xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), dtype=np.uint64)
    with np.errstate(over="ignore"):
        return [int((first * np.uint64(2 * (k + 7) ** 9 + 1) >> np.uint64(1)).min()) for k in range(functions)]


def one_of_copies(rows: list[tuple[int, int, list[int]]]) -> list[int]:
    """Ids of the first row, by id, of each group of rows with the same label that share a signature value."""
    seen: set[tuple[int, int, int]] = set()
    out = []
    for key, label, values in sorted(rows):
        named = {(label, k, v) for k, v in enumerate(values)}
        if seen.isdisjoint(named):
            out.append(key)
        seen |= named
    return out


def half_of(key: int) -> int:
    """The half of the sample that a document is in."""
    return xxh64_intdigest(str(key), 1) & 1


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, text, toxic)`` of at most ``per_class`` labelled documents of each label, without near copies."""
    spark = docs.sparkSession
    of = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = of.where("toxic = 0").orderBy(*key).limit(per_class).union(of.where("toxic = 1").orderBy(*key).limit(per_class))
    texts = docs.where("text is not null").select("doc_id", "text")

    def signed(ids, labels, texts):
        return [(i, a, signature(t)) for i, a, t in zip(ids, labels, texts, strict=True)]

    # at most 2 * per_class ids are broadcast and as many signatures read by the driver
    drawn = map_rows(texts.join(F.broadcast(ids), "doc_id"), ["doc_id", "toxic", "text"], "doc_id long, toxic int, sig array<long>", signed)
    rows = [(r["doc_id"], r["toxic"], list(r["sig"])) for r in drawn.collect()]
    label = {r[0]: r[1] for r in rows}
    chosen = spark.createDataFrame([(k, label[k]) for k in one_of_copies(rows)], "doc_id long, toxic int")
    return texts.join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> OrdinalModel:
    chosen = sample(docs, labels, per_class)

    def seen(ids, texts, labels):
        n: dict[tuple[str, int], list[int]] = {}
        for i, text, label in zip(ids, texts, labels, strict=True):
            half = half_of(i)
            for f in {f for w in set(words(text)) for f in features_of(w)}:
                n.setdefault((f, half), [0, 0])[label] += 1
        return [(*f, *c) for f, c in n.items()]

    def halved(ids, labels):
        return [(half_of(i), label) for i, label in zip(ids, labels, strict=True)]

    sizes = {(r["half"], r["toxic"]): r["n"] for r in map_rows(chosen, ["doc_id", "toxic"], "half int, toxic int", halved).groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    size = [[sizes.get((h, label), 0) for label in (0, 1)] for h in (0, 1)]
    clean, toxic = (size[0][label] + size[1][label] for label in (0, 1))
    if not clean or not toxic:
        return OrdinalModel({})
    sums = [F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in "ct"]
    found = map_rows(chosen, ["doc_id", "text", "toxic"], "feature string, half int, c long, t long", seen).groupBy("feature").agg(*sums)
    found = checkpointed(found)

    def ratio(c, t, clean: int, toxic: int):
        part = lambda n, size: F.when(n > 0, n * F.log(n * float(clean + toxic) / ((t + c) * float(size)))).otherwise(0.0)
        return 2 * (part(t, toxic) + part(c, clean)) if clean and toxic else F.lit(0.0)

    def top(of: DataFrame, ratio, least: float) -> list[str]:
        """The names of all features above a ratio; the sample of documents is what bounds them."""
        rows = of.select("feature", ratio.alias("ratio")).where(F.col("ratio") > least).collect()
        return [r["feature"] for r in sorted(rows, key=lambda r: (-r["ratio"], r["feature"]))]

    names = top(found, ratio(F.col("c0") + F.col("c1"), F.col("t0") + F.col("t1"), clean, toxic), RATIO)
    model = OrdinalModel({f: i for i, f in enumerate(names)})
    lexicons = []
    for h in (0, 1):
        c, t = F.col(f"c{h}"), F.col(f"t{h}")
        toxic_words = found.where(~F.col("feature").endswith("*") & (t * float(size[h][0]) > c * float(size[h][1])))
        lexicons.append(frozenset(top(toxic_words, ratio(c, t, *size[h]), LEXICON_RATIO)))

    def vectors(ids, texts, labels):
        out = []
        for i, text, label in zip(ids, texts, labels, strict=True):
            at, x = model.vector(text)
            lexicon = lexicons[1 - half_of(i)]
            out.append((i, label, at.tolist(), x.tolist(), sum(w in lexicon for w in words(text))))
        return out

    got = map_rows(chosen, ["doc_id", "text", "toxic"], "doc_id long, toxic int, at array<int>, x array<double>, evidence int", vectors).collect()
    got.sort(key=lambda r: (r["doc_id"], r["evidence"], r["at"]))
    evidence = np.array([r["evidence"] for r in got])
    label = np.array([r["toxic"] for r in got])
    own = np.sort(evidence[label == 1])  # ties share their middle rank
    rank = (np.searchsorted(own, evidence, "left") + np.searchsorted(own, evidence, "right")) / (2 * len(own))
    grades = np.where(label == 1, 1 + (rank > 1 / 3) + (rank > 2 / 3), 0)
    model.fit([(np.array(r["at"], dtype=np.int64), np.array(r["x"])) for r in got], grades)
    return model


def grade(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """One row per document: expected grade, most likely cumulative grade and the probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of the bounded sample's features

    def rows(ids, texts):
        out = []
        for i, text in zip(ids, texts, strict=True):
            p, g = shared.value.predict(text)
            out.append((i, sum(p), g, g > 0, *p))
        return out

    schema = "doc_id long, expected_severity double, grade int, toxic boolean, " + ", ".join(f"p_at_least_{k} double" for k in range(1, GRADES))
    return map_rows(docs, ["doc_id", "text"], schema, rows)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return grade(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
