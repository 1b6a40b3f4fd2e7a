"""Language identification by a byte convolutional network in numpy.

Texts are put in lower case, encoded as UTF-8 and cut into windows of ``WINDOW`` bytes. Filters of
several widths slide over a window's bytes (one-hot, so a filter is a table of weights by offset and
byte), the maximum of each filter is kept, and a softmax over those maxima gives the languages. The
network is trained by Adam on a bounded sample of labelled documents: at most ``PER_LANGUAGE`` a
language, chosen by a hash of the id, and of all windows of their whole texts at most
``PER_LANGUAGE_WINDOWS``, chosen by a hash as well, wherever in a text they are. A text's score is the mean of its windows'
softmax, weighted by their length; all windows of the text count.

The parameters have a fixed size and travel with the function.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every text if
nothing labelled exists. Ties go to the language that sorts first. Rows are independent, so repeated
rows and null ids pass through. An empty table gives an empty table; very long texts are convolved some
windows at a time.
Columns other than id, text and, for training, lang are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import map_rows, stored
from credence.session import discard

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the labelled sample, a language: documents, and windows of their whole texts.
PER_LANGUAGE, PER_LANGUAGE_WINDOWS = 400, 2400
EPOCHS = 10
SEED = 7
#: Bytes convolved at a time.
CHUNK = 1 << 18

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows as rows of bytes, their lengths): whole text, the last window filled with blanks."""
    n = -(-len(data) // WINDOW)
    rows = np.frombuffer(data.ljust(n * WINDOW), dtype=np.uint8).reshape(n, WINDOW)
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(data) - (n - 1) * WINDOW
    return rows, sizes


class ByteConvNet:
    """Filters of several widths over bytes, max pooling, softmax."""

    def __init__(self, classes: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), dtype=np.float32)

    def _responses(self, x: np.ndarray, table: np.ndarray) -> np.ndarray:
        w = len(table)
        n = x.shape[1] - w + 1
        out = table[0][x[:, :n]]
        for j in range(1, w):
            out += table[j][x[:, j : j + n]]
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01) -> None:
        rng = np.random.default_rng(SEED)
        params = [*self.tables, self.dense, self.bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                xb, yb = x[rows], y[rows]
                pooled, best = [], []
                for t in self.tables:
                    r = self._responses(xb, t)
                    i = r.argmax(axis=1)
                    best.append(i)
                    pooled.append(np.take_along_axis(r, i[:, None, :], axis=1)[:, 0])
                h = np.concatenate(pooled, axis=1)
                g = np.maximum(h, 0)
                z = g @ self.dense + self.bias
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.dense.T) * (h > 0)
                grads = []
                for k, (t, i) in enumerate(zip(self.tables, best, strict=True)):
                    d = np.zeros_like(t)
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    lane = np.broadcast_to(np.arange(FILTERS), i.shape)
                    for j in range(len(t)):
                        np.add.at(d[j], (np.take_along_axis(xb, i + j, axis=1), lane), part)
                    grads.append(d)
                grads += [g.T @ p, p.sum(axis=0)]
                step += 1
                for q, (a, d) in enumerate(zip(params, grads, strict=True)):
                    m[q] += 0.1 * (d - m[q])
                    v[q] += 0.001 * (d * d - v[q])
                    a -= rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax by window. Adjacent bytes are looked up as pairs, which halves the work."""
        if not hasattr(self, "_pairs"):
            self._pairs = [
                [(j, (t[j][:, None] + t[j + 1][None]).reshape(65536, FILTERS)) for j in range(0, len(t) - 1, 2)] for t in self.tables
            ]
        both = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        pooled = []
        for t, pairs in zip(self.tables, self._pairs, strict=True):
            n = x.shape[1] - len(t) + 1
            r = None
            for j, table in pairs:
                got = table.take(both[:, j : j + n], axis=0)
                r = got if r is None else np.add(r, got, out=r)
            if len(t) % 2:
                r += t[-1].take(x[:, len(t) - 1 :], axis=0)
            pooled.append(r.max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; windows of many texts are convolved together."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.classes:
            return out
        sums = np.zeros((len(texts), len(self.classes)))
        held, sizes, owners, n = [], [], [], 0

        def flush():
            p = self.probabilities(np.concatenate(held)) * np.concatenate(sizes)[:, None]
            np.add.at(sums, np.concatenate(owners), p)
            held.clear(), sizes.clear(), owners.clear()

        asked = [i for i, t in enumerate(texts) if has_letter(t)]
        for i in asked:
            x, s = windows(texts[i].lower().encode())
            for at in range(0, len(x), CHUNK // WINDOW):
                part = x[at : at + CHUNK // WINDOW]
                held.append(part), sizes.append(s[at : at + len(part)]), owners.append(np.full(len(part), i))
                n += part.size
                if n >= CHUNK:
                    flush()
                    n = 0
        if held:
            flush()
        for i in asked:
            k = int(sums[i].argmax())
            out[i] = self.classes[k], float(min(1.0, sums[i][k] / sums[i].sum()))
        return out


def held_out(id_column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4)) == 2


def _lowest(rows: DataFrame, hashed: Column, many: int, few: bool) -> DataFrame:
    """The rows of each language with the lowest hashes. A bound on the hash that follows from the
    language's count leaves a few times as many to rank, so a language with a third of all rows sends no
    more than another."""
    by = rows.groupBy("lang").agg(F.count("*").alias("__n"))
    keyed = rows.withColumn("__hash", hashed)
    place = (F.col("__hash").cast("double") + 2.0**63) / 2.0**64
    near = keyed.join(F.broadcast(by) if few else by, "lang").where(place * F.col("__n") <= 4.0 * many)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("__hash", *rows.columns))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= many).select(*rows.columns)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, windows_per_language: int = PER_LANGUAGE_WINDOWS) -> list[tuple[str, int, list[bytes]]]:
    """(language, id, windows) of a bounded sample of labelled documents that are not held out.

    Documents are chosen from the id and language columns alone, those of the lowest hashes, and of all
    windows of their whole texts again those of the lowest hashes.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & F.col("doc_id").isNotNull())
    few = usable.select("lang").distinct().count() <= 1000
    ids = _lowest(usable.select("doc_id", "lang"), F.xxhash64("doc_id"), per_language, few)
    chosen = ids.select("doc_id", "lang").distinct()
    if few:  # at most per_language ids each
        chosen = F.broadcast(chosen)

    def rows(langs, keys, texts):
        out = []
        for lang, key, text in zip(langs, keys, texts, strict=True):
            if has_letter(text):
                x, _ = windows(text.lower().encode())
                out += [(lang, key, i, w.tobytes()) for i, w in enumerate(x)]
        return out

    every = stored(map_rows(usable.join(chosen, ["doc_id", "lang"], "left_semi"), ["lang", "doc_id", "text"], "lang string, doc_id long, i long, window binary", rows))
    found = _lowest(every, F.xxhash64("doc_id", "i", "window"), windows_per_language, few).groupBy("lang", "doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "window"))).alias("windows"))
    got = sorted((r["lang"], r["doc_id"], [bytes(w["window"]) for w in r["windows"]]) for r in found.collect())
    discard(every)
    return got


def fit(labelled: list[tuple[str, int, list[bytes]]]) -> ByteConvNet:
    classes = sorted({lang for lang, _, x in labelled if x})
    net = ByteConvNet(classes)
    if classes:
        x = [np.frombuffer(w, dtype=np.uint8) for _, _, some in labelled for w in some]
        y = [classes.index(lang) for lang, _, some in labelled for _ in some]
        net.train(np.stack(x), np.array(y))
    return net


def op8(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    net = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, per_language)))

    def rows(ids, texts, held):
        return [(i, h, *got) for i, h, got in zip(ids, held, net.value.predict(texts), strict=True)]

    return map_rows(
        docs, ["doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")],
        "doc_id long, held_out boolean, lang_pred string, score double", rows,
    )
