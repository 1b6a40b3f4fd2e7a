"""Quality rules: repetition coverage by rolling hashes.

Words are runs of characters outside ``\\x20\\x09-\\x0D``. Rolling polynomial hashes of several
n-gram lengths are computed in numpy over the word sequence of each text; the characters of words
inside n-grams that occurred before, and of lines that occurred before, are measured as shares of
all word characters. A document is kept when it passes the base rules and every share is below its
limit.

Defined results: a null or empty text has no words, so every count is 0 and it fails the base rule
(fewer than 50 words). Rows are judged one by one, so repeated rows and equal ids give equal rows;
null ids are carried through. An empty table gives an empty table.
``op10`` reads id and text only, whatever other columns there are; ``keep_good`` passes them on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import map_rows

#: n-gram length -> largest share of word characters inside n-grams seen before.
NGRAM_LIMITS = {5: 0.20, 7: 0.20, 10: 0.20}
#: Largest share of characters inside lines seen before.
LINE_LIMIT = 0.20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SPACE = b" \t\n\x0b\x0c\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BITS = np.uint64(29)


def _covered(n_words: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words inside windows of n words at the given starts."""
    edges = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(edges, starts, 1)
    np.subtract.at(edges, starts + n, 1)
    return np.cumsum(edges[:-1]) > 0


def _repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur at least twice, first occurrences included."""
    n = len(ids)
    if n < 4:
        return 0
    if distinct < 2_000_000:
        keys = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * distinct + ids[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    return int(_covered(n, starts, 3).sum()) if len(starts) else 0


def measure(text: str | None) -> dict:
    """All counts and repetition shares of one text."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    gaps = len(data) - len(data.translate(None, _SPACE))
    out = {
        "n_words": n,
        "word_chars": len(text or "") - gaps,
        "n_symbols": len(data) - len(data.translate(None, b"#*$%&|<>")),
        "n_dup_lines": 0,
        "n_repeat_words": 0,
        "dup_line_share": 0.0,
        **{f"dup_{k}gram_share": 0.0 for k in NGRAM_LIMITS},
    }
    if not n:
        return out
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    if len(set(lines)) < len(lines):
        seen, doubled = set(), 0
        for line in lines:
            if line in seen:
                out["n_dup_lines"] += 1
                doubled += len(line)
            seen.add(line)
        out["dup_line_share"] = doubled / sum(map(len, lines))
    table: dict[bytes, int] = {}
    ids = np.fromiter((table.setdefault(w, len(table)) for w in words), dtype=np.int64, count=n)
    if len(table) == n:
        return out
    out["n_repeat_words"] = _repeat_words(ids, len(table))
    if not out["n_repeat_words"]:
        return out  # a repeated longer window would hold a repeated 3-word window
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    with np.errstate(over="ignore"):
        value = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        value ^= value >> _BITS
        rolled, width = value, 1
        for k in sorted(NGRAM_LIMITS):
            if k >= n:
                break
            while width < k:
                rolled = rolled[:-1] * _BASE + value[width:]
                width += 1
            first = np.unique(rolled, return_index=True)[1]
            if len(first) < len(rolled):
                again = np.ones(len(rolled), dtype=bool)
                again[first] = False
                inside = _covered(n, np.flatnonzero(again), k)
                out[f"dup_{k}gram_share"] = float(size[inside].sum() / size.sum())
    return out


def verdict(m: dict) -> tuple[bool, bool]:
    """(base_failed, kept)."""
    failed = m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]
    kept = (
        not failed
        and m["dup_line_share"] <= LINE_LIMIT
        and all(m[f"dup_{k}gram_share"] <= top for k, top in NGRAM_LIMITS.items())
    )
    return failed, kept


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SHARES = ("dup_line_share", *(f"dup_{k}gram_share" for k in NGRAM_LIMITS))
SCHEMA = ", ".join(
    ["doc_id long", *(f"{c} long" for c in _COUNTS), "base_failed boolean", "kept boolean", *(f"{c} double" for c in _SHARES)]
)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, base verdict, final verdict and the repetition shares."""

    def rows(ids, texts):
        out = []
        for key, text in zip(ids, texts, strict=True):
            m = measure(text)
            failed, kept = verdict(m)
            out.append((key, *(m[c] for c in _COUNTS), failed, kept, *(round(m[c], 6) for c in _SHARES)))
        return out

    return map_rows(docs, [id_col, text_col], SCHEMA, rows)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged; the row's own text decides, so
    clashing or repeated ids cannot mix verdicts up."""
    from credence.llm.common import bounded_batches

    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            mask = [verdict(measure(t))[1] for t in batch.column(at).to_pylist()]
            if any(mask):
                yield batch.filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)


def op10(docs: DataFrame) -> DataFrame:
    return quality_report(docs.select(F.col("doc_id"), F.col("text")))
