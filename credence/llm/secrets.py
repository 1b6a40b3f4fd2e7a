"""Secret scans: patterns for known forms, and a randomness test battery for the rest.

Base kinds (``assign``, ``access``, ``hex``) are pattern matches. The method adds ``random`` spans:
runs of token characters are cut at ``=`` (trailing padding stays), as in ``NAME=value``, and each
piece is tested whole and in the parts between its ``-_``, its ``+/`` and all four, since a token may
follow a path or a prefix. What lies outside the base spans gets an inferred encoding (the smallest
alphabet that holds it) and three tests of uniform randomness over that alphabet: chi-squared
uniformity of the symbols, the number of runs about the alphabet's middle, and the lag-1 serial
correlation. A part whose tests do not reject randomness gets a p-value under the alternative
"words": the chance that text of this length over this alphabet is spread so evenly. Of overlapping
parts the one with the least such p-value stays (of equal ones the longest). These p-values go
through the Benjamini-Hochberg rule over the whole corpus, within strata of encoding and length, so
short parts, on which the tests have little power, must clear a bar set by parts of their own length.

The false-discovery step needs only a histogram of p-values by stratum, of a fixed size whatever the
corpus; it is summed by Spark and read by the driver.

The null hypothesis of the false-discovery step is "words", because a false report is a path, a name
or a phrase that was taken for a secret. The battery works the other way round: its null is a random
string, so it can refuse what is not random but not vouch for what is. It is a gate before the step.

Defined results: a null text counts as empty and has no spans. Rows are independent, so repeated
rows, ties and null ids pass through. Texts of any length are scanned whole, in linear time. Without
any candidate no threshold exists and only base spans are reported. Other columns, whatever their
names, are not read; ``mask_secrets`` passes them on.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import bounded_batches, map_rows

KINDS = ("assign", "access", "hex")
#: Possessive quantifiers match the same texts as plain ones here and keep the scan linear.
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
#: What lies between the characters that base64 lacks, that base64url lacks, and either of them.
_BETWEEN = (re.compile(r"[^_-]{20,}+"), re.compile(r"[^+/]{20,}+"), re.compile(r"[^+/_-]{20,}+"))
_LEAST = 20

#: Alphabets in the order of their size; the first that holds a run is its encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_INDEX = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
_SETS = [(name, frozenset(a)) for name, a in ALPHABETS.items()]
#: Sum of squared symbol shares in words: letters in text come to about 1/15.
WORD_CONCENTRATION = 0.066
#: Runs for which the battery rejects uniform randomness below this are no candidates.
REJECT = 0.001
#: False-discovery rate within a stratum.
FDR = 0.001
#: Lower ends of the length classes.
LENGTHS = (20, 24, 32, 48, 96)
#: p-values are counted in bins of -log10(p), so many to a unit, up to LAST units.
BINS, LAST = 50, 40
CONTEXT_SCHEMA = "stratum string, bin int, n long"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches, by start and then by kind as listed."""
    found = []
    low = None
    if ":" in text or "=" in text:
        low = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
        found += low
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str) -> tuple[str, float, float] | None:
    """(encoding, p-value of the tests under uniform randomness, p-value under words), or None for
    runs without an encoding: digits alone, letters of one kind alone, or foreign characters."""
    body = run.rstrip("=")
    seen = set(body)
    if not seen or body.isdigit() or body.isalpha() and (body.islower() or body.isupper() or body.istitle()):
        return None
    name = next((n for n, s in _SETS if seen <= s), None)
    if name is None:
        return None
    index, k, n = _INDEX[name], len(ALPHABETS[name]), len(body)
    counts: dict[str, int] = {}
    for c in body:
        counts[c] = counts.get(c, 0) + 1
    chi = k / n * sum(c * c for c in counts.values()) - n
    z_chi = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    values = [index[c] for c in body]
    high = [v >= k // 2 for v in values]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean = 1 + 2 * a * b / n
        sd = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        p_runs = 2 * _upper_normal(abs(runs - mean) / sd)
    else:
        p_runs = 2.0 ** (1 - n)
    middle = sum(values) / n
    spread = sum((v - middle) ** 2 for v in values) or 1e-9
    serial = sum((x - middle) * (y - middle) for x, y in zip(values, values[1:], strict=False)) / spread
    p_serial = 2 * _upper_normal(abs(serial + 1 / n) * math.sqrt(n))
    p_chi = _upper_normal(z_chi)
    joint = -2 * sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    half = joint / 2  # Fisher: chi-squared with 6 degrees of freedom
    p_random = math.exp(-half) * (1 + half + half * half / 2)
    # Under words chi-squared is non-central; Sankaran's cube root brings it to a normal.
    shift = n * max(k * WORD_CONCENTRATION - 1, 0.2)
    df = k - 1
    h = 1 - 2 * (df + shift) * (df + 3 * shift) / (3 * (df + 2 * shift) ** 2)
    p = (df + 2 * shift) / (df + shift) ** 2
    m = (h - 1) * (1 - 3 * h)
    centre = 1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p)
    width = h * math.sqrt(2 * p) * (1 + 0.5 * m * p)
    p_words = _upper_normal(-(((chi / (df + shift)) ** h) - centre) / width) if chi > 0 else 0.0
    return name, p_random, p_words


def stratum(name: str, n: int) -> str:
    return f"{name}:{max(x for x in LENGTHS if x <= n)}"


def parts(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The stretches of a run that are tested, each once."""
    end = a + len(text[a:b].rstrip("="))
    while a < end:
        cut = text.find("=", a, end)
        stop = b if cut < 0 else cut
        if stop - a >= _LEAST:
            yield from {(a, stop), *(m.span() for between in _BETWEEN for m in between.finditer(text, a, stop))}
        a = stop + 1


def candidates(text: str, base: list[tuple[str, int, int]] | None = None) -> list[tuple[int, int, str, int]]:
    """(start, end, stratum, p-value bin) of the parts of runs outside base spans that look random."""
    found = []
    for m in _RUN.finditer(text):
        for a, b in parts(text, *m.span()):
            got = battery(text[a:b])
            if got is not None and got[1] >= REJECT:
                depth = min(int(-math.log10(max(got[2], 1e-300)) * BINS), BINS * LAST)
                found.append((a, b, stratum(got[0], b - a), depth))
    if not found:
        return found
    starts: list[int] = []  # of what is taken, in order and without overlaps: base spans, then parts
    ends: list[int] = []
    for _, a, b in sorted(base_spans(text) if base is None else base, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for part in sorted(found, key=lambda c: (-c[3], c[0] - c[1], c[0])):
        a, b = part[:2]
        at = bisect_left(starts, b)
        if at == 0 or ends[at - 1] <= a:
            starts.insert(at, a)
            ends.insert(at, b)
            out.append(part)
    return sorted(out)


def cutoffs(histogram: list[tuple[str, int, int]], fdr: float = FDR) -> dict[str, int]:
    """Benjamini-Hochberg by stratum: the lowest bin whose runs are all reported."""
    by: dict[str, list[tuple[int, int]]] = {}
    for name, at, n in histogram:
        by.setdefault(name, []).append((at, n))
    out = {}
    for name, bins in by.items():
        total, above = sum(n for _, n in bins), 0
        for at, n in sorted(bins, reverse=True):
            above += n
            if 10 ** (-at / BINS) <= fdr * above / total:
                out[name] = at
    return out


def corpus_cutoffs(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> dict[str, int]:
    """The cutoffs over the whole corpus. The driver reads one row for each stratum and bin."""

    def rows(texts):
        n: dict[tuple[str, int], int] = {}
        for text in texts:
            for _, _, name, at in candidates(text) if text else ():
                n[name, at] = n.get((name, at), 0) + 1
        return [(*k, v) for k, v in n.items()]

    counts = map_rows(docs, [text_col], CONTEXT_SCHEMA, rows).groupBy("stratum", "bin").agg(F.sum("n").alias("n"))
    return cutoffs([tuple(r) for r in counts.collect()], fdr)


def all_spans(text: str | None, cut: dict[str, int]) -> tuple[list, list]:
    """(base spans, base and random spans by start and then by kind)."""
    base = base_spans(text or "")
    more = [("random", a, b) for a, b, name, at in candidates(text or "", base) if at >= cut.get(name, 1 << 30)]
    if not more:
        return base, base
    order = {k: i for i, k in enumerate((*KINDS, "random"))}
    return base, sorted(base + more, key=lambda s: (s[1], order[s[0]], s[2]))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document with its spans as an array of structs."""
    cut = corpus_cutoffs(docs, text_col, fdr)
    schema = "doc_id long, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"

    def rows(ids, texts):
        named = lambda spans: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]
        return [(i, *map(named, all_spans(t, cut))) for i, t in zip(ids, texts, strict=True)]

    return map_rows(docs, [id_col, text_col], schema, rows)


def masked(text: str, spans: list[tuple[str, int, int]], mark: str = "<SECRET>") -> str:
    out, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", fdr: float = FDR) -> DataFrame:
    """The rows of ``docs`` with every span replaced by a mark; all rows stay."""
    import pyarrow as pa

    cut = corpus_cutoffs(docs, text_col, fdr)
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    sized = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        for batch in batches:
            cols, texts = list(batch.columns), []
            for t in batch.column(at).to_pylist():
                spans = all_spans(t, cut)[1]
                texts.append(masked(t, spans) if spans else t)
            cols[at] = pa.array(texts, type=batch.schema.field(at).type)
            if sized is not None:
                cols[sized] = pa.array([None if t is None else len(t) for t in texts], type=batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op1(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    cut = corpus_cutoffs(docs, "text", fdr)

    def rows(ids, texts):
        out = []
        for i, t in zip(ids, texts, strict=True):
            base, spans = all_spans(t, cut)
            n = [sum(s[0] == k for s in base) for k in KINDS]
            out.append((i, *n, sha256(shown(base).encode()).hexdigest(), shown(spans), len(spans) - len(base)))
        return out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return map_rows(docs, ["doc_id", "text"], schema, rows)
