"""Fill-in-middle transformation with a sparse index of checkpoints.

A text is kept as UTF-8 bytes. While its code points are counted, every ``EVERY`` bytes a checkpoint is
recorded: the byte offset and the code points before it. A cut after so many code points is a binary
search among the checkpoints and a short rescan, of ``EVERY`` bytes at most, from the one below. Texts
are counted a stretch at a time, so besides text and output a task holds 8 bytes for each checkpoint.

The cuts and the form come from a digest of the id, so they do not depend on partitions or retries.
``restored`` rebuilds the text from output and form alone, by built-in string functions: the marks
occur nowhere else, as a text that contains one of them is never transformed.

Defined results: a null or empty text counts as empty and is plain; a null id is hashed as no digits.
Rows are independent, so repeated rows and equal ids each give their own row, and an empty table gives
an empty table. Very long texts are cut like any others (an output of over 2 GiB is more than a string
of Spark's holds). Columns other than id and text, whatever their names, are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import bounded_batches

#: Bytes from one checkpoint to the next, and bytes counted at a time.
EVERY, STRETCH = 1 << 10, 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are transformed, and of 100 of these so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = "1"


class Checkpoints:
    """Code points of UTF-8 bytes, and the byte offset of each."""

    def __init__(self, data: bytes, every: int = EVERY):
        self.bytes, self.every = np.frombuffer(data, dtype=np.uint8), every
        counts, stretch = [np.zeros(1, dtype=np.int64)], max(STRETCH // every, 1) * every
        for at in range(0, len(data), stretch):
            part = self._leads(at, at + stretch)
            counts.append(np.add.reduceat(part, np.arange(0, len(part), every), dtype=np.int64))
        self.before = np.cumsum(np.concatenate(counts))  # code points before each checkpoint, and in all
        self.n = int(self.before[-1])

    def _leads(self, a: int, b: int) -> np.ndarray:
        """Which bytes begin a code point."""
        return (self.bytes[a:b] & 0xC0) != 0x80

    def offset(self, units: int) -> int:
        """The byte offset after so many code points."""
        if units >= self.n:
            return len(self.bytes)
        k = int(np.searchsorted(self.before, units, side="right")) - 1
        at = k * self.every
        return at + int(np.flatnonzero(self._leads(at, at + self.every))[units - self.before[k]])


def draws(key: int | None, seed: str) -> list[int]:
    h = sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(key: int | None, data: bytes, seed: str, share: int, suffix_first: int) -> tuple:
    """(code points, form, code points of prefix and of middle, output) of one text."""
    index = Checkpoints(data)
    n = index.n
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    one, two, whether, which = draws(key, seed)
    if not n or whether % 100 >= share or p in data or s in data or m in data:
        return n, "plain", None, None, data
    lo, hi = sorted((one % (n + 1), two % (n + 1)))
    a, b = index.offset(lo), index.offset(hi)
    if which % 100 < suffix_first:
        return n, "spm", lo, hi - lo, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return n, "psm", lo, hi - lo, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


def fill_in_middle(docs: DataFrame, seed: str = SEED, share: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, a row for each document."""
    bounded_batches(docs.sparkSession)
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            got = [transformed(k, t.as_py() or b"", seed, share, suffix_first) for k, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            if got:
                *cols, out = zip(*got, strict=True)
                cols = [pa.array(c, kind) for c, kind in zip(cols, kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", *kinds, "output"])

    out = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11(docs: DataFrame) -> DataFrame:
    """The transformation of whole texts, by digests of its output and of the text rebuilt from it."""
    out, form = F.col("output"), F.col("form")
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(out, 256).alias("output_sha256"), F.sha2(restored(out, form), 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, [CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS g FROM d),
c AS (
  SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS lo, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS hi,
    CASE WHEN n = 0 OR g[3] % 100 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM g),
p AS (SELECT *, substr(t, 1, lo) AS a, substr(t, lo + 1, hi - lo) AS b, substr(t, hi + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE a || b || z END) AS restored_sha256
FROM p"""
