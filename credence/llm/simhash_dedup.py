"""SimHash near-duplicates by an inverted index over byte positions.

Fingerprints are 64 bits: each 3-word shingle (ASCII letters in lower case, repeats included) votes
with its XXH64, and a bit is 1 if more than half of the hashes have it. Two fingerprints link at
``RADIUS`` or fewer differing bits, so at least ``8 - RADIUS`` of their eight positional bytes are
equal: the guaranteed number of matches.

The index has a posting list for every combination of that many positions with their bytes. This is
the count filter, done by the keys: a pair that meets in a list has reached the guaranteed count, and
no pair that can link is missed. Lists of single bytes with a tally by pair would be the textbook
form, but there each of 2048 lists holds 1/256 of all fingerprints, and 8/512 of all pairs would have
to be counted. A list's fingerprints agree on five bytes; at most 2**24 distinct ones fit in it,
whatever the corpus. In each list pairs are verified by their differing bits, and only the links that
join separate parts of the list are sent on.

Equal fingerprints are one node from the start, so groups of copies cost nothing here.

Defined results: a null text, or one without a word, has fingerprint zero and is linked like any
other. With repeated rows or equal ids every row is returned. A null id takes part in linking but
does not name a component unless it is alone; its component_id is then null. Columns other than id
and text are not read; ``one_of_each`` passes them on. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from credence.llm.common import bounded_batches, checkpointed, map_rows, shuffle_width
from credence.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
BYTES = 8
NEEDED = BYTES - RADIUS
#: The sets of positions; a set and its bytes name a posting list.
POSITIONS = list(combinations(range(BYTES), NEEDED))
#: Lists above this size look partners up among the values at most RADIUS bits away.
DIRECT = 2048

_FREE = 8 * RADIUS
_BALL = np.array(
    [sum(1 << b for b in bits) for r in range(1, RADIUS + 1) for bits in combinations(range(_FREE), r)], dtype=np.uint32
)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        h = np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
        h = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, fp as a signed long."""

    def rows(ids, texts):
        return [(i, signed(fingerprint(t))) for i, t in zip(ids, texts, strict=True)]

    return map_rows(docs, [id_col, text_col], "doc_id long, fp long", rows)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint once for every set of positions: (list, fingerprint)."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k, at in enumerate(POSITIONS):
            key = np.full(len(fps), k, dtype=np.uint64)
            for p in at:
                key = (key << np.uint64(8)) | ((fps >> np.uint64(8 * p)) & np.uint64(255))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps.view(np.int64))], names=["list", "fp"])


def _links_direct(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the parts of a list, by comparing each value reached with those not reached."""
    left = values
    while len(left):
        reach, left = [left[0]], left[1:]
        while reach and len(left):
            v = reach.pop()
            near = np.bitwise_count(left ^ v) <= RADIUS
            for w in left[near]:
                yield int(v), int(w)
                reach.append(w)
            left = left[~near]


def _links_by_lookup(values: np.ndarray, at: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """The same for long lists, linear in their length: the positions outside the list's set hold
    24 bits, and all values at most RADIUS bits away are looked up in a table of those."""
    free = [p for p in range(BYTES) if p not in at]
    packed = np.zeros(len(values), dtype=np.uint32)
    for p in free:
        packed = (packed << np.uint32(8)) | ((values >> np.uint64(8 * p)) & np.uint64(255)).astype(np.uint32)
    where = np.full(1 << _FREE, -1, dtype=np.int32)
    where[packed] = np.arange(len(values), dtype=np.int32)
    for first in range(len(values)):
        if where[packed[first]] < 0:
            continue
        where[packed[first]] = -1
        reach = [first]
        while reach:
            i = reach.pop()
            found = where[packed[i] ^ _BALL]
            for j in found[found >= 0].tolist():
                where[packed[j]] = -1
                yield int(values[i]), int(values[j])
                reach.append(j)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by list: links between the parts of each list, those that are new to the task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    held: list[tuple[np.ndarray, np.ndarray]] = []  # batches whose last list may go on

    def close(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        cut = np.flatnonzero(np.diff(keys)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
        out = []
        for g in np.flatnonzero(end - begin > 1):
            values = np.unique(fps[begin[g] : end[g]])
            at = POSITIONS[int(keys[begin[g]]) >> (8 * NEEDED)]
            for a, b in _links_direct(values) if len(values) <= DIRECT else _links_by_lookup(values, at):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((signed(a), signed(b)))
        if out:
            a, b = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        done = int(np.searchsorted(keys, keys[-1]))
        if held and (done or keys[0] != held[-1][0][-1]):  # what is held ends in this batch or before it
            held.append((keys[:done], fps[:done]))
            got = close(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
        else:
            got = close(keys[:done], fps[:done]) if done else None
        held.append((keys[done:], fps[done:]))
        if got:
            yield got
    if held and (got := close(*(np.concatenate(x) for x in zip(*held, strict=True)))):
        yield got


def links(distinct_fps: DataFrame) -> DataFrame:
    """``(u, v)``: links between fingerprints of the one-column table, enough of them to connect all
    that are connected."""
    n = shuffle_width(distinct_fps.sparkSession)
    listed = distinct_fps.repartition(n).mapInArrow(_postings, "list long, fp long")  # each is expanded 56 times
    return listed.repartition(n, "list").sortWithinPartitions("list").mapInArrow(_links, "u long, v long")


def _parts(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fp and other columns, one row per fingerprint) with ``part``, the least fingerprint
    of its component."""
    found = components(links(nodes.select("fp")))
    return nodes.join(found, nodes.fp == found.node, "left").withColumn("part", F.coalesce("root", "fp")).drop("node", "root")


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: component_id is the smallest id of the component."""
    bounded_batches(docs.sparkSession)
    fps = checkpointed(fingerprints(docs, id_col, text_col))
    of = _parts(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    least = of.groupBy("part").agg(F.min("first").alias("component_id"))
    named = checkpointed(of.join(least, "part").select(F.col("fp").alias("node"), "component_id"))
    return fps.join(named, fps.fp == named.node).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component does: that with the smallest id
    (rows without an id come last), of several texts with that id the one whose hash is least, and of
    several rows with that text the least by the other columns. Rows are told apart by id and text,
    so clashing and null ids lose no component."""
    bounded_batches(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))

    def rows(ids, hashes, texts):
        return [(i, h, signed(fingerprint(t))) for i, h, t in zip(ids, hashes, texts, strict=True)]

    seen = map_rows(docs.select(F.col(id_col).alias("i"), key.alias("h"), F.col(text_col).alias("t")), ["i", "h", "t"], "i long, h long, fp long", rows)
    row = F.struct(F.col("i").isNull().alias("none"), "i", "h", "n")
    least = checkpointed(seen.groupBy("i", "h", "fp").agg(F.count("*").alias("n")).groupBy("fp").agg(F.min(row).alias("head")))
    heads = _parts(least).groupBy("part").agg(F.min("head").alias("head"))
    heads = checkpointed(heads.select(F.col("head.i").alias("__head_id"), F.col("head.h").alias("__head_hash"), F.col("head.n").alias("__head_rows")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__head_id")) & (key == F.col("__head_hash"))
    kept = docs.join(heads, same)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    several = kept.where("__head_rows > 1").groupBy("__head_id", "__head_hash").agg(F.min(F.struct(id_col, text_col, *rest)).alias("__least"))
    several = several.select(*[F.col(f"__least.`{c}`").alias(c) for c in docs.columns])
    return kept.where("__head_rows = 1").select(*docs.columns).unionByName(several)


def op7(docs: DataFrame) -> DataFrame:
    found = clustered(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
