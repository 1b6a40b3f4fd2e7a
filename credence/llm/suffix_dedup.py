"""Suffix-array deduplication: remove every byte covered by a string of ``WIDTH`` bytes that also
starts somewhere else.

Cutting the work into parts. A window is a string of WIDTH bytes. Its anchor is the least hash of its
``GRAM``-byte substrings (the leftmost of equals), so equal windows have equal anchors at equal
offsets, wherever they are. Adjacent windows mostly share an anchor; they form a segment, the bytes
from the first such window's start to the last one's end. A window can only repeat where its anchor's
substring does, so

1. anchors whose substring occurs once in all documents are done: nothing there repeats;
2. anchors whose segments are all equal are done: every window there repeats;
3. of the rest, each distinct segment goes, once, to the suffix array of its anchor's group.

Suffix arrays (step 3) are built by two-stage sorting in each task over batches of whole groups:
suffixes smaller than their successors are sorted directly, the others are induced from them by one
scan of the buckets, and the common prefixes of neighbours give the windows that repeat. Only the
suffixes that start a window, and those needed to induce them, are sorted, to a depth of WIDTH bytes.

A group of more than ``LARGE`` distinct segments (a passage that very many documents share, with
other text around it) is split, so that no task gathers it. Equal windows have the anchor at the same
offset, so the windows of a group fall into two classes by that offset, and all windows of a class
reach some way beyond the anchor: on the left as far as the class's least offset, on the right as far
as its greatest leaves room. Pieces whose bytes differ there cannot share a window; the class is split
by them. Equal pieces become one with a count, crowded groups are halved again, and the last classes
hold one offset, where a piece is one window and equal ones are one piece, so that no others repeat. All
other groups of all rounds go to suffix arrays together.

Groups of copies cost little: equal segments are one segment with a count from the first step on, and
each of a segment's windows repeats if the count is above one. Such equality (step 2 and the counts)
is that of 128-bit digests, beside the 64-bit hash of the anchor's substring.

The same is done once more on words: each word's 64-bit hash is 8 bytes, WIDTH is then 50 words, and
windows start at words only. This finds the passages of 50 words or more that repeat, of which those
below 400 bytes are out of the reach of the byte rule.

Defined results: a null text counts as empty; texts shorter than WIDTH bytes lose nothing. Repeated
rows are documents like any other, so all of their windows repeat. Equal or null ids are kept apart
by their texts. Every row is returned; an empty table gives an empty table. Columns other than
id and text are not read. Offsets are 32-bit, as a text of Spark's is below 2 GiB.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from credence.llm.common import bounded_batches, checkpointed, map_rows, shuffle_width, stored
from credence.session import discard

WIDTH = 400
GRAM = 64
#: Bytes of a word's hash; WIDTH then holds 50 words, and a gram 8.
WORD = 8
#: Units of a text whose anchors are sought at a time.
STRETCH = 1 << 22
#: Bytes of words hashed at a time, and the longest that are hashed so.
BLOCK, LONG = 1 << 16, 256
#: Bytes of segments that one suffix array covers, more only for a single group.
BATCH = 1 << 19
#: Distinct segments of one anchor, or pieces of a class, beyond which they are split.
LARGE = 1024
_NO_ID = -(1 << 63)


# --- anchors ---------------------------------------------------------------------------------------


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words: polynomials, from running sums over a block of words at a time;
    words longer than ``LONG`` bytes by XXH3."""
    every = np.frombuffer(data, dtype=np.uint8)
    space = np.ones(len(every) + 2, dtype=np.int8)
    space[1:-1] = _SPACE[every]
    edges = np.flatnonzero(np.diff(space))
    starts, ends = edges[::2], edges[1::2]
    h = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = int(np.searchsorted(ends, starts[i] + BLOCK, "right"))
            if j > i:
                at = starts[i]
                part = every[at : ends[j - 1]].astype(np.uint64) + np.uint64(1)
                sums = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(part * _UP[: len(part)], out=sums[1:])
                h[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * _DOWN[starts[i:j] - at]
            i = max(j, i + 1)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        h[k] = xxh3_64_intdigest(data[starts[k] : ends[k]])
    return h


def units(data: bytes, step: int) -> bytes:
    """The bytes in which matches are sought: those of the text, or 64-bit hashes of its words."""
    return data if step == 1 else word_hashes(data).tobytes()


def _gram_hashes(h: np.ndarray, many: int) -> np.ndarray:
    """A hash of the units from each position, a power of two of them, by doubling the length."""
    base, n = np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while n < many:
            h = h[:-n] * base + h[n:]
            base, n = base * base, 2 * n
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _anchors(data: bytes, width: int, step: int = 1) -> Iterator[tuple[int, int, int, int]]:
    """(first window start, last window start, anchor position, anchor's hash) of each segment of a
    text, in units."""
    low = np.uint64((1 << 24) - 1)
    width, gram = width // step, GRAM // step
    reach = width - gram + 1
    every = np.frombuffer(data, dtype=np.uint8 if step == 1 else np.uint64)
    for begin in range(0, len(every) - width + 1, STRETCH):
        part = every[begin : begin + STRETCH + width - 1]
        grams = _gram_hashes(part.astype(np.uint64) + np.uint64(1) if step == 1 else part, gram)
        v = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # ties go to the left
        padded = np.full(-(-len(v) // reach) * reach, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(v)] = v
        rows = padded.reshape(-1, reach)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - width + 1
        least = np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n])
        at = (least & low).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [n]]) - 1
        at = at[first]
        hashes = (grams[at] ^ np.uint64(step)).view(np.int64)  # bytes and words have anchors of their own
        yield from zip((first + begin).tolist(), (last + begin).tolist(), (at + begin).tolist(), hashes.tolist(), strict=True)


def _long(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


_HALVES = struct.Struct(">qq")


def _digest(data: bytes, at: int) -> tuple[int, int]:
    """128 bits of some bytes with the anchor at an offset."""
    return _HALVES.unpack(xxh3_128_digest(data, at))


def segments(data: bytes, width: int, step: int = 1) -> tuple[dict[tuple[int, int, int], list[int]], list[tuple[int, int]]]:
    """The distinct segments of one text, (gram, two halves of the segment's digest) to [first start,
    starts, offset of the anchor, count up to 2], and the ranges that repeat inside the text."""
    seen: dict[tuple[int, int, int], list[int]] = {}
    wide = width // step
    inside = []
    for a, b, p, gram in _anchors(data, width, step):
        key = gram, *_digest(data[a * step : b * step + width], p - a)
        if (old := seen.get(key)) is None:
            seen[key] = [a, b - a + 1, p - a, 1]
        else:
            if old[3] == 1:
                inside.append((old[0], old[0] + old[1] - 1 + wide))
                old[3] = 2
            inside.append((a, b + wide))
    return seen, merged(inside)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# --- suffix arrays ---------------------------------------------------------------------------------


def two_stage_sort(text: bytes, wanted: np.ndarray, depth: int) -> tuple[bytes, list[int]]:
    """The suffixes of ``text`` that start at ``wanted`` (a mask), in the order of their first
    ``depth`` bytes, and the text with its end marks. Suffixes needed to induce them come along.

    Suffixes smaller than their successors are sorted directly. A suffix larger than its successor
    is put at the head of its first byte's bucket when the scan comes to its successor: in a bucket,
    the larger-than-successor suffixes come first, in the order of their successors.
    """
    text = text + b"\x00\xff"  # the last suffix of the text proper has a smaller one after it
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(data)
    ends = np.flatnonzero(data[1:] != data[:-1])  # of runs of one byte, but for the last run
    rises = np.zeros(n, dtype=bool)  # smaller than its successor
    rises[: ends[-1] + 1] = np.repeat(data[ends] < data[ends + 1], np.diff(ends, prepend=-1))
    need = np.zeros(n, dtype=bool)
    need[: len(wanted)] = wanted
    falls = np.flatnonzero(need & ~rises)
    if len(falls):  # the run from each needed falling suffix to the next rising one
        stops = np.flatnonzero(rises)
        edges = np.bincount(falls, minlength=n + 1) - np.bincount(stops[np.searchsorted(stops, falls)] + 1, minlength=n + 1)
        need |= np.cumsum(edges[:-1]) > 0
    up, down = np.flatnonzero(need & rises), np.flatnonzero(need & ~rises)
    ups, downs = np.bincount(data[up], minlength=256), np.bincount(data[down], minlength=256)
    start = np.concatenate([[0], np.cumsum(ups + downs)[:-1]])
    order: list[int] = [-1] * (len(up) + len(down))
    up = up[np.argsort(data[up], kind="stable")]
    done = 0
    for byte in np.flatnonzero(ups).tolist():  # a bucket at a time bounds the memory of the keys
        some = up[done : done + ups[byte]].tolist()
        some.sort(key=lambda i: text[i : i + depth])
        done += len(some)
        to = int(start[byte] + downs[byte])
        order[to : to + len(some)] = some
    head = start.tolist()
    induced = (need & ~rises).tolist()
    for i in range(len(order)):
        j = order[i] - 1
        if j >= 0 and induced[j]:
            byte = text[j]
            order[head[byte]] = j
            head[byte] += 1
    return text, order


def common_prefixes(text: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """For each neighbouring pair of the suffix array the bytes they share, at most ``depth``."""
    padded = text + bytes(depth + 16)
    words = np.ndarray(len(text) + depth + 8, dtype="<u8", buffer=padded, strides=(1,)).astype(np.uint64)  # 8 bytes from each place
    at = np.asarray(order, dtype=np.int64)
    left, right = at[:-1], at[1:]
    shared = np.full(max(len(at) - 1, 0), depth, dtype=np.int64)
    alive = np.arange(len(shared))
    for k in range(0, depth, 8):
        apart = words[left + k] ^ words[right + k]
        ended = np.flatnonzero(apart)
        if len(ended):
            x = apart[ended]
            same = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3  # whole bytes below the first set bit
            shared[alive[ended]] = k + same.astype(np.int64)
            on = apart == 0
            alive, left, right = alive[on], left[on], right[on]
            if not len(alive):
                break
    return np.minimum(shared, depth)


def repeated_starts(parts: list[tuple[bytes, int]], width: int, step: int = 1) -> list[np.ndarray]:
    """For each (segment, number of window starts): the starts whose window occurs again among the parts."""
    text = b"".join(p for p, _ in parts)
    sizes = np.array([len(p) for p, _ in parts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    wanted = np.zeros(len(text), dtype=bool)
    for b, (_, n) in zip(begin.tolist(), parts, strict=True):
        wanted[b : b + n * step : step] = True
    marked, order = two_stage_sort(text, wanted, width)
    # suffixes that only served to induce others, or whose window leaves its segment, do not count
    order = np.asarray(order, dtype=np.int64)
    order = order[order < len(wanted)]
    at = order[wanted[order]]
    again = np.zeros(len(text), dtype=bool)
    if len(at) > 1:
        equal = common_prefixes(marked, at, width) >= width
        again[at[:-1][equal]] = True
        again[at[1:][equal]] = True
    return [np.flatnonzero(again[b : b + n * step : step]) for b, (_, n) in zip(begin.tolist(), parts, strict=True)]


def _runs(starts: np.ndarray) -> list[dict]:
    """Ascending starts as runs of adjacent ones."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1
    return [{"lo": int(starts[a]), "hi": int(starts[b])} for a, b in zip(first, last, strict=True)]


_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _array_task(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of PIECE sorted by key; a batch of whole groups of one step makes one array."""
        held: dict[int, dict[tuple[int, int, int, int], tuple[bytes, int, int]]] = {}
        sizes: dict[int, int] = {}
        now, group = None, {}

        def array(step: int) -> pa.RecordBatch | None:
            pieces = held.pop(step, {})
            sizes[step] = 0
            found = repeated_starts([p[:2] for p in pieces.values()], width, step) if pieces else []
            out = [(*k[:3], _runs(f + k[3])) for (k, p), f in zip(pieces.items(), found, strict=True) if p[2] == 1 and len(f)]
            if out:
                *names, runs = zip(*out, strict=True)
                return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in names), pa.array(runs, _RUNS)], names=["gram", "seg", "seg2", "runs"])

        def close() -> pa.RecordBatch | None:
            if not group:
                return None
            step, own = now[1], sum(len(x[0]) for x in group.values())
            got = array(step) if step in held and sizes[step] + own > BATCH else None
            held.setdefault(step, {}).update(group)
            sizes[step] = sizes.get(step, 0) + own
            group.clear()
            return got

        for batch in batches:
            for key, step, g, s, t, at, starts, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, step) != now:
                    if (got := close()) is not None:
                        yield got
                    now = key, step
                group[g, s, t, at] = (data, starts, n)
        if (got := close()) is not None:
            yield got
        for step in list(held):
            if (got := array(step)) is not None:
                yield got

    return run


# --- the whole -------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with a key: the id and a hash of id and text."""
    id_ = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(id_, F.lit(_NO_ID).cast("long")).alias("did"), F.xxhash64(id_, text).alias("h"), id_.alias("doc_id"), text.alias("text")
    )


def _bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Fetch the bytes of segments: ``wanted`` has (did, h) and the columns below."""
    by_doc = wanted.groupBy("did", "h").agg(F.collect_list(F.struct("step", "gram", "seg", "seg2", "a", "starts", "n", "off")).alias("parts"))
    width = WIDTH

    def rows(texts, parts):
        out = []
        for text, some in zip(texts, parts, strict=True):
            text = text.encode()
            data = {step: units(text, step) for step in {p["step"] for p in some}}
            for p in some:
                step = p["step"]
                end = (p["a"] + p["starts"] - 1) * step + width
                out.append((p["gram"], step, p["gram"], p["seg"], p["seg2"], 0, p["starts"], p["n"], p["off"], data[step][p["a"] * step : end]))
        return out

    schema = "key long, step int, gram long, seg long, seg2 long, at int, starts int, n int, off int, bytes binary"
    return map_rows(docs.join(by_doc, ["did", "h"]), ["text", "parts"], schema, rows)


#: What a task of suffix arrays gets of a piece: its group, its segment, the segment's start that its
#: first one is, how many starts, how often it occurs (up to 2), and its bytes.
PIECE = ["key", "step", "gram", "seg", "seg2", "at", "starts", "n", "bytes"]
_FOUND = "gram long, seg long, seg2 long, runs array<struct<lo:int,hi:int>>"


def _arrays(pieces: DataFrame) -> DataFrame:
    n = shuffle_width(pieces.sparkSession)
    return pieces.select(*PIECE).repartition(n, "key").sortWithinPartitions("key", "step").mapInArrow(_array_task(WIDTH), _FOUND)


def halves(data: bytes, off: int, starts: int, lo: int, hi: int, width: int, step: int = 1) -> list[tuple]:
    """The two classes of a piece's windows, those with the anchor's offset in ``lo..middle`` and in
    ``middle+1..hi``: (key, digest halves, lo, hi, anchor's offset in the piece, starts, first start, bytes)."""
    out, middle, wide = [], (lo + hi) // 2, width // step
    for low, high in ((lo, middle), (middle + 1, hi)):
        first, last = max(0, off - high), min(starts - 1, off - low)
        if first <= last:
            part = data[first * step : (last + wide) * step]
            key = _long(xxh3_64_intdigest(data[(off - low) * step : (off + wide - high) * step], low << 16 | high))
            out.append((key, *_digest(part, off - first), low, high, off - first, last - first + 1, first, part))
    return out


def _split(fetched: DataFrame, crowded: DataFrame, large: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Of crowded groups of segments: what repeats as a whole (as ``_arrays`` gives it), the pieces whose
    groups are small enough for an array, and the tables that these read."""
    width, found, small, held = WIDTH, [], [], []
    schema = "key long, step int, d1 long, d2 long, lo int, hi int, off int, starts int, at int, bytes binary, gram long, seg long, seg2 long, n int"
    rest = ["step", "lo", "hi", "off", "starts", "at", "bytes", "gram", "seg", "seg2"]

    def rows(steps, los, his, offs, starts, ats, data, grams, segs, segs2, counts):
        out = []
        for step, lo, hi, off, s, at, d, g, a, b, n in zip(steps, los, his, offs, starts, ats, data, grams, segs, segs2, counts, strict=True):
            for key, d1, d2, low, high, o, few, first, part in halves(d, off, s, lo, hi, width, step):
                out.append((key, step, d1, d2, low, high, o, few, at + first, part, g, a, b, n))
        return out

    pieces = fetched.withColumns({"lo": F.lit(0), "hi": (F.lit(width - GRAM) / F.col("step")).cast("int")})
    while not crowded.isEmpty():
        each = stored(map_rows(pieces.join(crowded, "key", "left_semi"), [*rest, "n"], schema, rows))
        one = each.groupBy("key", "d1", "d2").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.any_value(F.struct(*rest)).alias("one"))
        pieces = stored(one.select("key", "d1", "d2", "n", "one.*"))
        held.append(pieces)
        again = pieces.where("n > 1").select("key", "d1", "d2")
        whole = each.where("n = 1").join(again, ["key", "d1", "d2"], "left_semi")
        run = F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("starts") - 1).alias("hi"))
        found.append(stored(whole.select("gram", "seg", "seg2", F.array(run).alias("runs"))))
        discard(each)  # a finished round
        groups = pieces.groupBy("key").agg(F.count("*").alias("pieces"), F.min("n").alias("n"), F.max(F.col("hi") - F.col("lo")).alias("range"))
        groups = checkpointed(groups.where("pieces > 1 and n = 1"))
        crowded = groups.where((F.col("pieces") > large) & (F.col("range") > 0)).select("key")
        fine = groups.where((F.col("pieces") <= large) & (F.col("range") > 0)).select("key")  # one window each otherwise, all different
        small.append(pieces.join(fine, "key", "left_semi").select(*PIECE))
    return found, small, held


def removals(keyed: DataFrame, large: int | None = None, steps: tuple[int, ...] = (1,)) -> DataFrame:
    """``(did, h, step, lo, hi)``: ranges covered by what starts anywhere else, possibly overlapping;
    of bytes for step 1, and of words for the step of a word's hash."""
    width = WIDTH
    large = LARGE if large is None else large

    names = ["did", "h", "step", "gram", "seg", "seg2", "a", "starts", "off", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.int32()] * 4]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for d, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = t.encode()
                for step in steps:
                    data = units(text, step)
                    if len(data) >= width:
                        parts, inside = segments(data, width, step)
                        both = [*zip(*parts, strict=True), *zip(*parts.values(), strict=True)]
                        many = len(parts) + len(inside)
                        for col, part in zip(cols, ([d] * many, [h] * many, [step] * many, *both), strict=True):
                            col += part
                        if inside:
                            none = [None] * len(inside)
                            for col, part in zip(cols[3:], (none, none, none, *zip(*inside, strict=True), none, none), strict=True):
                                col += part
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    bounded_batches(keyed.sparkSession)
    schema = "did long, h long, step int, gram long, seg long, seg2 long, a int, starts int, off int, n int"
    table = stored(keyed.select("did", "h", "text").mapInArrow(found, schema))
    at = ["did", "h", "step"]
    inside = table.where("gram is null").select(*at, F.col("a").alias("lo"), F.col("starts").alias("hi"))
    anchors, segment = table.where("gram is not null"), ["gram", "seg", "seg2"]
    ends = [f(c).alias(f"{n}_{c}") for c in ("seg", "seg2") for n, f in (("least", F.min), ("most", F.max))]
    grams = anchors.groupBy("gram").agg(F.sum("n").alias("times"), *ends).where("times > 1")
    grams = grams.select("gram", ((F.col("least_seg") == F.col("most_seg")) & (F.col("least_seg2") == F.col("most_seg2"))).alias("alike"))
    candidates = stored(anchors.join(grams, "gram"))
    wide = (F.lit(width) / F.col("step")).cast("int")
    span = [F.col("a").alias("lo"), (F.col("a") + F.col("starts") - 1 + wide).alias("hi")]
    alike = candidates.where("alike").select(*at, *span)
    mixed = candidates.where("not alike")
    one = F.min(F.struct("did", "h", "step", "a", "starts", "off")).alias("one")
    distinct = stored(mixed.groupBy(*segment).agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), one))
    wanted = distinct.select(*segment, "n", "one.*")
    crowded = checkpointed(distinct.groupBy(F.col("gram").alias("key")).count().where(F.col("count") > large).select("key"))
    if crowded.isEmpty():
        arrays = stored(_arrays(_bytes_of(keyed, wanted)))
    else:
        fetched = stored(_bytes_of(keyed, wanted))
        whole, small, held = _split(fetched, crowded, large)
        # the groups of all rounds go to arrays together
        arrays = _arrays(reduce(DataFrame.unionByName, small, fetched.join(crowded, "key", "left_anti").select(*PIECE)))
        arrays = stored(reduce(DataFrame.unionByName, whole, arrays))
        discard(fetched, *held, *whole)
    whole = mixed.join(distinct.where("n > 1").select(*segment), segment, "left_semi").select(*at, *span)
    partly = mixed.join(arrays, segment).select(*at, "a", F.explode("runs").alias("r"))
    partly = partly.select(*at, (F.col("a") + F.col("r.lo")).alias("lo"), (F.col("a") + F.col("r.hi") + wide).alias("hi"))
    return inside.union(alike).union(whole).union(partly)


def _cut(text: str, ranges: list) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed) of one text."""
    data = text.encode()
    out, at = [], 0
    spans = merged([(r["lo"], r["hi"]) for r in ranges or ()])
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out), sum(b - a for a, b in spans), len(spans)


def with_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int | None = None, passages: bool = False) -> DataFrame:
    """``(doc_id, text, ranges, passages)``: every row with the byte ranges to remove and, if asked
    for, the word ranges of repeated passages; null where there are none."""
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    found = removals(keyed, large, (1, WORD) if passages else (1,))
    ranges = found.groupBy("did", "h").agg(*[F.collect_set(F.when(F.col("step") == k, F.struct("lo", "hi"))).alias(n) for k, n in ((1, "ranges"), (WORD, "passages"))])
    return keyed.join(ranges, ["did", "h"], "left").select("doc_id", "text", "ranges", "passages")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the bytes that stay."""

    def rows(ids, texts, ranges):
        return [(i, *_cut(t, r)) for i, t, r in zip(ids, texts, ranges, strict=True)]

    return map_rows(with_ranges(docs, id_col, text_col), ["doc_id", "text", "ranges"], "doc_id long, kept binary, n_removed long, n_spans long", rows)


def op6(docs: DataFrame, large: int | None = None) -> DataFrame:
    """Bytes removed by the 400-byte rule; then ``n_passages`` and ``n_passage_words``: maximal runs of
    words covered by ``WIDTH // WORD`` words that also start anywhere else, and the words in them.
    Passages shorter than 400 bytes are reported there but never removed."""

    def rows(ids, texts, ranges, passages):
        out = []
        for i, t, r, p in zip(ids, texts, ranges, passages, strict=True):
            kept, removed, spans = _cut(t, r)
            words = merged([(x["lo"], x["hi"]) for x in p or ()])
            out.append((i, len(kept) + removed, removed, spans, sha256(kept).hexdigest(), len(words), sum(b - a for a, b in words)))
        return out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long"
    return map_rows(with_ranges(docs, large=large, passages=True), ["doc_id", "text", "ranges", "passages"], schema, rows)
