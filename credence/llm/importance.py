"""Importance resampling towards a target: bucket streams, sort-count, and gathered gains.

Features are runs of words of a text (ASCII letters in lower case), repeats included, and a feature's
bucket is a checksum of its bytes modulo ``BUCKETS``.

1. ``streams`` writes the buckets of all features as packed 16-bit streams: a row holds those of many
   documents, one after the other, with the offset of each. A document of more than ``PART`` features
   is cut into parts, each in a row with others or of its own, so no stream grows with one text.
2. ``bucket_counts`` sorts a stream at a time and run-length encodes it, and sums the runs by bucket:
   the external sort's runs are never longer than a stream, and at most ``BUCKETS`` rows leave a task.
3. ``gains`` compares the buckets of target and documents: a table of ``BUCKETS`` integers, which
   is the only thing that is broadcast.
4. ``gathered`` looks up the gains of a stream and adds them up by document with ``np.add.reduceat``.

``drawn`` ranks by range partitions: rows go to partitions by score, id and row number, so ties and
copies are spread, each row's rank is its place in its partition plus the rows of those before.

Defined results: a null or empty text, or one without words, has no features and weight 0. A null id is
hashed as no digits, and ranks before others of its score. Rows are told apart by a number of their
own, so repeated rows and equal ids each give their own row. An empty table gives an empty table, and
an empty target gives the gains of its zero counts. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import bounded_batches, shuffle_width, stored

BUCKETS = 10_000
#: Words of the longest feature.
WORDS = 1
#: Features of one document's part; bytes of text whose words are held at a time.
PART, STRETCH = 1 << 20, 1 << 20
SEED, LEAST_WORDS, PERCENT = "2024", 20, 10
#: All bytes but digits, letters and those beyond ASCII become blanks, and letters small.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def stretches(data: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """The text with blanks between its words, in pieces that end with a word."""
    at = 0
    while at < len(data):
        end = at + size
        part = data[at:end].translate(_WORDS)
        if end < len(data):
            cut = part.rfind(b" ") + 1
            while not cut and at + len(part) < len(data):  # a word longer than a stretch
                more = data[at + len(part) : at + 2 * len(part)].translate(_WORDS)
                blank = more.find(b" ") + 1
                cut = blank and len(part) + blank
                part += more
            part = part[: cut or len(part)]
        yield part
        at += len(part)


def features(data: bytes, words: int = WORDS, buckets: int = BUCKETS, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """Buckets of the features of a text, some at a time: runs of 1 to ``words`` words."""
    before: list[bytes] = []
    for part in stretches(data, stretch):
        some = before + part.split()
        for n in range(1, words + 1):
            first = max(len(before) - n + 1, 0)  # runs that end among the new words
            runs = some[first:] if n == 1 else [b" ".join(some[i : i + n]) for i in range(first, len(some) - n + 1)]
            yield (np.fromiter(map(crc32, runs), dtype=np.uint32, count=len(runs)) % np.uint32(buckets)).astype(np.uint16)
        before = some[len(some) - words + 1 :] if words > 1 else []


def word_count(data: bytes) -> int:
    return sum(len(p.split()) for p in stretches(data))


def streams(docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS, id_col: str | None = "doc_id", text_col: str = "text", part: int = PART, stretch: int = STRETCH) -> DataFrame:
    """``(rows, ids, n_words, offsets, stream)``: packed buckets of the features of some documents. A
    part that is not a document's first has no words, so that sums over parts are right."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is a 16-bit number")
    bounded_batches(docs.sparkSession)
    id_ = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), id_.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["rows", "ids", "n_words", "offsets", "stream"]

    def packed(some: list[tuple[int, int | None, int, np.ndarray]]) -> pa.RecordBatch:
        rows, ids, n_words, parts = zip(*some, strict=True)
        ends = np.cumsum([0, *map(len, parts)])
        data = np.concatenate(parts).astype("<u2").tobytes()
        cols = [pa.array([c], pa.list_(pa.int64())) for c in (rows, ids, n_words, ends[:-1].tolist())]
        return pa.RecordBatch.from_arrays([*cols, pa.array([data], pa.binary())], names=names)

    def run(batches):
        some, size = [], 0
        for batch in batches:
            for row, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                data = text.as_py()
                n, held, many = word_count(data) if words > 1 else None, [], 0
                for found in features(data, words, buckets, stretch):
                    held.append(found)
                    many += len(found)
                    if many >= part:
                        some.append((row, key, many if n is None else n, np.concatenate(held)))
                        n, held, many, size = n and 0, [], 0, size + many
                    if size >= part:
                        yield packed(some)
                        some, size = [], 0
                some.append((row, key, many if n is None else n, np.concatenate(held) if held else np.zeros(0, np.uint16)))
                size += many
                if size >= part:
                    yield packed(some)
                    some, size = [], 0
            if some:
                yield packed(some)
                some, size = [], 0

    schema = "rows array<long>, ids array<long>, n_words array<long>, offsets array<long>, stream binary"
    return stored(numbered.mapInArrow(run, schema))


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: features of each bucket, from sorted and run-length encoded streams."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for stream in batch.column(0):
                data = np.sort(np.frombuffer(stream.as_py(), dtype="<u2"), kind="stable")  # a radix sort
                first = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]])[: len(data)])
                total[data[first]] += np.diff(first, append=len(data))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    return packed.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` of all buckets: a thousand times the logarithm of the ratio of smoothed shares
    in the target and in the documents, floored."""
    zero = F.lit(0).cast("long")
    every = own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for name, counts in (("s", own), ("t", target)):
        every = every.join(counts.select("bucket", F.col("n").alias(name)), "bucket", "left").withColumn(name, F.coalesce(name, zero))
    sums = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return every.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def gathered(packed: DataFrame, table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(row, doc_id, n_words, n_features, weight)``: the floored mean of the gains of each document."""
    by_bucket = np.zeros(buckets, dtype=np.int64)
    for r in table.collect():  # as many rows as buckets
        by_bucket[r["bucket"]] = r["gain"]
    shared = packed.sparkSession.sparkContext.broadcast(by_bucket)
    names = ["row", "doc_id", "n_words", "n_features", "gain"]

    def run(batches):
        of = shared.value
        for batch in batches:
            for rows, ids, n_words, offsets, stream in zip(*batch.columns, strict=True):
                data = np.frombuffer(stream.as_py(), dtype="<u2")
                at = np.asarray(offsets.values)
                size = np.diff(at, append=len(data))
                sums, some = np.zeros(len(at), dtype=np.int64), size > 0
                if some.any():
                    sums[some] = np.add.reduceat(of[data], at[some])
                yield pa.RecordBatch.from_arrays([rows.values, ids.values, n_words.values, pa.array(size, pa.int64()), pa.array(sums)], names=names)

    each = packed.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, gain long")
    whole = each.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in names[2:]])
    # pmod and div keep to integers, and the mean goes down for negative sums too
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))
    return whole.select("row", "doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def scored(weights: DataFrame, seed: str = SEED) -> DataFrame:
    """With ``score``: the weight and a Gumbel number from the id's digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weights.withColumn("score", F.col("weight") + gumbel.cast("long"))


def drawn(scores: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """With ``rank`` 1, 2, 3 ... for the highest scores, so many percent of the eligible rows."""
    keyed = scores.withColumn("ok", F.coalesce(eligible, F.lit(False)))
    n = shuffle_width(scores.sparkSession)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")]
    dealt = keyed.where("ok").select("row", "doc_id", "score").repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition's number, and 33 bits of the place in it
    placed = stored(dealt.select("row", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place")))
    parts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    most, before, starts = sum(parts.values()) * percent // 100, 0, []
    for part in sorted(parts):
        starts.append((part, before))
        before += parts[part]
    start = F.broadcast(scores.sparkSession.createDataFrame(starts, "part long, start long"))
    rank = placed.join(start, "part").select("row", (F.col("start") + F.col("place") + 1).alias("rank")).where(F.col("rank") <= most)
    return keyed.join(rank, "row", "left").drop("ok")


def resampled(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every document of ``docs`` (doc_id, text) by
    its likeness to ``target`` (text); documents without a rank are not drawn."""
    packed = streams(docs, words, buckets)
    table = gains(bucket_counts(packed, buckets), bucket_counts(streams(target, words, buckets, None), buckets), buckets)
    scores = stored(scored(gathered(packed, table, buckets), seed))
    return drawn(scores, F.col("n_words") >= least_words, percent).drop("row")


def op13(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
