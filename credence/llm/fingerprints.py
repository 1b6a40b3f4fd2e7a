"""Document fingerprints: SimHash with permuted block tables.

The terms of a text are its pairs of adjacent words (single words where there is only one), ASCII
letters in lower case. Each distinct term votes on every bit with the sign of its hash and the
weight ``1 + ln(count)``; a bit is 1 where the votes come out positive. Fingerprints are 128 bits,
written as 32 hex digits. Likeness of two fingerprints is the share of equal bits.

``near_classes`` finds fingerprints within a Hamming radius. The bits are cut into 8 blocks of 16, with
one table per block, and a fingerprint looks up in each table all values within ``radius // 8`` bits of
its own block: two fingerprints in the radius are that close on one block at least. A pair counts only
in the first table where it meets. Equal fingerprints are one class, so copies do not multiply; a class
carries its number of documents and its smallest id. The tables hold a block of ``ASKED`` query
fingerprints at a time, by hash, which every executor reads, and all classes stream past them; blocks
follow one another, so neither the driver nor a task holds more when the query set grows.

``NEAR`` was measured on the documents of sf0.1: pairs become fewest at 31 to 34 bits, between near
copies (most at 19) and strangers (from 35 on, most at 64). One changed word moves 11 bits (median)
in texts of 30 to 60 words and 24 at most, 8 in texts of 60 to 120, 5 of 120 to 300, 3 beyond.

Defined results: a null or empty text, or one without words, has fingerprint zero and its edited
text follows the same rule as any other. Documents with equal ids are ordered by text. A null id
sorts first. With one document, its next document is itself. All rows of one id are in one bucket of
the order, so ids are taken to be nearly unique. Columns other than id and text, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh64_intdigest

from credence.llm.common import bounded_batches, checkpointed, shared_folder, shuffle_width

BITS = 128
RADIUS = 3
#: The radius of ``op5``.
NEAR = 31
BLOCKS = 8
#: Query fingerprints in a block, in the mean.
ASKED = 1 << 17
#: Documents looked up at once, and candidates compared at once.
LOOKED_UP, COMPARED = 256, 1 << 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_C, _D = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S31 = np.uint64(33), np.uint64(31)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _C
    x = (x ^ (x >> _S31)) * _D
    return x ^ (x >> _S33)


def simhash(text: str | None) -> bytes:
    """The fingerprint's 16 bytes."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(BITS // 8)
    h = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    terms = h[:-1] * _A + h[1:] if len(h) > 1 else h
    terms, counts = np.unique(terms, return_counts=True)
    weights = (1 + np.log(counts)).astype(np.float32)
    votes = np.zeros(BITS, dtype=np.float64)
    for i in range(0, len(terms), 4096):  # bounded memory for very long texts
        t = terms[i : i + 4096]
        lanes = np.stack([_mixed(t), _mixed(t * _B + _A)], axis=1)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1).astype(np.float32)
        w = weights[i : i + 4096]
        votes += 2 * (w @ bits) - w.sum()
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / (8 * len(a))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_order(docs: DataFrame) -> DataFrame:
    """``(bucket, doc_id, text, extra)``: documents dealt into ranges of ascending ``doc_id``, each
    bucket followed by an extra row with the first document of the next one (the last by the first).

    The range bounds are quantiles, as many as a few per shuffle partition, so tasks get even shares
    and the driver handles a list of that length only.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * shuffle_width(docs.sparkSession)
    bounds = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)
    bounds = sorted({int(b) for b in bounds})
    bucket = F.lit(0)
    if bounds:
        # the number of bounds at or below the id; a null id goes before all
        bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_width_bucket(bounds))
    dealt = docs.withColumn("bucket", bucket.cast("int"))
    heads = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    order = [r["bucket"] for r in heads.select("bucket").collect()]  # at most as many as the bounds
    order = sorted(order)
    if not order:
        return dealt.withColumn("extra", F.lit(False)).select("bucket", "doc_id", "text", "extra")
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    to = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    tails = heads.select(to[F.col("bucket")].alias("bucket"), F.col("head.doc_id"), F.col("head.text"), F.lit(True).alias("extra"))
    return dealt.select("bucket", "doc_id", "text", F.lit(False).alias("extra")).unionByName(tails)


def _width_bucket(bounds: list[int]):
    """The number of bounds at or below the id, by a tree of comparisons."""
    c = F.col("doc_id")

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def with_edits(docs: DataFrame) -> DataFrame:
    """One row per document: sizes, digests, fingerprints and likenesses."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ordered = (
        in_order(docs)
        .repartition(shuffle_width(spark), "bucket")
        .sortWithinPartitions("bucket", "extra", "doc_id", "text")
    )
    schema = T._parse_datatype_string(
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    arrow = to_arrow_schema(schema)

    def row(key, text, own, following, other):
        changed = edited(text, following)
        hashed = simhash(changed)
        return (
            key, len(text), sha256(changed.encode()).hexdigest(), own.hex(), hashed.hex(),
            likeness(own, hashed), likeness(own, other),
        )

    def run(batches):
        held = None  # the document whose successor is still to come
        for batch in batches:
            out = []
            for bucket, key, text, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = simhash(text)
                if held is not None and held[0] == bucket:
                    out.append(row(*held[1:], text, own))
                held = None if extra else (bucket, key, text, own)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow
                )

    return ordered.mapInArrow(run, schema)


def _blocks(fingerprints: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(fingerprints)), dtype=np.uint16).reshape(-1, BLOCKS)


class _Tables:
    """Query fingerprints by the value of each of their blocks."""

    def __init__(self, blocks: np.ndarray, radius: int):
        self.blocks, self.radius, self.width = blocks, radius, radius // BLOCKS
        values = np.arange(1 << 16)
        self.masks = values[np.bitwise_count(values) <= self.width].astype(np.uint16)
        self.order = [np.argsort(blocks[:, i], kind="stable") for i in range(BLOCKS)]
        #: The halves of the fingerprints in the order of each table.
        self.halves = [blocks.view(np.uint64)[o].T.copy() for o in self.order]
        self.first = [np.searchsorted(blocks[o, i], np.arange((1 << 16) + 1)) for i, o in enumerate(self.order)]

    def near(self, others: np.ndarray):
        """Arrays of query index, other's index and distance, each pair once."""
        for start in range(0, len(others), LOOKED_UP):
            part = others[start : start + LOOKED_UP]
            low_half, high_half = part.view(np.uint64).T.copy()
            for i in range(BLOCKS):
                keys = (part[:, i, None] ^ self.masks).ravel().astype(np.int64)
                n = self.first[i][keys + 1] - self.first[i][keys]
                cells = np.flatnonzero(n)
                if not len(cells):
                    continue
                n, low, row = n[cells], self.first[i][keys[cells]], cells // len(self.masks)
                upto = np.cumsum(n)
                a = 0
                while a < len(cells):
                    before = upto[a - 1] if a else 0
                    b = max(a + 1, int(np.searchsorted(upto, before + COMPARED, side="right")))
                    size = n[a:b]
                    at = np.arange(upto[b - 1] - before) + np.repeat(low[a:b] - (upto[a:b] - size - before), size)
                    one, two = self.halves[i]
                    apart = np.bitwise_count(one[at] ^ np.repeat(low_half[row[a:b]], size))
                    apart += np.bitwise_count(two[at] ^ np.repeat(high_half[row[a:b]], size))
                    found = np.flatnonzero(apart <= self.radius)
                    q, o = self.order[i][at[found]], row[a + np.searchsorted(upto[a:b] - before, found, side="right")]
                    apart = apart[found].astype(np.int64)
                    met = (np.bitwise_count(self.blocks[q, :i] ^ part[o, :i]) <= self.width).any(axis=1)
                    yield q[~met], start + o[~met], apart[~met]
                    a = b


def near_classes(all_fps: DataFrame, queries: DataFrame, radius: int = NEAR, asked: int = ASKED) -> DataFrame:
    """``(fingerprint, near)``: for each distinct query fingerprint, the fingerprints of ``all_fps``
    within ``radius`` bits (itself among them, where it is there), by distance and then by fingerprint,
    with their numbers of documents and smallest ids.

    Both inputs have a column ``fingerprint`` of 32 hex digits, ``all_fps`` one ``doc_id`` as well. The
    query fingerprints are taken in blocks of about ``asked``, each written when it is done.
    """
    spark = all_fps.sparkSession
    bounded_batches(spark)
    classes = checkpointed(all_fps.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs")))
    wanted = checkpointed(queries.select("fingerprint").distinct())
    blocks = -(-wanted.count() // asked)
    schema = T._parse_datatype_string("q string, near array<struct<distance:int,fingerprint:string,doc_id:long,n_docs:long>>")
    arrow = to_arrow_schema(schema)

    def search(shared):
        def run(batches):
            tables = _Tables(np.frombuffer(shared.value, dtype=np.uint16).reshape(-1, BLOCKS), radius)
            for batch in batches:
                fps, ids, n_docs = (c.to_pylist() for c in batch.columns)
                lists: dict[int, list] = {}
                for found in tables.near(_blocks(fps)):
                    for q, o, apart in zip(*(x.tolist() for x in found), strict=True):
                        lists.setdefault(q, []).append((apart, fps[o], ids[o], n_docs[o]))
                if lists:
                    named = [[dict(zip(("distance", "fingerprint", "doc_id", "n_docs"), x, strict=True)) for x in v] for v in lists.values()]
                    keys = [tables.blocks[q].tobytes().hex() for q in lists]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((keys, named), arrow, strict=True)], schema=arrow)

        return run

    path = f"{shared_folder(spark)}/near-{uuid.uuid4().hex}"
    out = None
    for k in range(max(1, blocks)):
        block = wanted.where(F.pmod(F.xxhash64("fingerprint"), F.lit(max(1, blocks))) == k)
        shared = spark.sparkContext.broadcast(_blocks(sorted(r["fingerprint"] for r in block.collect())).tobytes())
        parts = classes.mapInArrow(search(shared), schema)
        out = parts.groupBy(F.col("q").alias("fingerprint")).agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
        out.write.parquet(f"{path}/block={k}")
        shared.unpersist()
    return spark.read.schema(out.schema).parquet(f"{path}/block=*")


def near_counts(all_fps: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fingerprint, n_near)``: for each distinct query fingerprint, how many other distinct
    fingerprints of ``all_fps`` lie within ``radius`` bits; those without any are left out."""
    found = near_classes(all_fps.select("fingerprint", F.lit(None).cast("long").alias("doc_id")), queries, radius)
    counted = found.select("fingerprint", F.size(F.filter("near", lambda x: x["distance"] > 0)).cast("long").alias("n_near"))
    return counted.where("n_near > 0")


def op5(docs: DataFrame) -> DataFrame:
    """Contract columns, and for documents whose id is divisible by 100 (null for the rest): ``n_near``,
    the number of other documents within ``NEAR`` bits, those of equal fingerprint among them, and
    ``near``, the classes these are in, as ``distance:fingerprint:smallest id:documents`` by distance.
    The members of a class are the rows of its fingerprint."""
    rows = checkpointed(with_edits(docs))
    asked = F.col("doc_id") % 100 == 0
    found = near_classes(rows.select("fingerprint", "doc_id"), rows.where(asked).select("fingerprint"))
    said = lambda x: F.concat_ws(":", x["distance"], x["fingerprint"], F.coalesce(x["doc_id"].cast("string"), F.lit("")), x["n_docs"])
    found = found.select(
        F.col("fingerprint").alias("q"),
        (F.aggregate("near", F.lit(0).cast("long"), lambda n, x: n + x["n_docs"]) - 1).alias("n_near"),
        F.array_join(F.transform("near", said), ",").alias("near"),
    )
    kept = rows.where(asked).join(found, F.col("fingerprint") == F.col("q"), "left").drop("q")
    rest = rows.where(F.coalesce(~asked, F.lit(True)))
    rest = rest.withColumns({"n_near": F.lit(None).cast("long"), "near": F.lit(None).cast("string")})
    return kept.unionByName(rest)
