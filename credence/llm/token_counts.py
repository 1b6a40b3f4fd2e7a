"""Token counts of documents by distinct pre-tokens.

The tokenizer is a BPE model of the sentencepiece library whose path is a parameter. It turns a blank
into the mark ``▁``, puts one in front, and merges characters. A piece has the mark only at its start,
and a line end is in no piece, so merges never cross the places before a run of marks or a line end:
the text falls into pre-tokens there, and its tokens are those of its pre-tokens, one after the other.
Both properties are checked on the model when it is loaded, and another model is refused.

1. ``chunks``: neighbouring documents form a chunk. It has a dictionary of its distinct pre-tokens, and
   for each document the codes of those it has and how often it has them, packed.
2. ``piece_counts``: the dictionaries go to shards by a hash of the pre-token. A shard meets all chunks'
   entries of a pre-token, counts its pieces once, and answers each chunk with numbers in its order.
3. ``token_counts``: the answers are joined to the chunks, and frequency times pieces is summed by
   document with ``np.add.reduceat``. No ids of a document are ever made.

A pre-token leaves a chunk once, however many documents have it, so the most frequent ones are no hot
keys: they have an entry a chunk. Memory is bounded by the sizes of a chunk and of a shard: there are as
many shards as all entries fill by ``SHARD``, so a shard's distinct pre-tokens are about that at most.
Texts are read by stretches; a document's stretches may be in several chunks and are added up.

Defined results: a null or empty text has no tokens. Rows are told apart by a number of their own, so
repeated rows, equal and null ids each give their own row. A text without a blank or line end is one
pre-token, however long, which a task has to hold. An empty table gives an empty table. Columns other
than id and text, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import bounded_batches, shuffle_width, stored

#: Limits of a chunk: entries of documents, distinct pre-tokens, and their code points.
ENTRIES, DISTINCT, POINTS = 1 << 22, 1 << 19, 1 << 25
#: Code points of a text that are cut at a time; entries of the chunks' dictionaries in a shard.
STRETCH, SHARD = 1 << 20, 1 << 19
LIMIT = 4096
MARK, BREAK = "▁", "\n"
_CUT, _PRE_TOKEN = re.compile(f"(?<!{MARK}){MARK}|{BREAK}"), re.compile(f"(?:{MARK}+|{BREAK})[^{MARK}{BREAK}]*")
#: Pre-tokens one after the other, a line end before each, as they are sent.
_SENT = re.compile(f"{BREAK}((?:{MARK}+|{BREAK})[^{MARK}{BREAK}]*)")


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text with its mark in front, cut where pre-tokens begin."""
    text, at = text and MARK + text.replace(" ", MARK), 0
    while at < len(text):
        cut = _CUT.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def pre_tokens(text: str) -> list[str]:
    return [t for part in stretches(text) for t in _PRE_TOKEN.findall(part)]


class Pieces:
    """How many pieces a pre-token has."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) or BREAK in p for p in pieces) or self.count([MARK, "a"]) != [1, 1]:
            raise ValueError("the model's pieces cross blanks or line ends")

    def count(self, some: list[str]) -> list[int]:
        """Behind a line end a pre-token is encoded as anywhere; it and the mark in front are two more."""
        return [len(x) - 2 for x in self.model.encode([BREAK + t for t in some], num_threads=1)]


_LOADED: dict[str, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model of a worker process, built once."""
    key = sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Chunk:
    """Documents, or stretches of one, by codes of a dictionary."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.rows, self.sizes, self.of, self.n = [], [], [], []
        self.entries = self.points = 0

    def add(self, row: tuple, counted: Counter) -> None:
        known = self.codes
        before = len(known)
        self.of.append(np.fromiter((known.setdefault(t, len(known)) for t in counted), dtype=np.int64, count=len(counted)))
        self.n.append(np.fromiter(counted.values(), dtype=np.uint32, count=len(counted)))
        self.points += sum(map(len, islice(reversed(known), len(known) - before)))
        self.entries += len(counted)
        self.rows.append(row)
        self.sizes.append(len(counted))

    def full(self) -> bool:
        return self.entries >= ENTRIES or len(self.codes) >= DISTINCT or self.points >= POINTS or len(self.rows) >= ENTRIES

    def record(self) -> pa.RecordBatch:
        """The dictionary in the order of the hash, and codes by their steps in ascending order."""
        tokens = list(self.codes)
        hashes = _hashes(tokens)
        order = np.lexsort((np.arange(len(tokens)), hashes))
        place = np.empty(len(tokens), dtype=np.int64)
        place[order] = np.arange(len(tokens))
        of = place[np.concatenate(self.of)] if self.entries else np.zeros(0, dtype=np.int64)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        ascending = np.lexsort((of, doc))
        of, starts = of[ascending], np.cumsum([0, *self.sizes])[:-1]
        steps = np.diff(of, prepend=0)
        first = starts[np.asarray(self.sizes) > 0]
        steps[first] = of[first]
        n = np.concatenate(self.n)[ascending] if self.entries else np.zeros(0, dtype=np.uint32)
        rows, ids, n_bytes = zip(*self.rows, strict=True)
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (rows, ids, n_bytes, starts.tolist())]
        numbers = [pa.array([packed(x)], pa.binary()) for x in (steps, n)]
        named = pa.array([[tokens[i] for i in order.tolist()]], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([*lists, *numbers, named], names=["rows", "ids", "n_bytes", "starts", "steps", "n", "tokens"])


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed: all their lowest bytes, then all second ones, and so on."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(t.encode()) for t in tokens), dtype=np.int64, count=len(tokens))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """``(chunk, rows, ids, n_bytes, starts, steps, n, tokens)``: written, so that the numbers of rows and
    chunks are the same for all later readers."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches):
        chunk = _Chunk()
        for batch in batches:
            for row, key, size, text in zip(*batch.columns, strict=True):
                named = row.as_py(), key.as_py(), size.as_py()
                for part in stretches(text.as_py(), stretch) if named[2] else [""]:
                    chunk.add(named, Counter(_PRE_TOKEN.findall(part)))
                    named = (*named[:2], 0)  # the bytes are those of the whole text
                    if chunk.full():
                        yield chunk.record()
                        chunk = _Chunk()
        if chunk.rows:
            yield chunk.record()

    schema = "rows array<long>, ids array<long>, n_bytes array<long>, starts array<long>, steps binary, n binary, tokens array<string>"
    return stored(numbered.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("chunk"), "*"), "zstd")


def piece_counts(table: DataFrame, path: str | None = None, shard: int = SHARD) -> DataFrame:
    """``(chunk, shard, pieces)``: the numbers of pieces of a chunk's pre-tokens, by ranges of their hash."""
    spark = table.sparkSession
    with open(path or default_path(), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary file, half a MB
    width = shuffle_width(spark)
    entries = table.agg(F.sum(F.size("tokens"))).first()[0] or 0
    shards = max(2 * width, -(-entries // shard))

    def dealt(batches):
        for batch in batches:
            for chunk, tokens in zip(*batch.columns, strict=True):
                some = tokens.as_py()
                of = _hashes(some) * shards >> 32
                cut = np.flatnonzero(np.diff(of, prepend=-1))
                lists = [zlib.compress("".join(BREAK + t for t in some[i:j]).encode(), 1) for i, j in pairwise([*cut.tolist(), len(some)])]
                yield pa.RecordBatch.from_arrays([pa.array(of[cut], pa.int64()), pa.array([chunk.as_py()] * len(cut), pa.int64()), pa.array(lists, pa.binary())], names=["shard", "chunk", "tokens"])

    def counted(batches):
        counter, now, known = loaded(model.value), None, {}
        for batch in batches:
            out = []
            for shard, tokens in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if shard != now:
                    now, known = shard, {}
                some = _SENT.findall(zlib.decompress(tokens.as_py()).decode())
                new = [t for t in some if t not in known]
                known.update(zip(new, counter.count(new), strict=True))
                out.append(np.fromiter(map(known.__getitem__, some), dtype="<u4", count=len(some)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.binary())], names=["chunk", "shard", "pieces"])

    lists = table.where(F.size("tokens") > 0).select("chunk", "tokens").mapInArrow(dealt, "shard long, chunk long, tokens binary")
    return lists.repartition(width, "shard").sortWithinPartitions("shard").mapInArrow(counted, "chunk long, shard long, pieces binary")


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH, shard: int = SHARD) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)``, a row for each document."""
    table = chunks(docs, id_col, text_col, stretch)
    # a chunk has no more answers than pre-tokens
    answers = piece_counts(table, path, shard).groupBy("chunk").agg(F.collect_list(F.struct("shard", "pieces")).alias("answers"))

    def summed(batches):
        for batch in batches:
            for rows, ids, n_bytes, starts, steps, n, answers in zip(*batch.columns, strict=True):
                at = np.asarray(starts.values)
                walk = np.cumsum(unpacked(steps.as_py()), dtype=np.int64)
                size = np.diff(at, append=len(walk))
                some = size > 0
                codes = walk - np.repeat(np.concatenate([[0], walk])[at], size)
                pieces = b"".join(a["pieces"] for a in sorted(answers.as_py() or (), key=lambda a: a["shard"]))
                product = np.frombuffer(pieces, dtype="<u4").astype(np.int64)[codes] * unpacked(n.as_py())
                tokens = np.zeros(len(at), dtype=np.int64)
                if some.any():
                    tokens[some] = np.add.reduceat(product, at[some])
                yield pa.RecordBatch.from_arrays([rows.values, ids.values, n_bytes.values, pa.array(tokens)], names=["row", "doc_id", "n_bytes", "n_tokens"])

    both = table.join(answers, "chunk", "left").select("rows", "ids", "n_bytes", "starts", "steps", "n", "answers")
    parts = both.mapInArrow(summed, "row long, doc_id long, n_bytes long, n_tokens long")
    whole = parts.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return whole.drop("row")


def op12(docs: DataFrame) -> DataFrame:
    return token_counts(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
