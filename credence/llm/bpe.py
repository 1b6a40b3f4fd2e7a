"""BPE encoding and decoding with a priority queue over a linked symbol list.

The tokenizer is read from a vocabulary file of the ``tokenizers`` library's JSON form whose path is
a parameter. Texts are normalised (NFC, white space to one space, lower case), cut into pieces by the
file's own split rule, mapped to byte symbols, and merged: a heap holds (merge rank, position) of
adjacent pairs, positions form a doubly linked list, and entries whose pair has changed since are
skipped as stale. Decoding concatenates vocabulary strings, a space between tokens, which is what the
library does for a file without a decoder.

Pieces repeat, so each worker remembers the result of a piece, in a table of bounded size.

Defined results: a null text counts as empty and has no tokens. Strings of the special tokens in a
text become those tokens. Rows are independent, so repeated rows, ties and null ids pass through.
Columns other than id and text, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import bounded_batches, map_rows

#: Entries of one generation of a worker's remembered pieces and runs without white space.
REMEMBER = 200_000


def byte_symbols() -> dict[int, str]:
    """The byte-to-character table of byte-level BPE: printable bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    """A table of bounded size that keeps what is in use: when it is full, it becomes the old
    generation, from which entries that are asked for again are taken over."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size, self.old = size, {}

    def recall(self, key: str) -> bytes | None:
        """The value of a key that is not among the young ones."""
        got = self.old.get(key)
        if got is not None:
            self.keep(key, got)
        return got

    def keep(self, key: str, value: bytes) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, source: str) -> None:
        import regex

        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # a pair of token ids is one number; its rank and the merged token's id by that number
        self.width = max(self.vocab.values()) + 1
        self.ranks = {self.vocab[a] * self.width + self.vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        names = byte_symbols()
        self.inner = [self.vocab[names[b]] for b in range(256)]
        self.final = [self.vocab[names[b] + self.suffix] for b in range(256)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.known = Remembered(REMEMBER)

    def merge(self, piece: str) -> list[int]:
        """Token ids of one piece.

        Heap entries are numbers, rank times the next power of two above the length plus position.
        """
        data = piece.encode()
        ids = [self.inner[b] for b in data]
        n = len(ids)
        if not n:
            return ids
        ids[-1] = self.final[data[-1]]
        ranks, merged, width = self.ranks, self.merged, self.width
        shift = n.bit_length()
        low = (1 << shift) - 1
        heap = [r << shift | i for i in range(n - 1) if (r := ranks.get(ids[i] * width + ids[i + 1])) is not None]
        if not heap:
            return ids
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while heap:
            top = heapq.heappop(heap)
            i = top & low
            j = after[i]
            if j < 0 or ids[i] < 0 or ranks.get(ids[i] * width + ids[j]) != top >> shift:
                continue  # stale: one side was merged meanwhile
            new = ids[i] = merged[top >> shift]
            ids[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (s := ranks.get(new * width + ids[k])) is not None:
                    heapq.heappush(heap, s << shift | i)
            p = before[i]
            if p >= 0 and (s := ranks.get(ids[p] * width + new)) is not None:
                heapq.heappush(heap, s << shift | p)
        return [x for x in ids if x >= 0]

    def packed_run(self, run: str, whole: bool = False) -> bytes:
        """Token ids, as little-endian unsigned 32-bit integers, of a run without white space that is
        not among the young remembered ones; ``whole`` tells that it is one piece.

        A piece by itself is cut into that piece alone, so runs and pieces share one table.
        """
        known = self.known
        got = known.recall(run)
        if got is None:
            if whole or run.isalpha():
                got = array("I", self.merge(run)).tobytes()
            else:
                got = b"".join([known.get(x) or self.packed_run(x, True) for x in self.piece.findall(run)])
            if len(run) <= 64:
                known.keep(run, got)
        return got

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character in lower case by itself (no final-sigma rule)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def packed(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.marks.split(text) if self.marks and "<|" in text else [text]):
            if k % 2:
                out.append(struct.pack("<I", self.special[part]))
                continue
            part = self.normal(part)
            # str.split() also splits at \x1c to \x1f, which are not white space here
            runs = part.split() if not any(c in part for c in "\x1c\x1d\x1e\x1f") else [part]
            young, other = self.known.get, self.packed_run
            out += [young(x) or other(x) for x in runs]
        return b"".join(out)

    def encode_packed(self, text: str) -> tuple[bytes, str]:
        data = self.packed(text)
        return data, self.decode(np.frombuffer(data, dtype="<u4").tolist())

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def loaded(source: str) -> WordBpe:
    """The tokenizer of a worker process, built once."""
    key = sha256(source.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(source)
    return _LOADED[key]


def read_vocabulary(path: str) -> str:
    """The file's text. The driver reads it and ships it with the function (about 2 MB, a fixed size
    whatever the corpus), so executors need no such file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: token count, token ids and the decoded text.

    Ids go from packed bytes to Arrow without a Python number for each.
    """
    bounded_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path or default_path()))
    names = ["doc_id", "n_tokens", "token_ids", "decoded"]

    def run(batches):
        t = loaded(source.value)
        for batch in batches:
            got = [t.encode_packed(x.as_py() or "") for x in batch.column(1)]
            sizes = np.fromiter((len(data) // 4 for data, _ in got), dtype=np.int32, count=len(got))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = np.frombuffer(b"".join(data for data, _ in got), dtype="<i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), lists, pa.array([d for _, d in got], pa.string())], names=names)

    out = "doc_id long, n_tokens long, token_ids array<int>, decoded string"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, out)


def digest_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: token count and digests of the ids and of the decoded text."""
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path or default_path()))

    def rows(ids, texts):
        t = loaded(source.value)
        out = []
        for key, text in zip(ids, texts, strict=True):
            data, decoded = t.encode_packed(text or "")
            out.append((key, len(data) // 4, sha256(data).hexdigest(), sha256(decoded.encode()).hexdigest()))
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs, [id_col, text_col], schema, rows)
