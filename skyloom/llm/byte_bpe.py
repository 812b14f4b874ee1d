"""Byte-level BPE in linear time: longest matches, backtracking, and memoised compatibility of neighbouring tokens."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Bytes of pieces remembered in a Python worker, and pairs of neighbouring tokens. What was used lately stays.
MEMO_BYTES, MEMO_PAIRS = 40 << 20, 1 << 17
#: Longest piece that is remembered, and what an entry takes besides its characters and ids.
MEMO_PIECE, ENTRY_BYTES = 64, 200


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition of BPE, in quadratic time: merge the lowest-ranked neighbours, leftmost first. For short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class ByteBPE:
    """A tokenizer of one worker. Tables are indexed by rank; memos are bounded, whatever the texts."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        size = max(self.ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.length = array("i", map(len, self.bytes_of))
        self.decimal = list(map(str, range(size)))
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        # By rank, -2: not looked up yet, -1: none. A token's longest shorter prefix, and the two whose merge makes it.
        self.shorter, self.left, self.right = (array("i", [-2]) * size for _ in range(3))
        self.compatible: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.held = 0

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if self.shorter[token] == -2:
            data = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
        return self.shorter[token]

    def _left_half(self, token: int) -> int:
        """The left one of the two tokens whose merge makes this one, or -1 for a single byte."""
        if self.left[token] == -2:
            data = self.bytes_of[token]
            inner = {data[i : i + n] for n in range(2, len(data)) for i in range(len(data) - n + 1)}
            parts = merged_by_rank(data, {k: self.ranks[k] for k in inner if k in self.ranks})
            self.left[token], self.right[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self.left[token]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joined bytes gives these two tokens again (memoised).

        Undoes merges next to the seam, latest first. A merge across the seam that ranks before the one just
        undone would have come first; of equal ranks the left one does.
        """
        pair = left * len(self.bytes_of) + right
        known = self.compatible.get(pair)
        if known is not None:
            return known
        before, known = 1 << 60, None
        while known is None:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            left_made, right_made = self._left_half(left) >= 0, self._left_half(right) >= 0
            if across is not None and across < before:
                known = False
            elif left_made and (left > right or not right_made):
                before, left = left, self.right[left]
            elif right_made:
                before, right = right + 1, self.left[right]
            else:
                known = True
        if len(self.compatible) >= MEMO_PAIRS:
            self.compatible.clear()
        self.compatible[pair] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The exact merges of one pattern match. A token sequence is BPE's own when all its neighbours are compatible."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        length = self.length
        longest = [-1] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # a later end is a longer match
        open_ends = bytearray(b"\x01") * (len(piece) + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            while token >= 0:
                end = at + length[token]
                if open_ends[end] and (not tokens or self._compatible(tokens[-1], token)):
                    break
                token = self._shorter(token)
            if token >= 0:
                tokens.append(token)
                at = end
                token = longest[at] if at < len(piece) else -1
            elif tokens:  # nothing can follow here: give the place up and try a shorter last token
                open_ends[at] = 0
                token = tokens.pop()
                at -= length[token]
            else:
                raise ValueError("the vocabulary does not cover every byte")
        return tokens

    def _piece(self, piece: str) -> bytes:
        """The ids of one pattern match as 32-bit integers, from the memo's older half or made anew."""
        known = self.old_pieces.get(piece)
        if known is None:
            known = array("i", self.encode_piece(piece.encode())).tobytes()
        if len(piece) <= MEMO_PIECE:
            self.held += ENTRY_BYTES + len(piece) + len(known)
            if self.held > MEMO_BYTES // 2:
                self.old_pieces, self.pieces, self.held = self.pieces, {}, 0
            self.pieces[piece] = known
        return known

    def encode(self, text: str) -> bytes:
        """The ids of the text as 32-bit integers."""
        known = self.pieces.get
        return b"".join([known(piece) or self._piece(piece) for piece in self.pattern.findall(text)])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode_and_decode(self, text: str) -> tuple[bytes, bytes]:
        """encode(text), and the bytes decoded from these ids."""
        ids = self.encode(text)
        return ids, self.decode(memoryview(ids).cast("i"))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the bytes decoded from the ids."""
        ids = memoryview(self.encode(text)).cast("i")
        decimal = ",".join(map(self.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One tokenizer per Python worker; workers are reused between tasks."""
    return ByteBPE(path, pattern)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Every text is encoded whole and decoded again from its ids. Null text counts as empty: no tokens, the digests
    of nothing. Ids may be null or repeat. path must exist on every machine. Other columns of docs are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in slices(batches):
            rows = [bpe.digest(text or "") for text in batch.column(1).to_pylist()]
            n, ids, data = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data,
                pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode,
        f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _id_lists(data: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in data)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(data))]))


def encode_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; the ids themselves, for packing. Null text gives an empty array."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _id_lists([bpe.encode(text or "") for text in batch.column(1).to_pylist()])], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, lossless): lossless says that the bytes decoded from the ids are those of the text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in slices(batches):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            found = [bpe.encode_and_decode(text) for text in texts]
            ids = _id_lists([ids for ids, _ in found])
            lossless = [data == text.encode() for (_, data), text in zip(found, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.list_value_length(ids).cast(pa.int64()), ids, pa.array(lossless,
                pa.bool_())], ["doc_id", "n_tokens", "ids", "lossless"])

    small_batches(docs.sparkSession)
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode,
        f"doc_id {kind}, n_tokens long, ids array<int>, lossless boolean")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary): the bytes of an encode_ids table. A null array gives null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if ids is None else bpe.decode(ids)
                for ids in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    small_batches(encoded.sparkSession)
    kind = encoded.select("doc_id").dtypes[0][1]
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, data binary")
