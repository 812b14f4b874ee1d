"""Greedy word-piece lengths by a longest-match automaton: a trie with failure links and counts of popped tokens."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: What a piece file writes before a piece that begins a word.
WORD_START = "▁"
#: Words whose counts a Python worker remembers; the memo is emptied when full.
MEMO_WORDS = 1 << 17


class LongestMatch:
    """Counts the pieces that greedy longest-match splits a word into, in one pass over its characters.

    Node 0 begins a word, node 1 continues one. The failure link of a node leads to where matching goes on when no
    child fits, after the tokens that the longest matches of the node's string pop; only their number is stored.
    """

    def __init__(self, first_pieces: Iterable[str], later_pieces: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]
        ends: set[int] = set()
        for root, pieces in enumerate((first_pieces, later_pieces)):
            for piece in pieces:
                if piece:
                    node = root
                    for c in piece:
                        if c not in self.children[node]:
                            self.children[node][c] = len(self.children)
                            self.children.append({})
                        node = self.children[node][c]
                    ends.add(node)
        self.failure: list[int] = [-1] * len(self.children)
        self.popped: list[int] = [0] * len(self.children)
        waiting = deque((0, 1))
        while waiting:
            node = waiting.popleft()
            for c, child in self.children[node].items():
                if child in ends:
                    self.failure[child], self.popped[child] = 1, 1
                else:
                    link, popped = self.failure[node], self.popped[node]
                    while link >= 0 and c not in self.children[link]:
                        popped += self.popped[link]
                        link = self.failure[link]
                    if link >= 0:
                        self.failure[child], self.popped[child] = self.children[link][c], popped
                waiting.append(child)

    def count(self, word: str) -> int:
        """Pieces of the word; 0 if no split covers it (then it is one unknown token)."""
        children, failure, popped = self.children, self.failure, self.popped
        node, n = 0, 0
        for c in word:
            while c not in children[node]:
                n += popped[node]
                node = failure[node]
                if node < 0:
                    return 0
            node = children[node][c]
        while node > 1:
            n += popped[node]
            node = failure[node]
        return n if node == 1 else 0


class _Counts(dict):
    """Pieces by word; a word that no split covers is -1."""

    def __init__(self, automaton: LongestMatch, begin: str):
        super().__init__()
        self.automaton, self.begin = automaton, begin

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        n = self.automaton.count(self.begin + word.decode("utf-8", "replace")) or -1
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _counts(first: tuple[str, ...], later: tuple[str, ...], begin: str) -> _Counts:
    """One automaton and memo per Python worker; workers are reused between tasks."""
    return _Counts(LongestMatch(first, later), begin)


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, with their mark; pieces that continue one), without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p for p in pieces if p.startswith(WORD_START)], [p for p in pieces if not p.startswith(WORD_START)]


def token_counts(docs: DataFrame, pieces: tuple[list[str], list[str]], begin: str = WORD_START, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens, n_unknown.

    Words stand between ASCII white space and are matched with `begin` before them. n_tokens counts the pieces of the
    greedy longest-match split of every word of the whole text; a word that has none counts as one unknown token, also
    in n_tokens. Null and empty texts have no words. Bytes that are no UTF-8 count as U+FFFD, which vocabularies don't
    hold. Ids may be null or repeat. An empty table gives an empty result. Other columns of docs are not read.
    pieces is broadcast: the vocabulary, whose size does not depend on the corpus.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((*map(tuple, pieces), begin))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counts(*shared.value)
        for batch in slices(batches):
            words, tokens, unknown = [], [], []
            for text in batch.column(1).to_pylist():
                counts = list(map(known.__getitem__, (text or b"").split()))  # bytes split at ASCII white space only
                missed = counts.count(-1)
                words.append(len(counts))
                tokens.append(sum(counts) + 2 * missed)
                unknown.append(missed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown,
                pa.int64())], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return rows.mapInArrow(count, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_tokens long, n_unknown long")
