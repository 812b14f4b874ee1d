"""Toxic spans by a linear-chain conditional random field; forward-backward marginals add up to document scores."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, small_batches, written
from .language_id import held_out

TOKEN = re.compile(r"\w+")
#: Most labelled documents of either label that the model is fitted on, chosen by a hash of their ids.
FIT_ROWS = 4_096
#: Most sequences with, and without, a word labelled toxic among those that the random field is fitted on, chosen by hash.
FIT_SEQUENCES = 8_192
#: Words in a sequence: the chain is cut there, while features still look at the neighbours beyond.
CHAIN = 32
#: Hashed features of words, so many of each word at most; words that a worker remembers.
BUCKETS = 1 << 19
PREFIXES = range(3, 9)
FEATURES = len(PREFIXES) + 3
MEMO_WORDS = 400_000
#: A feature marks toxic words when its likelihood ratio exceeds twice the log of the features looked at by EVIDENCE, and it is TIMES
#: times as frequent in toxic documents.
EVIDENCE, TIMES = 8.0, 20.0
#: Passes of the fit over its sequences, its step, the weight of its ridge, and the share of features that a pass leaves out, so that
#: prefixes learn to stand for words that were never seen.
EPOCHS, RATE, RIDGE, LEFT_OUT = 40, 0.5, 0.05, 0.6
#: Sequences that the fit looks at in one go.
FIT_BLOCK = 1_024
#: Weights of documents are counted in such parts, so that sums are exact.
PARTS = 1 << 20


_DIGIT = re.compile(r"\d")


def features_of(word: str) -> list[int]:
    """Buckets of a word: itself and its prefixes (lower case, by their UTF-8 bytes), which may mark toxic words, then its ending and shape."""
    low = word.lower().encode()
    out = [zlib.crc32(low, 1) % BUCKETS]
    for n in PREFIXES:
        if n >= len(low):
            break
        out.append(zlib.crc32(low[:n], 2) % BUCKETS)
    out.append(zlib.crc32(low[-3:], 3) % BUCKETS)
    out.append((2 * word.isupper() + (_DIGIT.search(word) is not None)) % BUCKETS)
    return out


def marking(features: list[int]) -> list[int]:
    return features[:-2]


def features_table(words: list[str]) -> np.ndarray:
    """Features of words in rows, filled up with BUCKETS, which stands for nothing."""
    out = np.full((len(words), FEATURES), BUCKETS, np.int32)
    for i, w in enumerate(words):
        own = features_of(w)
        out[i, : len(own)] = own
    return out


class Words:
    """Numbers words as they come and keeps what know() says of each in a row of a table; starts anew beyond MEMO_WORDS."""

    def __init__(self, know: Callable[[list[str]], np.ndarray], width: int):
        self.know, self.width = know, width
        self._anew()

    def _anew(self) -> None:
        self.numbers: dict[str, int] = {}
        self.table = np.empty((1 << 14, self.width))

    def of(self, words: list[str]) -> np.ndarray:
        """The rows of the words."""
        if len(self.numbers) > MEMO_WORDS:
            self._anew()
        numbers, known = self.numbers, len(self.numbers)
        out = [numbers.setdefault(w, len(numbers)) for w in words]
        if len(numbers) > known:
            new = list(islice(reversed(numbers), len(numbers) - known))[::-1]
            if len(numbers) > len(self.table):
                self.table = np.concatenate([self.table, np.empty((max(len(self.table), len(numbers) - known), self.width))])
            self.table[known : len(numbers)] = self.know(new)
        return self.table[np.array(out, np.int64)]


#: The words that this worker remembers, by the model that knows them.
_REMEMBERED: dict[str, Words] = {}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def messages(e: np.ndarray, real: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of chains in rows, from the emissions of toxic against other; what isn't real pads a chain's end.

    With two labels a message is one number at each word: the log-odds of toxic by what lies up to it, and after it.
    turns[a, b] scores label b after label a, 1 being toxic.
    """
    (oo, ot), (to, tt) = turns
    forward, backward = np.empty_like(e), np.zeros_like(e)
    forward[:, 0] = e[:, 0]
    for t in range(1, e.shape[1]):
        x = forward[:, t - 1]
        forward[:, t] = e[:, t] + np.logaddexp(ot, tt + x) - np.logaddexp(oo, to + x)
    for t in range(e.shape[1] - 2, -1, -1):
        x = e[:, t + 1] + backward[:, t + 1]
        backward[:, t] = np.where(real[:, t + 1], np.logaddexp(to, tt + x) - np.logaddexp(oo, ot + x), 0.0)
    return forward, backward


def expected_turns(forward: np.ndarray, backward: np.ndarray, e: np.ndarray, real: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """How often each turn is expected in all chains."""
    x, y = forward[:, :-1], e[:, 1:] + backward[:, 1:]
    joint = np.stack([np.full_like(x, turns[0, 0]), turns[0, 1] + y, turns[1, 0] + x, turns[1, 1] + x + y])
    joint = np.exp(joint - joint.max(axis=0))
    return (joint / joint.sum(axis=0) * real[:, 1:]).sum(axis=(1, 2)).reshape(2, 2)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of toxic against other: three rows, of a word's own features, of the word's before and of the word's after.

    `scale` makes a document's totals the log-odds of its label.
    """

    weights: np.ndarray
    bias: float
    turns: np.ndarray
    scale: np.ndarray

    def know(self, words: list[str]) -> np.ndarray:
        """Of each word the sums of its features' weights, in the three rows."""
        at = features_table(words)
        found = self.weights[:, np.minimum(at, BUCKETS - 1)] * (at < BUCKETS)
        return found.sum(axis=2, dtype=np.float64).T

    def words(self, name: str) -> Words:
        """This worker's memory of words; that of another model is forgotten."""
        if name not in _REMEMBERED:
            _REMEMBERED.clear()
            _REMEMBERED[name] = Words(self.know, 3)
        return _REMEMBERED[name]

    def marginals(self, texts: list[list[str]], words: Words) -> list[np.ndarray]:
        """Probability of toxic at each word of each text."""
        n = np.array([len(t) for t in texts], np.int64)
        ends = n.cumsum()
        known = words.of([w for t in texts for w in t])
        e = known[:, 0] + self.bias
        same = np.ones(len(e), bool)  # as the word before
        same[(ends - n)[n > 0]] = False
        e[1:] += np.where(same[1:], known[:-1, 1], 0)
        e[:-1] += np.where(same[1:], known[1:, 2], 0)
        rows = -(-n // CHAIN)
        at = np.arange(len(e)) + np.repeat((rows.cumsum() - rows) * CHAIN - (ends - n), n)
        padded, real = np.zeros(rows.sum() * CHAIN), np.zeros(rows.sum() * CHAIN, bool)
        padded[at], real[at] = e, True
        forward, backward = messages(padded.reshape(-1, CHAIN), real.reshape(-1, CHAIN), self.turns)
        return np.split(_sigmoid(forward + backward).ravel()[at], ends[:-1]) if len(texts) else []

    @staticmethod
    def totals(m: np.ndarray) -> list[float]:
        """What the marginals of a document come to: 1, log of the toxic words (squares let faint ones fade), the largest, log of all words."""
        return [1.0, float(np.log1p((m * m).sum())), float(m.max(initial=0.0)), float(np.log1p(len(m)))]

    def score(self, m: np.ndarray) -> float:
        return float(_sigmoid(np.dot(self.totals(m), self.scale)))


def fit_chain(sequences: list[tuple[list[str], list[int]]]) -> ToxicityModel:
    """Conditional likelihood of labelled sequences of up to CHAIN words, climbed by Adagrad, with a ridge; without any, nothing is toxic."""
    width = FEATURES
    words = Words(features_table, width)
    at = np.full((len(sequences), CHAIN, width), BUCKETS, np.int32)  # that bucket is nothing's
    y, real = np.zeros(at.shape[:2]), np.zeros(at.shape[:2], bool)
    for i, (own, labels) in enumerate(sequences):
        at[i, : len(own)], y[i, : len(own)], real[i, : len(own)] = words.of(own), labels, True
    a, b = y[:, :-1].astype(int), y[:, 1:].astype(int)
    seen = np.bincount((2 * a + b)[real[:, 1:]], minlength=4).reshape(2, 2)
    counted = np.bincount(at.ravel(), minlength=BUCKETS + 1)
    counted[BUCKETS] += 1
    used = np.flatnonzero(counted)
    place = np.zeros(BUCKETS + 1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    all_features = place[at]
    del at
    rng = np.random.default_rng(0)
    weights, bias, turns = np.zeros((3, len(used))), np.full(1, -3.0), np.zeros((2, 2))
    known, squares = used < BUCKETS, [np.ones_like(weights), np.ones(1), np.ones((2, 2))]
    for _ in range(EPOCHS if len(sequences) else 0):
        slopes, excess, expected = np.zeros_like(weights), 0.0, np.zeros((2, 2))
        for lo in range(0, len(y), FIT_BLOCK):
            part = slice(lo, lo + FIT_BLOCK)
            at, own_real = all_features[part], real[part]
            at = np.where(rng.random(at.shape, np.float32) < LEFT_OUT, np.int32(len(used) - 1), at)
            own, before, after = (w[at].sum(axis=2) for w in weights)
            e = own + bias
            e[:, 1:] += before[:, :-1]
            e[:, :-1] += after[:, 1:]
            e *= own_real
            forward, backward = messages(e, own_real, turns)
            residual = (y[part] - _sigmoid(forward + backward)) * own_real
            none = np.zeros((len(residual), 1))
            for k, r in enumerate((residual, np.hstack([residual[:, 1:], none]), np.hstack([none, residual[:, :-1]]))):
                slopes[k] += np.bincount(at.ravel(), np.repeat(r.ravel(), width), len(used)) * known
            excess += residual.sum()
            expected += expected_turns(forward, backward, e, own_real, turns)
        moves = [slopes - RIDGE * weights, np.array([excess]), seen - expected - RIDGE * turns]
        for value, square, move in zip((weights, bias, turns), squares, moves, strict=True):
            square += move * move
            value += RATE * move / np.sqrt(square)
    full = np.zeros((3, BUCKETS), np.float32)
    full[:, used[known]] = weights[:, known]
    return ToxicityModel(full, float(bias[0]), turns, np.zeros(4))


def fit_scale(totals: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of totals by ridged logistic regression, by Newton's steps; a document's weight says for how many it stands."""
    scale = np.zeros(totals.shape[1])
    ridge = np.diag([1e-6, *[0.1] * (totals.shape[1] - 1)])
    for _ in range(50):
        p = _sigmoid(totals @ scale)
        slope = totals.T @ (weight * (toxic - p)) - ridge @ scale
        bend = (totals * (weight * p * (1 - p) + 1e-9)[:, None]).T @ totals + ridge
        step = np.linalg.solve(bend, slope)
        scale = scale + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return scale


def signature(tokens: list[str]) -> int:
    """The least hash of three words on end: copies and near copies of a text mostly share it."""
    h = np.array([zlib.crc32(t.lower().encode()) for t in tokens] or [0], np.uint64)
    runs = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9) if len(h) > 2 else h
    return int((runs ^ (runs >> np.uint64(29))).min() >> np.uint64(1))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS,
        fit_sequences: int = FIT_SEQUENCES) -> ToxicityModel:
    """A model of the labels in `labels` (doc_id, toxic) that held_out() leaves; of the documents only the texts are read.

    Labels are for documents; words get theirs by evidence: in toxic documents those with a feature (the word, or a
    prefix of 3 to 8 letters) that marks toxicity, by its counts in toxic and other documents, where documents that share
    a signature, as copies do, count as one. The field is fitted on sequences labelled so, and the document score on
    the totals of its marginals. A bounded sample takes part: fit_rows documents of each label and fit_sequences
    sequences of either kind, so the driver holds that much, and counts of BUCKETS features. An id labelled twice is
    toxic if any label says so; of rows with one id the smallest text counts; null ids, labels and texts teach nothing.
    Without documents of both labels all scores are the share of toxic ones, 0 if there are none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    said = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    all_of = dict(said.groupBy("toxic").count().collect())
    if len(all_of) < 2:
        share = 1 - 1e-6 if all_of.get(1) else 0.0
        return ToxicityModel(np.zeros((3, BUCKETS), np.float32), -35.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)) if share else -35.0, 0, 0, 0]))
    chosen = [said.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for c in (0, 1)]
    chosen = chosen[0].union(chosen[1]).withColumnRenamed("doc_id", "chosen_id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    rows = rows.join(F.broadcast(chosen), F.col("id") == F.col("chosen_id")).groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = written(rows.select("text", "toxic"), "sample")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([signature(TOKEN.findall(t)) for t in batch.column(0).to_pylist()], pa.int64()), batch.column(1)],
                ["signature", "toxic"])

    alike = {(r.signature, r.toxic): r["count"] for r in sample.mapInArrow(signed, "signature long, toxic int").groupBy("signature", "toxic").count().collect()}
    alike = spark.sparkContext.broadcast(alike)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        memo: dict[str, list[int]] = {}
        for batch in slices(batches):
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = TOKEN.findall(text)
                found: set[int] = set()
                for w in set(tokens):
                    own = memo.get(w)
                    if own is None:
                        own = memo[w] = marking(features_of(w))
                    found.update(own)
                counts[toxic, np.fromiter(found, np.int64, len(found))] += PARTS // alike.value[signature(tokens), toxic]
                if len(memo) > MEMO_WORDS:
                    memo.clear()
        at = counts.any(axis=0).nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "others", "toxic"])

    table = sample.mapInArrow(counted, "bucket int, others long, toxic long").groupBy("bucket").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic"))
    table = table.toPandas()  # BUCKETS rows at most
    documents = [sum(c == label for _, c in alike.value) for label in (0, 1)]
    marks = spark.sparkContext.broadcast(frozenset(_marking_buckets(table.bucket.to_numpy(), table.others.to_numpy() / PARTS, table.toxic.to_numpy() / PARTS,
        *documents).tolist()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = TOKEN.findall(text)
                found = [int(toxic and not marks.value.isdisjoint(marking(features_of(w)))) for w in tokens]
                if toxic and not any(found):
                    continue  # nobody knows which of its words are toxic
                out += [(any(found[i : i + CHAIN]), tokens[i : i + CHAIN], found[i : i + CHAIN]) for i in range(0, len(tokens), CHAIN)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.bool_()), pa.array([x[1] for x in out], pa.list_(pa.string())),
                pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["marked", "words", "labels"])

    sequences = written(sample.mapInArrow(cut, "marked boolean, words array<string>, labels array<int>"), "sequences")
    taken = [r for marked in (True, False) for r in sequences.filter(F.col("marked") == marked).orderBy(F.xxhash64("words"), "words").limit(
        fit_sequences).collect()]
    model = fit_chain([(r.words, r.labels) for r in taken])
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.words(name)
        for batch in slices(batches):
            texts = [TOKEN.findall(t) for t in batch.column(0).to_pylist()]
            totals = [shared.value.totals(m) for m in shared.value.marginals(texts, words)]
            weight = [1 / alike.value[signature(t), c] for t, c in zip(texts, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(totals, pa.list_(pa.float64())), batch.column(1), pa.array(weight, pa.float64())], ["totals", "toxic", "weight"])

    found = sample.mapInArrow(totalled, "totals array<double>, toxic int, weight double").collect()
    discard(sequences, sample)
    toxic, weight = np.array([r.toxic for r in found]), np.array([r.weight for r in found])
    for label in (0, 1):
        weight[toxic == label] *= all_of[label] / max(1, min(all_of[label], fit_rows))
    return replace(model, scale=fit_scale(np.array([r.totals for r in found]).reshape(-1, 4), toxic, weight))


def _marking_buckets(buckets: np.ndarray, others: np.ndarray, toxic: np.ndarray, all_others: float, all_toxic: float) -> np.ndarray:
    """Those of the features whose counts of documents mark toxic words."""
    share = all_toxic / max(1e-9, all_toxic + all_others)
    n = toxic + others
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (n * share)), 0) + np.where(others > 0, others * np.log(others / (n * (1 - share))), 0))
    often = (toxic + 0.1) * all_others >= TIMES * (others + 0.1) * all_toxic
    return buckets[often & (ratio >= 2 * np.log(max(2, len(buckets))) + EVIDENCE)]


def find_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, predicted (score of at least 0.5), n_words, spans (start and end of offending words, in code points).

    Whole texts are read, and no other column. Null counts as empty; texts without a word have the score of no toxic
    word. Words with a marginal of at least 0.5 offend, neighbours in one span. The model is broadcast: 6 BUCKETS bytes.
    """
    small_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kind = docs.select(F.col(id_col)).dtypes[0][1]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        words = own.words(name)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [TOKEN.findall(t) for t in texts]
            found = own.marginals(tokens, words)
            scores = [own.score(m) for m in found]
            spans = [offending(t, m) for t, m in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([len(t) for t in tokens],
                    pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "score", "predicted", "n_words", "spans"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scored,
        f"doc_id {kind}, score double, predicted int, n_words long, spans array<struct<start:int,end:int>>")


def offending(text: str, m: np.ndarray) -> list[dict[str, int]]:
    """The stretches of words with a marginal of at least 0.5."""
    flagged = m >= 0.5
    if not flagged.any():
        return []
    out: list[dict[str, int]] = []
    for i, word in enumerate(TOKEN.finditer(text)):
        if flagged[i]:
            if i and flagged[i - 1]:
                out[-1]["end"] = word.end()
            else:
                out.append({"start": word.start(), "end": word.end()})
    return out
