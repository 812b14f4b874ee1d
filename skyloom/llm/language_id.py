"""Multilingual mixture inference: EM over the language proportions of a document, from byte n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, small_batches

#: Buckets that byte trigrams are hashed into.
BUCKETS = 1 << 15
#: Pseudo-count of every bucket in every language.
SMOOTHING = 0.5
#: EM stops after so many rounds, or when no proportion moves by more than TOLERANCE.
ROUNDS, TOLERANCE = 25, 1e-3
#: Price of each further language: log-likelihood it must gain, in halves of log(n) as BIC does, times this.
PENALTY = 2.0

#: Most languages of a model; a table with more is refused, as each takes BUCKETS numbers in the driver and every task.
MOST_LANGUAGES = 200

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters counts as space, and all white space as one space.
_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def buckets_of(text: str) -> np.ndarray:
    """Hashed byte trigrams of the whole lower-cased text, words padded by one space, in order."""
    data = b" %b " % b" ".join(text.lower().encode().translate(_TABLE).split())
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    return (((a[:-2] << 16) | (a[1:-1] << 8) | a[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 15)


@dataclass(frozen=True)
class LanguageModel:
    """Rows of `probability` are buckets, columns the sorted languages."""

    languages: tuple[str, ...]
    probability: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, np.ndarray]) -> LanguageModel:
        languages = tuple(sorted(counts))
        table = np.array([counts[x] for x in languages], np.float64).reshape(len(languages), BUCKETS) + SMOOTHING
        return cls(languages, np.ascontiguousarray((table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)))

    def proportions(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """EM estimate of the proportions of the columns of p, given n occurrences of each row; its log-likelihood."""
        theta = np.full(p.shape[1], 1 / p.shape[1])
        total = n.sum()
        mixed = p @ theta
        for _ in range(ROUNDS if p.shape[1] > 1 else 0):
            new = theta * ((n / mixed) @ p) / total
            moved = np.abs(new - theta).max()
            theta = new
            mixed = p @ theta
            if moved < TOLERANCE:
                break
        return theta, float(n @ np.log(mixed))

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """Main language, its proportion in the set that the penalised likelihood selects, and that set's proportions."""
        if not text or not self.languages or not LETTER.search(text):
            return UNDETERMINED, 0.0, {}
        found = buckets_of(text)
        if len(found) < 1024:
            rows, n = np.unique(found, return_counts=True)
        else:
            full = np.bincount(found, minlength=BUCKETS)
            rows = full.nonzero()[0]
            n = full[rows]
        p, n = self.probability[rows].astype(np.float64), n.astype(np.float64)
        all_theta, bound = self.proportions(p, n)
        price = PENALTY * 0.5 * np.log(n.sum() + 1)
        order = np.argsort(-all_theta, kind="stable")
        single = n @ np.log(p)
        best = int(single.argmax())
        chosen, theta, value = [best], np.ones(1), float(single[best])
        while len(chosen) < len(order) and bound - value > price:  # no set gains more than all languages do
            more = [*chosen, next(i for i in order if i not in chosen)]
            new_theta, new_value = self.proportions(p[:, more], n)
            if new_value - value <= price:
                break
            chosen, theta, value = more, new_theta, new_value
        top = int(theta.argmax())
        return self.languages[chosen[top]], min(1.0, max(0.0, float(theta[top]))), {self.languages[i]: float(x) for i, x in zip(chosen, theta, strict=True)}


def fit_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Trigram counts over all rows with text and language: summed in each task, then by (language, bucket).

    What reaches the driver is languages x BUCKETS numbers, of MOST_LANGUAGES at most. Rows with null text or language
    teach nothing; without rows the model knows no language and everything is undetermined.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.get(lang)
                if own is None:
                    own = counts[lang] = np.zeros(BUCKETS, np.int64)
                found = buckets_of(text)
                if len(found) < 2048:
                    np.add.at(own, found, 1)
                else:
                    own += np.bincount(found, minlength=BUCKETS)
        for lang, own in counts.items():
            rows = own.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.int32()), pa.array(own[rows],
                pa.int64())], ["lang", "bucket", "n"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    small_batches(labelled.sparkSession)
    table = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = table.limit(MOST_LANGUAGES * BUCKETS + 1).toPandas()
    if table["lang"].nunique() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return LanguageModel.of({lang: np.bincount(own.bucket.to_numpy(), own.n.to_numpy(np.float64), BUCKETS) for lang, own in table.groupby("lang")})


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, proportions (map of the selected languages).

    Null texts and texts without a letter are `und` with score 0 and an empty map. Whole texts are read; other
    columns are not. The model is broadcast: languages x BUCKETS floats.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(id_col)).dtypes[0][1]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            rows = [own.predict(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([list(r[2].items()) for r in rows], pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "lang_pred", "score", "proportions"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict,
        f"doc_id {kind}, lang_pred string, score double, proportions map<string,double>")


def with_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", name: str = "found") -> DataFrame:
    """docs with its own columns and one more: a struct of lang_pred and score, as of identify_languages."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            rows = [own.predict(text) for text in batch.column(at).to_pylist()]
            found = pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
                ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, f"c{len(names)}"])

    numbered = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    fields = [*(f"{c} {kind}" for c, kind in numbered.dtypes), f"c{len(names)} struct<lang_pred:string,score:double>"]
    return numbered.mapInArrow(predict, ", ".join(fields)).select([F.col(f"c{i}").alias(c) for i, c in enumerate([*names, name])])


def identified(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs in an identifiable language, with their columns; a null language becomes the one found.

    A model is learned from the rows that held_out() leaves. Rejected are `und` (null or letterless) texts and those
    whose main language has a proportion under `least`. Without any labelled row nothing can be identified, and
    nothing remains.
    """
    model = fit_language_model(docs.filter(~held_out(id_col)), text_col, lang_col)
    name = fresh(docs, "found")
    found = F.col(name)
    own = [c if c != lang_col else F.coalesce(F.col(lang_col), found["lang_pred"]).alias(lang_col) for c in docs.columns]
    return with_languages(docs, model, text_col, name).filter((found["lang_pred"] != UNDETERMINED) & (found["score"] >= least)).select(own)


def held_out(id_col: str = "doc_id"):
    """Every fifth document by the CRC-32 of its id's digits; a null id has the digits of nothing."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
