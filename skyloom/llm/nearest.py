"""Nearest vectors by multi-index hashing: learned rotated binary codes, indexed by substrings, probed by the pigeonhole rule."""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, written

#: Bits of a code, bits of a substring, and so many substrings. Tables of more vectors than LONG_FROM take 32 bits.
BITS, SUBSTRING = 256, 16
SUBSTRINGS = BITS // SUBSTRING
LONG_FROM = 1 << 22
#: Most values that are probed in one substring for a query, and most vectors that share a substring in the probed index.
PROBES, BUCKET = 600, 4096
#: Bits, in standard deviations, by which the probed radius must exceed the k-th found code's distance.
CERTAIN = 2.0
#: Distinct vectors that the rotations and the radius are fitted on, and how many of them serve as queries for the radius.
FIT_ROWS, FIT_QUERIES = 16_384, 256
#: Share of the true neighbours in the fitting sample that the radius must cover. A larger table has nearer neighbours, so it covers more there.
FIT_RECALL = 0.98
#: Share of the queries that probing must be expected to settle, or it is left out.
WORTH = 0.05
ITQ_ROUNDS = 20
#: Vectors in a block of the index and queries in a block: what one task holds of each.
INDEX_BLOCK, QUERY_BLOCK = 8_192, 16_384
#: Queries that are compared with an index block at once.
STEP = 256


@dataclass(frozen=True)
class BinaryCodes:
    """Sign codes of centred unit vectors after a projection whose columns are learned rotations of principal axes."""

    mean: np.ndarray
    projection: np.ndarray
    radius: int
    kth: float = 0.0  # distance of the k-th nearest code that a share of WORTH of the sample's queries falls below
    nearing: float = 0.0  # by how much that distance shrinks when a table has four times the vectors
    fitted: int = 0

    def kth_at(self, n: int) -> float:
        """The distance kth, carried on to a table of n vectors."""
        return max(0.0, self.kth - self.nearing * max(0.0, np.log2(max(1, n) / max(1, self.fitted)) / 2))

    @classmethod
    def fit(cls, vectors: np.ndarray, k: int, seed: int = 0) -> BinaryCodes:
        """Iterative quantisation on a bounded sample; several rotations from different starts where dimensions are fewer than bits."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        mean = unit.mean(axis=0)
        centred = unit - mean
        axes = np.linalg.svd(centred.T @ centred)[0][:, :BITS]
        reduced = centred @ axes
        rng = np.random.default_rng(seed)
        parts = []
        for _ in range(-(-BITS // axes.shape[1])):
            rotation = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))[0]
            for _ in range(ITQ_ROUNDS):
                u, _, v = np.linalg.svd(np.where(reduced @ rotation >= 0, 1.0, -1.0).T @ reduced)
                rotation = (u @ v).T
            parts.append(axes @ rotation)
        projection = np.concatenate(parts, axis=1)[:, :BITS]
        codes = cls(mean, projection, BITS)
        chosen = rng.choice(len(unit), min(FIT_QUERIES, len(unit)), replace=False)
        likeness = unit[chosen] @ unit.T
        likeness[np.arange(len(chosen)), chosen] = -2
        near = np.argsort(-likeness, axis=1, kind="stable")[:, : min(k, len(unit) - 1)]
        words = codes.of(unit).view(np.uint64)
        apart = np.bitwise_count(words[chosen][:, None, :] ^ words[near]).sum(axis=2)
        if not apart.size:
            return cls(mean, projection, BITS)

        def kth(rows: np.ndarray) -> float:
            each = np.array([np.partition(np.bitwise_count(words[q] ^ words[rows]).sum(axis=1), min(k, len(rows) - 1))[min(k, len(rows) - 1)] for q in chosen])
            return float(np.quantile(each, WORTH))  # a query is its own nearest, at 0

        whole = kth(np.arange(len(unit)))
        return cls(mean, projection, int(np.quantile(apart, FIT_RECALL)), whole, max(0.0, kth(np.arange(0, len(unit), 4)) - whole), len(unit))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, SUBSTRINGS) substrings of the codes, as 16-bit words."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        bits = (unit - self.mean) @ self.projection >= 0
        if bits.shape[1] < BITS:
            bits = np.pad(bits, ((0, 0), (0, BITS - bits.shape[1])))
        return np.packbits(bits, axis=1).view(np.uint16)


class SubstringIndex:
    """For each substring position, the rows of a block by the value that they have there."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        self.values, self.value_of_row = [], []
        for j in range(SUBSTRINGS):
            values, of_row = np.unique(codes[:, j], return_inverse=True)
            self.values.append(values)
            self.value_of_row.append(of_row.astype(np.int32))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within the radius.

        Pigeonhole: with radius = m q + a, such a code differs from the query in at most q bits in one of the first
        a + 1 substrings, or in at most q - 1 bits in one of the others. Rows found so are checked on whole codes.
        """
        if radius >= BITS:
            return np.arange(len(self.words))
        least, extra = divmod(radius, SUBSTRINGS)
        hit = np.full(len(self.words), least >= SUBSTRING // 3)  # probes that pass most rows save nothing
        for j in range(SUBSTRINGS):
            reach = least if j <= extra else least - 1
            if 0 <= reach < SUBSTRING // 3:
                hit |= (np.bitwise_count(self.values[j] ^ code[j]) <= reach)[self.value_of_row[j]]
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.words[rows] ^ code.view(np.uint64)).sum(axis=1) <= radius]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b, in double precision."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def scaled(vector: np.ndarray) -> np.ndarray:
    """The vector times the power of two that brings its largest component near 1: exact, and no square under- or overflows."""
    return np.ldexp(vector, -int(np.frexp(np.abs(vector).max())[1]))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, vec) of the vectors that take part; vec holds the scaled components as little-endian doubles."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "dim": pdf.v.map(len).astype("int32"), "vec": [scaled(np.asarray(x, "<f8")).tobytes() for x in pdf.v]})

    return rows.mapInPandas(pack, f"id {dict(rows.dtypes)['id']}, dim int, vec binary")


WORDS = [f"c{i}" for i in range(BITS // 64)]


def _coded(rows: DataFrame, codes: dict[int, BinaryCodes]) -> DataFrame:
    """rows with columns dim and vec, and the code of vec as columns WORDS of 64 bits."""
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def of(batches):
        for pdf in batches:
            out = np.zeros((len(pdf), len(WORDS)), np.int64)
            for dim, at in pdf.groupby("dim").indices.items():
                out[at] = shared.value[dim].of(_matrix(pdf.vec.iloc[at], np.float64)).view(np.int64)
            yield pdf.assign(**dict(zip(WORDS, out.T, strict=True)))

    return rows.mapInPandas(of, ", ".join([*(f"{c} {kind}" for c, kind in rows.dtypes), *(f"{c} long" for c in WORDS)]))


def _substring(j: int, width: int):
    """Substring j of a code, as a long."""
    per_word = 64 // width
    return F.shiftrightunsigned(F.col(WORDS[j // per_word]), width * (j % per_word)).bitwiseAND((1 << width) - 1)


def _flips(width: int, n: int) -> list[int]:
    """All masks of `width` bits with n of them set."""
    return [sum(1 << b for b in bits) for bits in combinations(range(width), n)]


def _substrings(rows: DataFrame, key: str, width: int, masks: list[int]) -> DataFrame:
    """(dim, pos, value, key): every substring of every code, with each of the masks' bits turned over."""
    value = F.explode(F.array(*[F.struct(F.lit(j).alias("pos"), _substring(j, width).alias("value")) for j in range(BITS // width)])).alias("s")
    out = rows.select(key, "dim", value).select(key, "dim", "s.*")
    if masks != [0]:
        turned = out.withColumn("mask", F.explode(F.array(*map(F.lit, masks)).cast("array<long>")))
        out = turned.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    return out


def candidates(queries: DataFrame, index: DataFrame, parts: DataFrame, common: DataFrame, width: int, flips: int) -> tuple[DataFrame, DataFrame, int]:
    """One probing step: pairs (qn, cid, apart) within the radius, the queries it can't serve, and the radius.

    Pigeonhole: a code within radius m (flips + 1) - 1 of a query's differs from it in at most `flips` bits in one of
    the m substrings, so joins on equal values of (position, substring), with up to so many bits turned over, find it.
    Queries that meet a value which more than BUCKET vectors share (table `common`) are not served here.
    """
    radius = BITS // width * (flips + 1) - 1
    probes = _substrings(queries, "qn", width, [m for n in range(flips + 1) for m in _flips(width, n)])
    unserved = written(probes.join(broadcast_if_small(common), ["dim", "pos", "value"], "left_semi").select("qn").distinct(), "unserved")
    served = probes.join(broadcast_if_small(unserved), "qn", "left_anti")
    pairs = served.join(parts, ["dim", "pos", "value"]).select("qn", "cid").distinct()
    own = queries.select("qn", *(F.col(w).alias(f"q{w}") for w in WORDS))
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"q{w}"))) for w in WORDS), F.lit(0))
    pairs = pairs.join(index.select("cid", *WORDS), "cid").join(broadcast_if_small(own), "qn").select("qn", "cid", apart.alias("apart"))
    return pairs.filter(F.col("apart") <= radius), unserved, radius


def _scored(pairs: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """(qn, query_id, vec_id, apart, score) of pairs (qn, cid, apart): cosines of the vectors, one row for each other id."""
    rows = pairs.join(index.select("cid", "ids", "vec"), "cid").join(queries.select("qn", "query_id", "qvec"), "qn")
    rows = rows.select("qn", "query_id", "apart", "ids", "qvec", "vec")
    kinds = dict(rows.dtypes)

    def score(batches):
        for pdf in batches:
            out = np.empty(len(pdf))
            for _, at in pdf.groupby(pdf.vec.map(len)).indices.items():
                out[at] = cosine(_matrix(pdf.qvec.iloc[at], np.float64), _matrix(pdf.vec.iloc[at], np.float64))
            yield pdf[["qn", "query_id", "apart", "ids"]].assign(score=out)

    found = rows.mapInPandas(score, f"qn long, query_id {kinds['query_id']}, apart int, ids {kinds['ids']}, score double")
    return found.select("qn", "query_id", "apart", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(qn, query_id, rank, vec_id, score): the k best of rows with these columns but rank."""
    order = Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id")
    ranked = found.select("qn", "query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("qn", "query_id", "rank", "vec_id", "score")


def _search(queries: DataFrame, index: DataFrame, radius: dict[int, int], k: int, blocks: tuple[int, int]) -> DataFrame:
    """(qn, query_id, vec_id, score): the k best within the radius of a dimension, of each query in each index block."""
    kind = dict(queries.dtypes)["query_id"]
    query_blocks, index_blocks = blocks
    every_index, every_query = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (index_blocks, query_blocks))
    dealt_queries = queries.select("dim", "qn", "query_id", "qvec", *WORDS, F.pmod(F.xxhash64("qn"),
        F.lit(query_blocks)).cast("int").alias("qb"), every_index.alias("ib"))
    dealt_index = index.select("dim", "ids", "vec", *WORDS, F.pmod(F.xxhash64("vec"), F.lit(index_blocks)).cast("int").alias("ib"), every_query.alias("qb"))
    columns = ["qn", "query_id", "ids", "score"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            a, b = _matrix(left.qvec, np.float64), _matrix(right.vec, np.float64)
            own, table = (np.ascontiguousarray(x[WORDS].to_numpy(np.int64)).view(np.uint16) for x in (left, right))
            table = SubstringIndex(table)
            reach = radius[int(left.dim.iloc[0])]
            lead = right.ids.map(lambda x: x[0]).to_numpy()
            for lo in range(0, len(a), STEP):
                rows = [table.within(own[i], reach) for i in range(lo, min(lo + STEP, len(a)))]
                i, j = np.repeat(np.arange(lo, lo + len(rows)), [len(r) for r in rows]), np.concatenate(rows)
                score = np.concatenate([cosine(a[i[s : s + 65_536]], b[j[s : s + 65_536]]) for s in range(0, len(i), 65_536)] or [np.empty(0)])
                order = np.lexsort((lead[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                best = place <= k  # one more: the query's own class may be among them with no other id
                found.append(pd.DataFrame({"qn": left.qn.to_numpy()[i[best]], "query_id": left.query_id.to_numpy()[i[best]],
                    "ids": right.ids.to_numpy()[j[best]], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame(columns=columns, dtype=object)

    keys = ["dim", "qb", "ib"]
    found = dealt_queries.groupBy(*keys).cogroup(dealt_index.groupBy(*keys)).applyInPandas(compare,
        f"qn long, query_id {kind}, ids array<{kind}>, score double")
    return found.select("qn", "query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")


def _fitted(index: DataFrame, k: int, n_of: dict[int, int]) -> dict[int, BinaryCodes]:
    """Codes for each dimension, from FIT_ROWS distinct vectors in all, chosen by hash: as many of each, if it has them.

    n_of tells how many a dimension has. Hashes are cut off where a few more than its share are expected, in the tasks
    that read the table, so only those are ranked.
    """
    if len(n_of) > FIT_ROWS:
        raise ValueError(f"vectors of more than {FIT_ROWS} dimensions")
    share = FIT_ROWS // max(1, len(n_of))
    enough = {dim: (share + 8 * share**0.5 + 16) / n for dim, n in n_of.items()}
    cut = index.sparkSession.createDataFrame([(dim, min(2**63 - 1, int(x * 2.0**63))) for dim, x in enough.items()], "fit_dim int, cut long")
    hashed = index.select("dim", "vec", F.xxhash64("vec").bitwiseAND(2**63 - 1).alias("h")).join(F.broadcast(cut), F.col("dim") == F.col("fit_dim"))
    place = F.row_number().over(Window.partitionBy("dim").orderBy("h", "vec"))
    sample = hashed.filter("h <= cut").select("dim", "vec", "h", place.alias("place")).filter(F.col("place") <= share)

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place")
        return pd.DataFrame({"dim": own["dim"].iloc[:1], "codes": [pickle.dumps(BinaryCodes.fit(_matrix(own["vec"], np.float64), k))]})

    # In a task, where linear algebra on small matrices has one thread, which is many times faster than several.
    return {r.dim: pickle.loads(r.codes) for r in sample.groupBy("dim").applyInPandas(fit, "dim int, codes binary").collect()}


def _worth_probing(codes: dict[int, BinaryCodes], n_of: dict[int, int], width: int) -> set[int]:
    """The dimensions in which probing is expected to settle a share of WORTH of the queries."""
    flips = max(n for n in range(width) if sum(comb(width, i) for i in range(n + 1)) <= PROBES)
    reach = BITS // width * (flips + 1) - 1
    out = set()
    for dim, own in codes.items():
        kth = own.kth_at(n_of[dim])
        if kth + CERTAIN * np.sqrt(kth * (1 - kth / BITS)) <= reach:
            out.add(dim)
    return out


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows by cosine.

    Rotations, codes and the Hamming radius are fitted on up to FIT_ROWS distinct vectors, chosen by hash; every row is
    indexed. The index is a table of (position, substring, vector). Queries probe it with 0, 1, .. bits of each
    substring turned over, by joins on equal values, as long as that takes at most PROBES values; pairs within the
    radius that such a step covers for certain are reranked by cosines of the original vectors in double precision. A
    query is settled when that radius exceeds the distance of its k-th nearest code by CERTAIN standard deviations.
    Where the fitted sample, carried on to the table's size, tells that probing would settle hardly any, it is left out.
    The rest, whose neighbours are further away or share a substring with more than BUCKET vectors, meet all codes in
    blocks: within the learned radius, or without one where that holds fewer than k. Equal vectors are indexed once
    with their k + 1 smallest ids: of equal scores the smaller ids win, so no other copy can be among k results.

    Nearest first, ties to the smaller id. Vectors null, empty, zero or with null or non-finite components take no part,
    as queries or candidates; nor do rows with null ids. Rows repeated with id and vector count once; an id with several
    vectors is searched for each of them, and is no candidate of its own. Vectors of different dimensions have no
    cosine: a query's candidates are those of its own dimension, each of which has codes of its own. With fewer than k
    candidates all of them are returned. An empty table gives an empty result. Other columns of vectors are not read.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    kind = dict(rows.dtypes)["id"]
    if rows.isEmpty():
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    # A rank of at most k + 1 is also applied before the shuffle, so a vector with very many copies is no hot group.
    place = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    classes = rows.select("dim", "vec", "id", place.alias("place")).filter(F.col("place") <= k + 1).groupBy("dim",
        "vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n_of = dict(classes.groupBy("dim").count().limit(FIT_ROWS + 1).collect())
    codes = _fitted(classes, k, n_of)
    index = written(_coded(classes, codes), "index")
    asked = rows.filter(F.col("id") % every == 0).select("dim", F.col("id").alias("query_id"), "vec").distinct()
    queries = written(_coded(asked, codes).withColumnRenamed("vec", "qvec").withColumn("qn", F.monotonically_increasing_id()), "queries")
    n_index = sum(n_of.values())
    width = SUBSTRING if n_index <= LONG_FROM else 2 * SUBSTRING
    probed = _worth_probing(codes, n_of, width)
    far = queries.filter(~F.col("dim").isin(list(probed)))

    found, left, used = [], queries.filter(F.col("dim").isin(list(probed))), [rows, classes, queries]
    if probed:
        parts = written(_substrings(index.filter(F.col("dim").isin(list(probed))), "cid", width, [0]), "parts")
        common = written(parts.groupBy("dim", "pos", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET).drop("n"), "common")
        used += [parts, common]
    for flips in range(width if probed else 0):
        if sum(comb(width, n) for n in range(flips + 1)) > PROBES or left.isEmpty():
            break
        pairs, unserved, radius = candidates(left, index, parts, common, width, flips)
        scored = written(_scored(pairs, left, index), "scored")
        kth = scored.withColumn("place", F.row_number().over(Window.partitionBy("qn").orderBy("apart", "vec_id"))).filter(F.col("place") == k)
        spread = F.sqrt(F.col("apart") * (1 - F.col("apart") / BITS))
        settled = written(kth.filter(F.col("apart") + CERTAIN * spread <= radius).select("qn"), "settled")
        found.append(written(_best(scored.join(settled, "qn", "left_semi"), k), "found"))
        open_queries = written(left.join(settled, "qn", "left_anti"), "open")
        used += [unserved, scored, settled, open_queries]
        left = open_queries
    left = left.unionByName(far)

    if not left.isEmpty():
        index_blocks = max(1, -(-n_index // INDEX_BLOCK))
        blocks = (max(1, -(-left.count() // QUERY_BLOCK)), index_blocks)
        near = written(_best(_search(left, index, {d: c.radius for d, c in codes.items()}, k, blocks), k), "near")
        full = written(near.filter(F.col("rank") == k).select("qn"), "full")
        found.append(near.join(full, "qn", "left_semi"))
        short = written(left.join(full, "qn", "left_anti"), "short")
        if not short.isEmpty():
            blocks = (max(1, -(-short.count() // QUERY_BLOCK)), index_blocks)
            found.append(written(_best(_search(short, index, dict.fromkeys(codes, BITS), k, blocks), k), "far"))
        used.append(short)
    discard(*used, index)
    return reduce(DataFrame.union, found).select("query_id", "rank", "vec_id", "score")
