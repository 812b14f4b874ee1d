"""Near-duplicate detection by HyperMinHash sketches: banded registers, corrected estimates, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, first_row, join_salted, mark, runs_of, slices, without_dropped, written
from .components import components

#: 2^BUCKET_BITS registers in a sketch, each of a leading-zero count and MANTISSA_BITS bits after the first one.
BUCKET_BITS, MANTISSA_BITS = 8, 10
REGISTERS = 1 << BUCKET_BITS
#: Bands and registers in a band. A pair of similarity s shares no band with probability (1 - s^5)^40: 7e-11 at 0.85, 1e-7 at 0.8.
BANDS, BAND_REGISTERS = 40, 5
#: Standard deviations that an estimate may lie under the threshold before its pair is passed over: 1e-9.
MARGIN = 6.0
#: Members of a bucket, and shingles of theirs, that make up a block; larger buckets are dealt out as pairs of blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Word hashes remembered in a Python task.
MEMO_ENTRIES = 1 << 16

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, words: int, hashes: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. Too few words: all of them as one. No words: empty."""
    own = (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map((_WordHashes() if hashes is None else hashes).__getitem__, own), np.uint64, len(own))
    k = min(words, len(h))
    joined = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        joined = _mixed(joined * _MIX + h[i : len(h) - k + 1 + i])
    return np.unique(joined)


@lru_cache(maxsize=1)
def _borrowing(tries: int = 64) -> np.ndarray:
    """For each register, the registers an empty one borrows from, in order: the same everywhere."""
    steps = np.arange(REGISTERS * tries, dtype=np.uint64).reshape(REGISTERS, tries)
    return (_mixed((steps + np.uint64(1)) * _MIX) & np.uint64(REGISTERS - 1)).astype(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of the least hash in each bucket, as leading zeros and mantissa; 0 marks an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(shingles):
        return out
    h = _mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    rest = (h << np.uint64(BUCKET_BITS)) >> np.uint64(12)  # 52 bits: exact in a double
    least = np.full(REGISTERS, np.uint64(1 << 52))
    np.minimum.at(least, bucket, rest)
    held = least < np.uint64(1 << 52)
    fraction, exponent = np.frexp(np.maximum(least[held], np.uint64(1)).astype(np.float64))  # in [0.5, 1)
    zeros = (52 - exponent).astype(np.int64)
    mantissa = ((fraction - 0.5) * 2 * (1 << MANTISSA_BITS)).astype(np.int64)
    out[held] = (((zeros + 1) << MANTISSA_BITS) | mantissa).astype(np.uint16)
    return out


def filled(registers: np.ndarray) -> np.ndarray:
    """Registers in which each empty one repeats the first held one of its borrowing order (densified)."""
    empty = np.flatnonzero(registers == 0)
    if len(empty) in (0, REGISTERS):
        return registers
    out = registers.copy()
    order = _borrowing()[empty]
    held = registers[order] != 0
    first = held.argmax(axis=1)
    out[empty] = registers[order[np.arange(len(empty)), first]]
    lost = empty[~held.any(axis=1)]  # few shingles: no try found one
    if len(lost):
        own = np.flatnonzero(registers)
        out[lost] = registers[own[np.searchsorted(own, lost) % len(own)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of densified registers."""
    own = filled(registers)[: BANDS * BAND_REGISTERS].astype(np.uint64).reshape(BANDS, BAND_REGISTERS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for i in range(BAND_REGISTERS):
        key = _mixed(key * _MIX + own[:, i])
    return key.view(np.int64)


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of two disjoint sets of n and m shingles agree: the collision correction.

    Least values are exponential with rates n and m; a register interval at x is 0.5 / ln 2 * x / 2^MANTISSA_BITS
    wide on average, so both fall into one with the probability below.
    """
    return 0.5 / np.log(2) / (1 << MANTISSA_BITS) * n * m / np.square(n + m + 1e-9)


def estimated(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of sketch rows a and b, and the registers each rests on."""
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1) / np.maximum(used, 1)
    by_chance = accidental(n, m)
    return np.clip((same - by_chance) / (1 - by_chance), 0, 1), used


def may_reach(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs that a verification must decide: set sizes allow the threshold, and the estimate is within MARGIN of it."""
    estimate, used = estimated(a, b, n, m)
    spread = np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
    return (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & (estimate >= threshold - MARGIN * spread - 1.0 / np.maximum(used, 1))


def _set_table(docs: DataFrame, words: int, with_sketch: bool) -> DataFrame:
    """(id, mark, n, node, sketch or set) of (id, text) rows; node identifies a shingle set: 128 bits of its digest."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in slices(batches):
            sets = [shingle_set(text, words, hashes) for text in batch.column(1).to_pylist()]
            nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            data = [(sketch(s) if with_sketch else s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(len, sets), pa.int64()), pa.array(nodes,
                pa.binary()), pa.array(data, pa.binary())], ["id", "mark", "n", "node", "data"])

    kind = docs.dtypes[0][1]
    return docs.select("id", F.col("text").cast("binary").alias("text"), mark(F.col("text")).alias("mark")).mapInArrow(make,
        f"id {kind}, mark long, n long, node binary, data binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(key, cid) for every class and band."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [band_keys(np.frombuffer(data, np.uint16)) for data in batch.column(1).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "cid"])

    return classes.select("cid", "data").mapInArrow(keys, "key long, cid long")


def _sides(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (a, b) with columns n and data of both sides."""
    left = table.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("data").alias("data_a"))
    right = table.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("data").alias("data_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "data_a", "data_b")


def _plausible(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
                keep = may_reach(a, b, batch.column(2).to_numpy(), batch.column(3).to_numpy(), threshold)
                yield batch.select([0, 1]).filter(pa.array(keep))

    return _sides(pairs, classes).mapInArrow(judge, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return _sides(pairs, sets).mapInArrow(judge, "a long, b long")


def _open_buckets(buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, cid, n, root) of all bucket members, and (key, big, members) of each bucket that links don't join yet.

    big is the commonest root of such a bucket.
    """
    roots = labels.select(F.col("node").alias("cid"), "root")
    labelled = written(buckets.join(roots, "cid", "left").select("key", "cid", "n", F.coalesce("root", "cid").alias("root")), "labelled")
    per_root = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("own"))
    per_key = per_root.groupBy("key").agg(F.max(F.struct("own", "root"))["root"].alias("big"), F.count(F.lit(1)).alias("roots"), F.sum("own").alias("members"))
    return labelled, written(per_key.filter("roots > 1").drop("roots"), "open")


def _contested(buckets: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between bucket members that no link joins yet: every such pair is decided, few leave a task.

    Of buckets with the same members one is kept. In a bucket, members of its commonest root need no comparison with
    one another. The others and they are dealt into blocks of a bounded size, and each block of others meets every
    block: with sketches first, which leave the members that have a plausible partner there, then with the full sets of
    these alone, to verify their plausible pairs. A pair that shares several buckets is looked at in one. No pair
    leaves a task but links that join anything new in the block.
    """
    labelled, open_keys = _open_buckets(buckets, labels)
    h = F.xxhash64("cid")
    members = join_salted(labelled, open_keys, ["key"], "members", ["cid"])
    other = F.col("root") != F.col("big")

    def blocks(side):
        count, shingles = F.count(F.when(side, 1)), F.sum(F.when(side, F.col("n")).otherwise(0))
        return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    shape = members.groupBy("key").agg(
        F.bit_xor(h).alias("sig"), F.sum(h % 1_000_003).alias("sig2"), F.count(F.lit(1)).alias("size"), blocks(other).alias("others"), blocks(~other).alias("bigs")
    )
    kept = written(shape.groupBy("sig", "sig2", "size").agg(F.min(F.struct("key", "others", "bigs", "size")).alias("k")).select("k.*"), "kept")
    kept_members = written(join_salted(members, kept, ["key"], "size", ["cid"]), "members")
    own_keys = kept_members.groupBy("cid").agg(F.collect_list("key").alias("keys"))  # at most BANDS
    block = F.when(other, F.pmod(h, F.col("others"))).otherwise(F.col("others") + F.pmod(h, F.greatest("bigs", F.lit(1)))).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(other, F.col("bigs")).otherwise(0)))
    of_member = kept_members.withColumn("block", block).join(own_keys, "cid").join(classes.select("cid", "data"), "cid")
    dealt = of_member.withColumn("meets", meets)
    dealt = dealt.select("key", F.least("block", "meets").alias("lo"), F.greatest("block", "meets").alias("hi"), "block", "cid", "n", "root", "keys", "data")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, lo, hi), group in runs_of(batches, ["key", "lo", "hi"]):
            yield group[plausible_members(lo == hi, group, percent)][["key", "lo", "hi", "block", "cid", "root"]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, lo, hi), group in runs_of(batches, ["key", "lo", "hi"]):
            links = links_of(lo == hi, group, percent)
            if links:
                yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    place = ["key", "lo", "hi"]
    likely = dealt.repartition(*place).sortWithinPartitions(*place, "block", "cid").mapInPandas(judge,
        "key long, lo int, hi int, block int, cid long, root long")
    likely = written(likely, "likely")
    met = likely.join(sets.select("cid", "data"), "cid").repartition(*place).sortWithinPartitions(*place, "block", "cid")
    links = written(met.select(*place, "block", "cid", "root", "data").mapInPandas(compare, "a long, b long"), "contested")
    discard(labelled, open_keys, kept, kept_members, likely)
    return links


def _near_sized(n: np.ndarray, i: int, rest: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets `rest` are of a size that a link with set i allows."""
    return 100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])


class LikelyPairs:
    """Pairs of sketch rows whose equal registers, told apart by one byte each, leave may_reach a chance to say yes.

    A register's byte makes more registers equal, never fewer, and the number of equal ones that may_reach asks for
    grows with the registers that it uses, of which there are at least as many as either row holds.
    """

    def __init__(self, sketches: np.ndarray, threshold: float):
        self.held = sketches != 0
        byte = ((sketches.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        self.table = np.where(self.held, np.maximum(byte, 2), 0).astype(np.uint8)
        n = self.held.sum(axis=1)
        self.need = threshold * n - MARGIN * np.sqrt(threshold * (1 - threshold) * n) - 1

    def after(self, i: int) -> np.ndarray:
        """For each row after i, whether it may pair with row i."""
        own = np.where(self.held[i], self.table[i], np.uint8(1))  # what is empty equals nothing
        same = np.bitwise_count((self.table[i + 1 :] == own).view(np.uint64)).sum(axis=1)
        return same >= np.maximum(self.need[i + 1 :], self.need[i])


def plausible_members(alone: bool, group: pd.DataFrame, percent: int) -> np.ndarray:
    """Which members of one block, or of two that meet, have a plausible partner of another root there.

    Pairs that also share a bucket of a smaller key are left to that one. A pair of two that have a partner already is
    not looked at, so a block of copies takes time in proportion to its members.
    """
    root, block, n = (group[c].to_numpy() for c in ("root", "block", "n"))
    found = np.zeros(len(group), bool)
    if (root == root[0]).all():
        return found
    sketches = np.frombuffer(b"".join(group.data), np.uint16).reshape(len(group), -1)
    likely = LikelyPairs(sketches, percent / 100)
    key = group["key"].iloc[0]
    earlier = [{k for k in keys if k < key} for keys in group["keys"]]
    for i in range(len(group) - 1):
        rest = np.arange(i + 1, len(group))
        near = root[rest] != root[i]
        if found[i]:
            near &= ~found[rest]
        if not alone:
            near &= block[rest] != block[i]
        if not near.any():
            continue
        j = rest[near & _near_sized(n, i, rest, percent) & likely.after(i)]
        j = j[[earlier[i].isdisjoint(earlier[x]) for x in j]] if len(j) else j
        j = j[may_reach(sketches[j], sketches[i], n[j], np.full(len(j), n[i]), percent / 100)] if len(j) else j
        found[j] = True
        found[i] |= len(j) > 0
    return found


def links_of(alone: bool, group: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """New links among the members of one block, or between those of two, verified on full sets."""
    members = [np.frombuffer(data, np.uint64) for data in group.data]
    cid, root, block = (group[c].to_numpy() for c in ("cid", "root", "block"))
    if (root == root[0]).all():
        return []
    sketches, n = np.stack([sketch(m) for m in members]), np.array([len(m) for m in members])
    likely = LikelyPairs(sketches, percent / 100)
    ends = np.cumsum(n)
    flat, starts = np.concatenate(members), ends - n
    root = root.copy()
    links = []
    for i in range(len(cid)):
        rest = np.arange(i + 1, len(cid))
        near = root[rest] != root[i]
        if not alone:
            near &= block[rest] != block[i]
        if not near.any():
            continue
        j = rest[near & _near_sized(n, i, rest, percent) & likely.after(i)]
        j = j[may_reach(sketches[j], sketches[i], n[j], np.full(len(j), n[i]), percent / 100)] if len(j) else j
        for part in np.array_split(j, -(-len(j) // 64)) if len(j) else ():
            part = part[root[part] != root[i]]
            if not len(part):
                continue
            at = np.concatenate([np.arange(starts[x], ends[x]) for x in part])
            place = np.minimum(np.searchsorted(members[i], flat[at]), n[i] - 1)
            both = np.add.reduceat(members[i][place] == flat[at], np.cumsum(n[part]) - n[part], dtype=np.int64)
            for x in part[100 * both >= percent * (n[i] + n[part] - both)]:
                if root[x] != root[i]:
                    links.append((min(cid[i], cid[x]), max(cid[i], cid[x])))
                    root[root == root[x]] = root[i]
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, mark (a hash of the text), stays.

    Lower-cases A-Z, takes words at ASCII white space and the set of distinct `words`-word shingles; with fewer words
    the whole sequence as one. Documents are linked when 100 * intersection >= percent * union of the full sets.
    component_id is the smallest id reachable over links, the document's own included; kept says that the row carries
    it; stays holds for one (id, mark) of a component, also where ids repeat or are null. Null or wordless texts have no
    shingles and no links: each is its own component. Rows with equal sets form one class from the start, so copies are
    never paired; ids may repeat or be null (null sorts after all others).

    First every bucket's members are checked against its smallest member. Then all pairs of bucket members that no link
    joins yet meet in blocks, and those whose estimate comes near the threshold are checked. So every candidate pair is
    either verified, estimated clearly below the threshold, or inside one component already.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    digest = written(_set_table(rows, words, True), "digest")
    classes = digest.filter("node IS NOT NULL").groupBy("node").agg(F.min(first_row(F.col("id"), F.col("mark"))).alias("label"),
        F.first("n").alias("n"), F.first("data").alias("data"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n_classes = classes.count()

    bands = written(_bands(classes), "bands")
    shared = written(bands.groupBy("key").agg(F.min("cid").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "shared")
    buckets = written(join_salted(bands, shared, ["key"], "members", ["cid"]), "buckets")
    stars = buckets.filter("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    stars = written(_plausible(stars, classes, percent / 100), "stars")

    # Full sets are made again for candidates only: members of buckets that are shared.
    wanted = written(classes.join(buckets.select("cid").distinct(), "cid", "left_semi").select("cid", "n", F.col("label.id").alias("label"), "node"), "wanted", n_classes)
    labels = broadcast_if_small(wanted.select("label").distinct())
    texts = rows.join(labels, rows["id"].eqNullSafe(labels["label"]), "left_semi")
    sets = _set_table(texts, words, False).select("node", "data").join(broadcast_if_small(wanted.select("node", "cid", "n")), "node")
    sets = written(sets.dropDuplicates(["cid"]).select("cid", "n", "data"), "sets")

    links = written(_verified(stars, sets, percent), "links")
    joined = components(links)
    members = buckets.select("key", "cid").join(sets.select("cid", "n"), "cid")
    more = _contested(members, joined, classes, sets, percent)
    discard(joined, bands, shared, buckets, stars, wanted, sets)
    joined = components(links.union(more))
    discard(links, more)

    member = classes.select("node", "cid", "label").join(joined, F.col("cid") == joined["node"], "left").select(classes["node"], "label",
        F.coalesce("root", "cid").alias("root"))
    lowest = member.groupBy("root").agg(F.min("label").alias("first"))
    of_node = written(member.join(lowest, "root").select("node", F.col("first.id").alias("first_id"), F.col("first.mark").alias("first_mark")), "of_node", n_classes)
    discard(classes, joined)
    found = digest.select("id", "mark", "n", "node").join(broadcast_if_small(of_node), "node", "left")
    alone = F.col("node").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("first_id"))
    kept = F.col("id").eqNullSafe(component)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"),
        "mark", (kept & (alone | (F.col("mark") == F.col("first_mark")))).alias("stays"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_dedup lets stay, with their columns: one document of each component."""
    return without_dropped(docs, near_dedup(docs, id_col, text_col, words, percent), id_col, text_col)
