"""How filters interact: a fingerprint-routed RDD settles which texts repeat, and count vectors of failure masks give the effects of every order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import regex
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

#: The filters; bit i of a failure mask is that of the i-th.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
REPEATED = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = regex.compile(rb"[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of distinct texts that one routed partition holds on average, and that a task gathers before it passes them on.
CHAIN_BYTES = 32 << 20
GATHERED_BYTES = 16 << 20

COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def failures(text: str) -> int:
    """The mask of filters A to D that a text fails; its words are maximal runs without ASCII white space."""
    data = text.encode()
    words = data.split()  # of bytes: at x20 and x09 to x0D
    capitals = len(data) - len(data.translate(None, CAPITALS))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * len(text),
        SYMBOLS.search(data) is not None,
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def effects(counts: np.ndarray) -> Iterator[tuple]:
    """(filter_order, step, *COUNTS) of all orders and steps, from documents, good and toxic ones by failure mask (3 x MASKS)."""
    masks = np.arange(MASKS)
    rows, total = [], Counter()
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, own in enumerate(order):
            fails, spared = masks >> own & 1 == 1, masks & before == 0
            removed, good, toxic = (int(c) for c in counts[:, fails & spared].sum(axis=1))
            kept = counts[0, spared & ~fails].sum()
            rows.append((order, step, kept, removed, counts[0, fails & ~spared].sum(), counts[0, 1 << own], good, toxic))
            total[own] += removed
            before |= 1 << own
    for order, step, *found in rows:
        yield ("".join(FILTERS[i] for i in order), step + 1, *map(int, found), total[order[step]])


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
        fingerprint: Callable[[bytes | str], int] = xxhash.xxh64_intdigest) -> DataFrame:
    """doc_id, part, mask, n: how many rows of docs have this id and part and fail just these filters.

    Texts are dealt by xxhash; a partition keeps, for each fingerprint, a chain of full texts with the smallest id of
    each, and marks all other ids as repeats. Tasks gather equal texts before that, so of a text with any number of
    copies each sends one a GATHERED_BYTES; the number of partitions follows the bytes of all texts, so each holds
    about CHAIN_BYTES. Rows with one id and text are no repeats of each other; a null id is neither smaller nor larger
    than another, so its row neither repeats nor is repeated. Null text and null part count as empty.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col),
        F.lit("")).alias("part"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-held // CHAIN_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = rows.dtypes[0][1]

    def gathered(rows: Iterator[tuple]) -> Iterator[tuple]:
        """(key, (text, id, counts by part and mask)); a record without text is settled, and its key is dealt by its id."""
        texts: dict[bytes, list] = {}
        settled: Counter = Counter()
        size = 0

        def passed_on() -> Iterator[tuple]:
            for data, (own, counts) in texts.items():
                yield fingerprint(data), (data, own, list(counts.items()))
            for (own, part, mask), n in settled.items():
                yield fingerprint(str(own)), (None, own, [((part, mask), n)])

        for own, text, part in rows:
            mask = failures(text)
            if own is None:
                settled[own, part, mask] += 1
                continue
            data = text.encode()
            first = texts.get(data)
            if first is None:
                texts[data] = [own, Counter({(part, mask): 1})]
                size += len(data) + 200
            elif own == first[0]:
                first[1][part, mask] += 1
            else:
                if own < first[0]:
                    (own, counts), texts[data] = first, [own, Counter({(part, mask): 1})]
                else:
                    counts = {(part, mask): 1}
                for (p, m), n in counts.items():
                    settled[own, p, m | REPEATED] += n
                size += 100
            if size > GATHERED_BYTES:
                yield from passed_on()
                texts.clear()
                settled.clear()
                size = 0
        yield from passed_on()

    def chained(records: Iterator[tuple]) -> Iterator[tuple]:
        chains: dict[int, list[list]] = {}
        for key, (data, own, counts) in records:
            if data is None:
                yield from ((own, part, mask, n) for (part, mask), n in counts)
                continue
            chain = chains.setdefault(key, [])
            link = next((x for x in chain if x[0] == data), None)
            if link is None:
                chain.append([data, own, Counter(dict(counts))])
            elif own == link[1]:
                link[2].update(dict(counts))
            else:
                if own < link[1]:
                    own, counts, link[1], link[2] = link[1], link[2].items(), own, Counter(dict(counts))
                yield from ((own, part, mask | REPEATED, n) for (part, mask), n in counts)
        for chain in chains.values():
            for _, own, counts in chain:
                yield from ((own, part, mask, n) for (part, mask), n in counts.items())

    routed: RDD = rows.rdd.mapPartitions(gathered).partitionBy(parts, lambda key: key % parts)
    return docs.sparkSession.createDataFrame(routed.mapPartitions(chained), f"doc_id {kind}, part string, mask int, n long", verifySchema=False)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step: part, filter_order, step and the counts of COUNTS.

    A document is good or toxic if any row of labels with its id says so; labels of null ids and null labels say
    nothing. Count vectors of the masks are combined by part, in each task first. Parts without a document don't
    occur, so an empty table has an empty result. Other columns of docs and labels are not read.
    """
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    said = broadcast_if_small(written(said.filter("good OR toxic"), "said").withColumnRenamed("doc_id", "said_id"))
    found = failure_masks(docs, id_col, text_col, part_col)
    rows = found.join(said, F.col("doc_id") == F.col("said_id"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)), F.coalesce("toxic",
        F.lit(False)))

    def added(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[:, mask] += (n, n * good, n * toxic)
        return counts

    def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        one += other
        return one

    vectors = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: added(np.zeros((3, MASKS), np.int64), row), added, merged)
    out = vectors.flatMap(lambda kv: ((kv[0], *row) for row in effects(kv[1])))
    return docs.sparkSession.createDataFrame(out, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS),
        verifySchema=False)
