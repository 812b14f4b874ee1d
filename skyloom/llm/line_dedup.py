"""Line deduplication by winnowing: repeated runs of lines lose all but their first occurrence. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, discard, join_salted, mark, written

#: Shortest run of lines that is found and deleted; the winnowing window.
RUN = 3


def _window(start: Column, size: int) -> Column:
    return F.slice(F.col("lines"), start, size)


def _selected(start: Column, size: int) -> Column:
    """The place of a window's least line hash, the rightmost of ties: equal windows select alike."""
    return -F.array_min(_window(start, size))["at"]


def _counts(start: Column, size: int, run: int, words: int | None) -> Column:
    """Whether a window is a run: `run` lines, or fewer with more than `words` words."""
    if size == run:
        return F.lit(True)
    return F.aggregate(_window(start, size), F.lit(0), lambda total, x: total + x["n"]) > words


def _starts(first: Column, last: Column, size: int) -> Column:
    """The windows of a size that begin from first to last, as far as the document has them."""
    end = F.least(last, F.size("lines") - size + 1)
    return F.when(F.size("lines") >= size, F.sequence(F.greatest(first, F.lit(1)), end)).otherwise(F.array().cast("array<int>"))


def _words(line: Column) -> Column:
    """Words of a line: one more than its spaces where these stand alone between words, else counted by pattern."""
    odd = [line.contains(c) for c in ("  ", "\t", "\v", "\f", "\r")]
    plain = ~(reduce(Column.__or__, odd) | line.startswith(" ") | line.endswith(" ")) & (line != "")
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(plain, spaces + 1).otherwise(F.regexp_count(line, F.lit(WORD)))


def _hashed(rows: DataFrame, run: int, words: int | None) -> DataFrame:
    """(id, mark, lines) of rows (id, mark, text): for each line two hashes, its place and its number of words."""

    def of(x: Column, i: Column) -> Column:
        n = [] if words is None else [_words(x).alias("n")]
        return F.struct(F.xxhash64(x).alias("h"), (-i - 1).alias("at"), F.xxhash64(F.lit(run), x).alias("h2"), *n)

    lines = F.transform(F.split("text", "\n"), of).alias("lines")
    return rows.select("id", "mark", lines).filter(F.size("lines") >= (run if words is None else 1))


def repeated_runs(rows: DataFrame, run: int, words: int | None) -> DataFrame:
    """(id, mark, start, size, first_id, first_mark, first_start): runs of rows (id, mark, text) that occur earlier.

    Winnowing: each window selects its least line hash, so the fingerprints are the distinct selected places. Those
    whose hash occurs at one place only go. Around the others, the windows that selected them are matched by 128 bits
    over all their lines with the first place that has the same, by (id, mark, start). Matches on one diagonal, with
    neither a gap nor a change of the first place, extend one another both ways to one run.
    """
    sizes = [run] if words is None else list(range(1, run + 1))
    hashed = written(_hashed(rows, run, words), "hashed")

    def places(size: int) -> Column:
        starts = F.filter(_starts(F.lit(1), F.size("lines"), size), lambda s: _counts(s, size, run, words))
        return F.transform(starts, lambda s: _selected(s, size))

    chosen = F.array_distinct(F.concat(*[places(size) for size in sizes]))
    prints = hashed.select("id", "mark", F.explode(F.transform(chosen, lambda at: F.struct(at.alias("at"), F.get("lines", at
        - 1)["h"].alias("line")))).alias("f"))
    prints = written(prints.select("id", "mark", "f.*"), "prints")
    again = written(prints.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again")
    hits = join_salted(prints, again, ["line"], "n", ["id", "mark", "at"])
    hits = written(hits.groupBy("id", "mark").agg(F.collect_set("at").alias("hits")), "hits")  # places in one document

    def seeds(at: Column, size: int) -> Column:
        starts = F.filter(_starts(at - size + 1, at, size), lambda s: (_selected(s, size) == at) & _counts(s, size, run, words))

        def seed(start: Column) -> Column:
            keys = [F.xxhash64(F.lit(n), F.transform(_window(start, size), lambda x: x[field])).alias(f"k{n}") for n, field in ((1, "h"), (2, "h2"))]
            return F.struct(start.alias("start"), F.lit(size).alias("size"), *keys)

        return F.transform(starts, seed)

    near = hashed.alias("d").join(hits.alias("p"), F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.mark") == F.col("p.mark")))
    near = near.select("d.id", "d.mark", "lines", "hits")
    found = F.flatten(F.transform("hits", lambda at: F.concat(*[seeds(at, size) for size in sizes])))
    windows = written(near.select("id", "mark", F.explode(found).alias("w")).select("id", "mark", "w.*"), "windows")
    key = ["k1", "k2", "size"]
    firsts = windows.groupBy(*key).agg(F.min(F.struct("id", "mark", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = written(firsts.select(*key, F.col("first.id").alias("first_id"), F.col("first.mark").alias("first_mark"),
        F.col("first.start").alias("first_start"), "n"), "firsts")
    matches = join_salted(windows, firsts, key, "n", ["id", "mark", "start"]).withColumn("diagonal", F.col("first_start") - F.col("start"))
    matches = matches.filter(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark")) & (F.col("diagonal") == 0)))

    diagonal = ["id", "mark", "first_id", "first_mark", "diagonal"]
    order = Window.partitionBy(*diagonal).orderBy("start", "size")  # windows of one document
    end = F.col("start") + F.col("size")
    begins = F.coalesce(F.col("start") > F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = matches.withColumn("run", F.sum(begins.cast("int")).over(order)).groupBy(*diagonal, "run").agg(F.min("start").alias("start"),
        F.max(end).alias("end"))
    own = ["id", "mark", "start", (F.col("end") - F.col("start")).alias("size"), "first_id", "first_mark"]
    out = written(merged.select(*own, (F.col("start") + F.col("diagonal")).alias("first_start")), "runs")
    discard(hashed, prints, again, hits, windows, firsts)
    return out


def line_dedup(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text without later repeated runs, n_lines, n_removed.

    Lines are what stands between line feeds and are compared whole. A line goes if it lies in a run of `run` lines
    or more that occurs earlier, in a document of smaller id or further up in its own; null ids come first, and
    documents of one id are ordered by a hash of their text. With `words`, a passage of fewer lines counts as a run if
    it holds more words than that, between ASCII white space. Rows equal in id and text count as one place: they don't
    delete each other's lines, and lose the same lines. Runs are found by hashes of their lines; lines go only after
    the run's text was compared with that of its first occurrence.
    Null text stays null with no lines; a text may become empty. Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), mark(F.col(text_col)).alias("mark"))
    runs = repeated_runs(rows.filter("text IS NOT NULL"), run, words)

    # The text of each first occurrence, made once however often it repeats, goes to the runs that claim to equal it.
    first = ["first_id", "first_mark", "first_start", "size"]
    stretches = written(runs.groupBy(*first).agg(F.count(F.lit(1)).alias("n")), "stretches")
    same = F.col("d.id").eqNullSafe(F.col("s.first_id")) & (F.col("d.mark") == F.col("s.first_mark"))
    stretch = F.array_join(F.slice(F.split("d.text", "\n"), F.col("s.first_start"), F.col("s.size")), "\n").alias("same_text")
    texts = rows.alias("d").join(broadcast_if_small(stretches).alias("s"), same).select("s.*", stretch)
    texts = written(texts.dropDuplicates(first), "texts")
    claims = join_salted(runs, texts, first, "n", ["id", "mark", "start"])
    gone = claims.groupBy(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark")).agg(F.collect_list(F.struct("start", "size",
        "same_text")).alias("runs"))
    gone = written(gone, "gone")
    discard(runs, stretches, texts)

    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left").withColumn("lines", F.split("text", "\n"))
    equal = F.filter("runs", lambda r: F.array_join(F.slice("lines", r["start"], r["size"]), "\n") == r["same_text"])
    lost = F.flatten(F.transform(equal, lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1)))
    kept = F.array_except(F.sequence(F.lit(1), F.size("lines")), lost)
    none = F.col("text").isNull() | F.col("runs").isNull()
    text = F.when(none, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i - 1)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_removed = F.when(none, 0).otherwise(n_lines - F.size(kept)).cast("long")
    return rows.select(F.col("id").alias("doc_id"), text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))
