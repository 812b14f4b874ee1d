"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, join_salted, mark, written

#: Documents, or residuals of the level below, that one node of the reduction tree folds.
FAN_IN = 32
#: A document is taken at most so many times.
MOST_COPIES = 2


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def source_targets(sizes: DataFrame, share: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, n, rows, target) from rows (source, size).

    Sources by code point, null last, take the weights in turn and share `share` times all sizes. No target is above
    MOST_COPIES times its source: with sources in order of cap by weight, the full ones are a prefix, found by running
    sums. One row per source is ordered in one place; documents are not.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"), F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    stats = stats.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("place") % len(weights) + 1))
    stats = stats.withColumn("cap", F.col("source_size") * float(MOST_COPIES)).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    stats = stats.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    stats = stats.withColumn("full", F.col("ratio") <= F.col("level"))
    water = F.min(F.when(~F.col("full"), F.struct("ratio", "place", "level"))).over(everything)["level"]
    return stats.select("source", "source_size", "n", "rows", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * water).alias("target"))


def _fold(units: Column, level: int, seed: int) -> Column:
    """Folds an array of (doc_id, rep, size, mass) units, 0 < mass < size, pairing the carried unit with the next.

    Mass moves between the two until one holds none or all of its size; the direction is drawn so that no unit's
    expectation changes. Gives the carried unit and the settled ones.
    """
    settled = F.transform(F.slice(units, 1, 0), lambda u: F.struct(u["doc_id"], u["rep"], u["size"], F.lit(0).alias("copy")))

    def settle(unit: Column, copy: int | Column) -> Column:
        return F.struct(unit["doc_id"].alias("doc_id"), unit["rep"].alias("rep"), unit["size"].alias("size"), (F.lit(copy)
            if isinstance(copy, int) else copy).alias("copy"))

    def carry(unit: Column, mass: Column) -> Column:
        return F.struct(unit["doc_id"].alias("doc_id"), unit["rep"].alias("rep"), unit["size"].alias("size"), mass.alias("mass"))

    def step(acc: Column, unit: Column) -> Column:
        held = acc["held"]
        up, down = F.least(held["size"] - held["mass"], unit["mass"]), F.least(held["mass"], unit["size"] - unit["mass"])
        rises = _uniform(held["doc_id"], held["rep"], unit["doc_id"], unit["rep"], F.lit(level), F.lit(seed)) * (up + down) < down
        risen = F.when(held["size"] - held["mass"] <= unit["mass"], F.struct(carry(unit, unit["mass"] - up).alias("held"), settle(held,
            1).alias("one"))).otherwise(F.struct(carry(held, held["mass"] + up).alias("held"), settle(unit, 0).alias("one")))
        fallen = F.when(held["mass"] <= unit["size"] - unit["mass"], F.struct(carry(unit, unit["mass"] + down).alias("held"), settle(held,
            F.when(up + down > 0,
            0).otherwise((held["mass"] > 0).cast("int"))).alias("one"))).otherwise(F.struct(carry(held, held["mass"] - down).alias("held"),
            settle(unit, 1).alias("one")))
        new = F.when(rises, risen).otherwise(fallen)
        return F.transform(F.array(new), lambda x: F.struct(x["held"].alias("held"), F.concat(acc["done"], F.array(x["one"])).alias("done")))[0]

    first = units[0]
    start = F.struct(carry(first, first["mass"]).alias("held"), settled.alias("done"))
    return F.aggregate(F.slice(units, 2, FAN_IN * 1_000_000), start, step)


def _corrected(settled: DataFrame, last: DataFrame) -> DataFrame:
    """The settled units and the last one of each source, rounded to nearest; a settled unit makes up for its error.

    The one whose size comes nearest to the words that rounding adds or takes is turned over where that helps.
    One row per source is broadcast if small.
    """
    error = (F.col("copy") * F.col("size") - F.col("mass")).alias("error")  # above 0: words too many
    errors = last.select(F.col("source").alias("of"), error)
    settled = settled.withColumn("u", _uniform(F.col("doc_id"), F.col("rep")))
    wrong = settled.join(broadcast_if_small(errors), settled["source"].eqNullSafe(F.col("of")) & (F.col("copy") == (F.col("error") > 0).cast("int")))
    rest = F.abs(F.abs("error") - F.col("size"))
    turned = wrong.filter(rest < F.abs("error")).groupBy("source").agg(F.min(F.struct(rest.alias("rest"), "u", "doc_id", "rep")).alias("t"))
    turned = turned.select(F.col("source").alias("of"), F.col("t.doc_id").alias("t_id"), F.col("t.rep").alias("t_rep"))
    same = settled["source"].eqNullSafe(F.col("of")) & settled["doc_id"].eqNullSafe(F.col("t_id")) & (settled["rep"] == F.col("t_rep"))
    own = ["source", "doc_id", "rep", "size"]
    out = settled.join(broadcast_if_small(written(turned, "turned")), same, "left").select(*own, F.when(F.col("t_rep").isNull(),
        F.col("copy")).otherwise(1 - F.col("copy")).alias("copy"))
    return out.union(last.select(*own, "copy"))


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """docs with a hash `key` of id and source, and the number of a row among those of its key."""
    rows = docs.withColumn("key", F.xxhash64(id_col, source_col))
    return rows, F.row_number().over(Window.partitionBy("key").orderBy(id_col, source_col, mark(F.col(text_col))))


def mixed_documents(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), id_col: str = "doc_id",
    source_col: str = "source", text_col: str = "text", seed: int = 7) -> DataFrame:
    """The mix itself: rows of docs, with their columns, as often as mix_sources takes them."""
    taken = mix_sources(docs, share, weights, id_col, source_col, text_col, seed)
    taken = taken.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "copies"))).alias("taken"))
    numbered = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows, place = _keyed(numbered, own[id_col], own[source_col], own[text_col])
    rows = rows.join(taken, "key").withColumn("place", place)
    rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.get("taken", F.col("place") - 1)["copies"])))
    return rows.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def mix_sources(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), id_col: str = "doc_id",
    source_col: str = "source", text_col: str = "text", seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, source, copies, key, rep.

    size is the number of words at ASCII white space; null text has none. Every document of a source has the same
    expected number of copies, target / source_size, at most MOST_COPIES. Its whole part is given; the fractions are
    rounded by pivotal steps that keep the source's words constant: first within chunks of about FAN_IN documents,
    then residuals of chunks in a tree of that width, until one document of a source is left, which is rounded to
    nearest; a settled document of about the rounding's size makes up for it. So taken words miss the target by less
    than half a document, mostly by a word or none. Draws depend on ids only: reruns agree.

    A null source is a source. Rows that repeat an id are told apart by rep, their number among those of one key (a
    hash of id and source). Empty documents take part with no
    words. An empty table gives an empty result. Other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text,
        F.lit(WORD)).cast("long").alias("size"), mark(F.col(text_col)).alias("text"))
    rows, rep = _keyed(rows, "doc_id", "source", "text")
    digest = written(rows.withColumn("rep", rep).drop("text"), "digest")
    targets = written(source_targets(digest, share, weights), "targets")

    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of_source = targets.select("source", "source_size", "target", expected.alias("expected"), F.ceil(F.col("n") / FAN_IN).alias("chunks"), "rows")
    joined = join_salted(digest, of_source, ["source"], "rows", ["doc_id", "rep"])  # a source may hold a third of all rows
    fraction = F.col("expected") - F.floor("expected")
    open_docs = joined.filter((F.col("size") > 0) & (fraction > 0))
    unit = F.struct((-F.col("size")).alias("order"), F.xxhash64("doc_id", "rep", F.lit(seed)).alias("draw"), "doc_id", "rep", "size",
        (F.col("size") * fraction).alias("mass"))
    units = open_docs.select("source", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "rep"), F.col("chunks")).alias("chunk"), unit.alias("unit"))

    width = targets.agg(F.max(F.ceil(F.col("n") / FAN_IN))).first()[0] or 0
    level, settled = 0, None
    while width:
        folded = units.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        folded = written(folded.select("source", "chunk", _fold(F.col("units"), level, seed).alias("f")), f"level{level}")
        done = folded.select("source", F.explode("f.done").alias("d")).select("source", "d.*")
        settled = done if settled is None else settled.union(done)
        held = folded.select("source", "chunk", "f.held.*")
        if width == 1:
            last = held.withColumn("copy", (F.col("mass") * 2 >= F.col("size")).cast("int"))
            settled = _corrected(settled, last)
            break
        width = -(-width // FAN_IN)
        level += 1
        unit = F.struct((-F.col("size")).alias("order"), F.xxhash64("doc_id", "rep", F.lit(seed)).alias("draw"), "doc_id", "rep", "size", "mass")
        units = held.select("source", F.floor(F.col("chunk") / FAN_IN).alias("chunk"), unit.alias("unit"))

    whole = joined.filter(~((F.col("size") > 0) & (fraction > 0))).select("source", "doc_id", "rep", "size", "source_size", "target",
        F.floor("expected").alias("copies"))
    if settled is not None:
        drawn = join_salted(settled, of_source, ["source"], "rows", ["doc_id", "rep"])
        whole = whole.union(drawn.select("source", "doc_id", "rep", "size", "source_size", "target", F.floor("expected") + F.col("copy")))
    return whole.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source",
        F.col("copies").cast("int").alias("copies"), F.xxhash64("doc_id", "source").alias("key"), "rep")
