"""What the operators do on the way: stored maps, probed candidates, linear time, bounded merges, sets that stay at home."""

from __future__ import annotations

import time
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pytest

from skyloom.llm import common, components, html_text, language_id, line_dedup, near_dedup, nearest, sharding, token_counts
from skyloom.llm.quotient_filter import CountingQuotientFilter


# --- helpers


def test_salted_joins_are_joins(spark):
    rng = np.random.default_rng(1)
    keys = [None if k > 40 else int(k) for k in np.where(rng.random(3000) < 0.4, 7, rng.integers(0, 45, 3000))]
    many = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    one = many.groupBy("k").count().withColumn("v", many["k"] * 2).filter("k IS NULL OR k % 2 = 1")
    out = common.join_salted(many, common.written(one, "one"), ["k"], "count", ["i"])
    assert out.columns == ["k", "i", "v"]
    assert sorted(r.i for r in out.collect()) == [i for i, k in enumerate(keys) if k is None or k % 2]
    assert {(r.k, r.v) for r in out.collect()} == {(k, None if k is None else 2 * k) for k in keys if k is None or k % 2}


def test_tables_go_when_nothing_reads_them(spark):
    kept, gone = (common.written(spark.range(5), name) for name in ("kept", "gone"))
    common.discard(gone)
    assert kept.count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        gone.count()


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(2)
    edges = [(a, b) for a, b in pairwise(range(60))] + [(100, 100 + i) for i in range(1, 400)] + [(int(a), int(b)) for a,
        b in rng.integers(1000, 1200, (150, 2))]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {n: find(n) for n in {x for e in edges if e[0] != e[1] for x in e}}


# --- 1: sharding


def test_a_stored_map_is_read_edited_and_appended(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = [(i, "x" * (i * 7919 % 900)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.doc_id: r.shard for r in sharding.shard_by_bytes(frame, 8, map_path=path).collect()}
    versions = spark.read.parquet(path).groupBy("version").count().orderBy("version").collect()
    assert [tuple(r) for r in versions] == [(1, sharding.SLOTS), (2, sharding.SLOTS)]
    again = {r.doc_id: r.shard for r in sharding.shard_by_bytes(frame, 8, map_path=path).collect()}
    assert again == first and spark.read.parquet(path).count() == 2 * sharding.SLOTS  # nothing to edit, nothing stored
    more = spark.createDataFrame([*rows, *((5000 + i, "y" * 50) for i in range(40))], "doc_id long, text string")
    later = {r.doc_id: r.shard for r in sharding.shard_by_bytes(more, 8, map_path=path).collect()}
    assert sum(later[i] != s for i, s in first.items()) < 0.1 * len(first)
    wide = sharding.shard_by_bytes(more, 9, map_path=path)
    loads = [r[1] for r in wide.groupBy("shard").sum("size").collect()]
    assert len(loads) == 9 and max(loads) <= 1.02 * sum(loads) / 9 and sharding.load_map(spark, path).shards == 9
    with pytest.raises(ValueError, match="more than 8"):
        sharding.shard_by_bytes(more, 8, map_path=path)
    with pytest.raises(ValueError, match="stored"):
        sharding.store_map(spark, sharding.load_map(spark, path, 2), path)


def test_shards_of_rows_without_ids(spark):
    out = sharding.shard_by_bytes(spark.createDataFrame([(None, "a")] * 9 + [(None, None)], "doc_id long, text string"), 3).collect()
    assert len(out) == 10 and all(r.doc_id is None for r in out)


# --- 2: nearest vectors


def clustered(rng, centres: int, each: int, dim: int, spread: float) -> np.ndarray:
    middle = rng.standard_normal((centres, dim))
    return (np.repeat(middle, each, axis=0) + spread * rng.standard_normal((centres * each, dim))).astype(np.float32)


def test_probes_of_clustered_vectors_meet_few_candidates_and_find_the_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = clustered(rng, 300, 12, 48, 0.1)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    seen = []
    own = nearest.candidates

    def counted(queries, *rest):
        pairs, unserved, radius = own(queries, *rest)
        seen.append((pairs.count(), queries.count()))
        return pairs, unserved, radius

    monkeypatch.setattr(nearest, "candidates", counted)
    monkeypatch.setattr(nearest, "_search", lambda queries, *rest: pytest.fail("clustered queries must not meet all codes"))
    out = nearest.nearest(frame, 5, 50).collect()
    monkeypatch.undo()
    queries = seen[0][1]
    assert queries == len(data) // 50 and sum(n for n, _ in seen) < 0.02 * queries * len(data)
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, len(data), 50):
        score = unit @ unit[q]
        score[q] = -2
        hit += len({r.vec_id for r in out if r.query_id == q} & set(np.argsort(-score)[:5].tolist()))
    assert hit >= 0.9 * 5 * queries


def test_vectors_of_several_dimensions_and_magnitudes(spark):
    table = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 1.0, 0.0]), (52, [0.0, 0.0, 1.0]), (100, [2.0])]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest.nearest(frame, 2, 50).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (50, 1, 51), (50, 2, 52)]
    tiny = [(i, [float(x) * 10.0**e for x in v]) for i, (v, e) in enumerate([([1, 0, 0], -170), ([1, 1, 0], -300), ([0, 0, 1], 200), ([3, 1, 0], 0)])]
    out = nearest.nearest(spark.createDataFrame(tiny, "vec_id long, embedding array<double>"), 3, 50).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [3, 1, 2] and [r.score for r in out] == pytest.approx([3 / 10**0.5, 0.5**0.5, 0.0])


# --- 4: languages


def test_mixtures_against_a_plain_em_over_all_sets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit_language_model(docs)
    rows = docs.filter("n_chars > 400").select("lang", "text").limit(60).collect()
    texts = [r.text[:220] for r in rows] + [a.text[:300] + " " + b.text[:200] for a, b in pairwise(rows[:30])]
    agree = 0
    for text in texts:
        found = language_id.buckets_of(text)
        p = model.probability[found].astype(float)
        price = language_id.PENALTY * 0.5 * np.log(len(found) + 1)
        best = (-np.inf, (), None)
        for size in range(1, len(model.languages) + 1):
            for chosen in combinations(range(len(model.languages)), size):
                theta = np.full(size, 1 / size)
                for _ in range(300):
                    weight = p[:, chosen] * theta
                    theta = (weight / weight.sum(axis=1, keepdims=True)).mean(axis=0)
                value = np.log(p[:, chosen] @ theta).sum() - price * (size - 1)
                best = max(best, (value, chosen, theta), key=lambda x: x[0])
        main, score, shares = model.predict(text)
        true = {model.languages[i]: t for i, t in zip(best[1], best[2], strict=True)}
        if shares.keys() == true.keys():
            agree += 1
            assert shares == pytest.approx(true, abs=0.03) and score == pytest.approx(max(true.values()), abs=0.03)
    assert agree >= 0.95 * len(texts)


# --- 5: pages


def test_surges_and_dives_choose_the_text_where_no_element_or_name_does(monkeypatch):
    text, nav = "word " * 39 + "word", "<nav><a href=1>n</a></nav>"
    pages = {
        f"<div>Log on</div><div><p>Hi.</p></div>{nav}<div><p>{text}</p><p>{text}</p></div>{nav}<div>Bye.</div>": f"{text}\n{text}",
        f"<table><tr><td>Top</td></tr></table><form>f</form><div>Tiny.</div><aside>b</aside><section><p>{text}</p><p>So.</p></section><aside>c</aside><div>Bye.</div>": f"{text}\nSo.",
        f"<div>{text}</div><footer>f</footer><div>Small print.</div>": text,
    }
    for page, true in pages.items():
        assert html_text.main_text(page) == true
    monkeypatch.setattr(html_text, "SURGE", 0)  # without the sums nothing tells text from the rest
    assert all(html_text.main_text(page) != true for page, true in pages.items())


def test_unclosed_elements_do_not_take_the_rest_of_the_page():
    for name in ("svg", "button", "select", "object", "canvas", "noscript", "template", "video"):
        assert html_text.main_text(f"<article><p>One.</p><{name}><p>Two.</p></article>") == "One.\nTwo.", name


def test_hostile_pages_take_time_in_proportion():
    n = 1 << 17
    pages = ["<div>" * n + "</span>" * n, "<svg>" * n, "<b>" * n + "x<hr>" * n, "<p>" + "<span>" * n + "y<p>" * n, "<" * (8 * n), "<a b="
        * n, "<ul>" + "<li>x" * n, "<!--" * n, "<p class='" + "a " * (4 * n) + "'>x"]
    for page in pages:
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 6 * len(page) / 1e6 + 1, page[:20]


# --- 6: token counts


def test_bytes_that_are_no_text_are_unknown_words(spark):
    frame = spark.sql("SELECT 1L AS doc_id, cast(X'6162FF2061' AS string) AS text")
    row = token_counts.token_counts(frame, (["▁a", "▁ab"], ["b"])).first()
    assert (row.n_words, row.n_tokens, row.n_unknown) == (2, 2, 1)


# --- 7: quotient filters


def test_many_parts_of_one_block_merge_fast_and_without_loss():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 2**62, 64_000).astype(np.uint64)
    data[32_000:] = data[:32_000]
    parts = [dict(CountingQuotientFilter.of(19, x).blocks(13)) for x in np.array_split(data, 1000)]
    block = next(iter(parts[0]))
    own = [p[block] for p in parts if block in p]
    began = time.process_time()
    for _ in range(200):
        merged = CountingQuotientFilter.merged(own)
    assert time.process_time() - began < 2
    values, counts = np.unique(data[data >> np.uint64(51) == block], return_counts=True)
    assert ((np.uint64(block) << np.uint64(51)) | merged.fingerprints() == values).all() and (merged.counts == counts).all()


# --- 9: near duplicates


def test_unlinked_documents_of_one_template_ship_no_sets():
    rng = np.random.default_rng(9)
    shared = rng.integers(0, 2**63, 300).astype(np.uint64)
    rows = []
    for i in range(600):
        own = np.unique(np.r_[shared, rng.integers(0, 2**63, 300).astype(np.uint64)])  # similarity 1/3, far below 0.8
        rows.append((5, 0, i, len(own), i, [5], near_dedup.sketch(own).tobytes(), own))
    twin = np.r_[rows[17][-1][:-3], np.uint64(1)]
    rows.append((5, 0, 600, len(twin), 600, [5], near_dedup.sketch(np.sort(twin)).tobytes(), np.sort(twin)))
    group = pd.DataFrame(rows, columns=["key", "block", "cid", "n", "root", "keys", "data", "set"])
    likely = near_dedup.plausible_members(True, group, 80)
    assert set(group.cid[likely]) == {17, 600}
    met = group[likely].assign(data=[x.tobytes() for x in group["set"][likely]])
    assert near_dedup.links_of(True, met, 80) == [(17, 600)]


def test_likely_pairs_hold_all_plausible_ones():
    rng = np.random.default_rng(10)
    sets = []
    for size in (3, 20, 150, 900):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        sets += [np.unique(np.r_[base[: round(size * s)], rng.integers(0, 2**63, size - round(size * s)).astype(np.uint64)]) for s in (1, 0.97, 0.9, 0.8, 0.6, 0.3)]
    sketches, n = np.stack([near_dedup.sketch(x) for x in sets]), np.array([len(x) for x in sets])
    likely = near_dedup.LikelyPairs(sketches, 0.8)
    passed = 0
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        true, fast = near_dedup.may_reach(sketches[j], sketches[i], n[j], np.full(len(j), n[i]), 0.8), likely.after(i)
        assert not (true & ~fast).any()
        passed += fast.sum()
    assert passed < 0.6 * len(sets) * (len(sets) - 1) / 2


# --- 10: repeated lines


def test_runs_are_matched_with_their_first_place_and_extended(spark):
    block = [f"shared {i}" for i in range(12)]
    texts = ["\n".join(["a", *block, "b"]), "\n".join(["c", *block[2:9], "d", *block[8:], "e"]), None]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, text string, mark long").filter("text IS NOT NULL")
    found = {(r.id, r.start, r.size, r.first_id, r.first_start) for r in line_dedup.repeated_runs(rows, 3, None).collect()}
    assert found == {(1, 2, 7, 0, 4), (1, 10, 4, 0, 10)}


def test_rows_without_ids_lose_only_lines_of_their_own(spark):
    rows = [(None, "x\ny\nz\nown 1"), (None, "p\nq\nr\nown 2"), (None, "x\ny\nz\nown 1"), (3, "x\ny\nz"), (4, "p\nq\nr\ns")]
    out = sorted((str(r.doc_id), r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [("3", ""), ("4", "s"), ("None", "p\nq\nr\nown 2"), ("None", "x\ny\nz\nown 1"), ("None", "x\ny\nz\nown 1")]
