"""The pipeline's stages against their brute-force versions, one after another."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations
from math import floor

import corpus_pipeline as pipeline
import duckdb
import numpy as np
import public_tokenizers
from test_corpus_operators import brute_components, ranks

from skyloom.llm import language_id, queries


def test_stages_keep_what_brute_force_keeps(spark, sf_dir):
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(pipeline.STAGES)

    found = stage["language_id"](spark, docs, sf_dir)
    kept = {r.doc_id for r in found.collect()}
    rows = docs.collect()
    counts = plain_counts(r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5)
    unsure = 0
    for r in rows:
        share = plain_share(r.text, counts)
        if abs(share - pipeline.LEAST_PROPORTION) < 0.02:  # where the EM's last digits decide
            unsure += 1
        else:
            assert (r.doc_id in kept) == (share >= pipeline.LEAST_PROPORTION)
    assert found.columns == docs.columns and found.count() == len(kept) and unsure <= 0.02 * len(rows)

    once = stage["exact_dedup"](spark, found, sf_dir)
    first = {}
    for r in sorted(found.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == sorted(first.values())

    apart = stage["near_dedup"](spark, once, sf_dir)
    components = brute_components([(r.doc_id, r.text, None) for r in once.collect()], 5, 80)
    assert apart.columns == docs.columns and sorted(r.doc_id for r in apart.collect()) == sorted(i for i, _, _, kept in components if kept)

    mix = stage["source_mixing"](spark, apart, sf_dir)
    copies = Counter(r.doc_id for r in mix.collect())
    assert mix.columns == docs.columns and {tuple(r) for r in mix.collect()} <= {tuple(r) for r in apart.collect()}
    check_mix(apart.collect(), copies)
    assert copies == Counter(r.doc_id for r in stage["source_mixing"](spark, apart, sf_dir).collect())

    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    texts = {r.doc_id: r.text for r in apart.collect()}
    out = stage["byte_bpe"](spark, mix, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == +copies and all(r.lossless and list(r.ids) == library.encode_ordinary(texts[r.doc_id]) for r in out)

    whole = pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole) == Counter((r.doc_id, tuple(r.ids)) for r in out)


def plain_counts(rows) -> dict[str, Counter]:
    """Byte trigrams of each language's labelled texts."""
    out = {}
    for r in rows:
        if r.text is not None and r.lang is not None:
            out.setdefault(r.lang, Counter()).update(language_id.buckets_of(r.text).tolist())
    return out


def plain_share(text: str | None, counts: dict[str, Counter]) -> float:
    """Share of the main language in the best set of languages, by EM over every set with a price for each language beyond the first."""
    if not text or not any(c.isalpha() for c in text):
        return 0.0
    found = Counter(language_id.buckets_of(text).tolist())
    total = {x: sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS for x, c in counts.items()}
    p = np.array([[(c[b] + language_id.SMOOTHING) / total[x] for b in found] for x, c in counts.items()])
    n = np.array(list(found.values()), float)
    price = language_id.PENALTY * 0.5 * np.log(n.sum() + 1)
    best = (-np.inf, 0.0)
    for size in range(1, len(counts) + 1):
        for chosen in combinations(range(len(counts)), size):
            own, theta = p[list(chosen)], np.full(size, 1 / size)
            for _ in range(100):
                theta = (own * theta[:, None] / (theta @ own) * n).sum(axis=1) / n.sum()
            best = max(best, (n @ np.log(theta @ own) - price * (size - 1), theta.max()))
    return best[1]


def check_mix(rows, copies: Counter) -> None:
    """Taken words against targets that are shared out source by source, and copies against each document's even share."""
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    of = {r.doc_id: r.source for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    words = {s: sum(n for i, n in size.items() if of[i] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    left, target, free = 1.5 * sum(words.values()), {}, [s for s in sources if words[s]]
    while free:
        full = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * words[s]]
        if not full:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        for s in full:
            target[s] = 2.0 * words[s]
            left -= target[s]
        free = [s for s in free if s not in full]
    for s, aim in target.items():
        taken = sum(copies[i] * n for i, n in size.items() if of[i] == s)
        assert abs(taken - aim) <= max(n for i, n in size.items() if of[i] == s) / 2
        assert all(copies[i] in (floor(aim / words[s]), floor(aim / words[s]) + 1) for i, n in size.items() if of[i] == s and n)


def test_queries_agree_with_their_sql(spark, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        out = queries.QUERIES[name](spark, sf_dir)
        true = con.execute(sql).fetchdf()[out.columns]
        assert Counter(map(tuple, out.collect())) == Counter(tuple(x.item() if hasattr(x, "item") else x for x in r)
            for r in true.itertuples(index=False, name=None))
