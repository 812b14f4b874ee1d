"""Cases that once went wrong: equal rows in one shard, paragraphs lost by their names, probing to no end, samples sorted in one task."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from skyloom.llm import nearest, queries, sharding
from skyloom.llm.html_text import main_text

SENTENCE = "This is a full sentence with enough characters in it to be an ordinary line of an article that nobody wants to lose at all."


def test_equal_rows_spread_over_all_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 300)
    rows = [(None, "the same text")] * 2000 + [(5, "another")] * 500 + [(i, None) for i in range(100)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    loads = Counter()
    for r in out:
        loads[r.shard] += r.size
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 21 + 8
    for shard in loads:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    again = sharding.shard_by_bytes(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7), 8).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in again) == Counter((r.doc_id, r.text_crc32, r.shard) for r in out)


def test_a_map_version_is_a_folder_that_one_job_can_store(spark, tmp_path):
    path = str(tmp_path / "map")
    first = sharding.SlotMap.even(4, 64)
    sharding.store_map(spark, first, path)
    with pytest.raises(ValueError, match="stored"):
        sharding.store_map(spark, first, path)
    assert (tmp_path / "map" / "version=1").is_dir() and sharding.load_map(spark, path).shards == 4


@pytest.mark.parametrize("name", ["search", "share", "modal", "widget", "ad", "comment"])
def test_paragraphs_of_an_article_stay_whatever_their_names(name):
    page = f"<article><h1>Title</h1><p>{SENTENCE}</p><p class='{name}'>{SENTENCE} Again.</p><p>{SENTENCE}</p></article>"
    assert main_text(page) == f"Title\n{SENTENCE}\n{SENTENCE} Again.\n{SENTENCE}"


def test_paragraphs_of_links_with_such_names_go():
    page = f"<article><p>{SENTENCE}</p><p class='share'><a href=1>Here</a> <a href=2>There</a></p><p>{SENTENCE}</p></article>"
    assert main_text(page) == f"{SENTENCE}\n{SENTENCE}"


BODY = f"<p>{SENTENCE}</p>" * 3
LINKS = ("Report of the river board, spring of 2019", "Letter from the mayor to the council", "Notes on water and its many uses")


@pytest.mark.parametrize(("page", "first", "last"), [
    (f"<body>{BODY}<ul>{''.join(f'<li><a href={i}>{t}</a></li>' for i, t in enumerate(LINKS))}</ul></body>", SENTENCE, LINKS[2]),
    (f"<body><div>{BODY}<p>Copyright 2020 law changed much for authors in the land.</p></div></body>", SENTENCE, "Copyright 2020 law changed much for authors in the land."),
    (f"<body><div>{BODY}<p>Copyright 2020 Example Media Ltd</p></div></body>", SENTENCE, SENTENCE),
    (f"<body><div><h1>Title</h1></div><div class=ad>Buy this now, please</div>{BODY}<div class=ads>Buy more</div><p>Bye, short end.</p></body>", "Title", "Bye, short end."),
    (f"<body>{BODY}<p>x <math>y</math> z</p></body>", SENTENCE, "x y z"),
    (f"<body><ul>{''.join(f'<li><a href={i}>{t}</a></li>' for i, t in enumerate(('Home', 'About us', 'News')))}</ul>{BODY}</body>", SENTENCE, SENTENCE),
])
def test_pages_without_an_article_keep_their_text(page, first, last):
    lines = main_text(page).split("\n")
    assert lines[0] == first and lines[-1] == last and lines.count(SENTENCE) == 3 and not any("Buy" in x for x in lines)


def test_recall_of_the_query_on_the_test_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding is not None}
    ids = sorted(i for i, v in rows.items() if np.isfinite(v).all() and v.any())
    unit = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    found = {}
    for r in queries.op2_multi_index_hashing(spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = n = 0
    for q in (i for i in ids if i % 50 == 0):
        likeness = unit @ unit[ids.index(q)]
        likeness[ids.index(q)] = -2
        true = {ids[k] for k in np.argsort(-likeness, kind="stable")[:5]}
        hit, n = hit + len(true & found[q]), n + 5
    assert n and hit >= 0.9 * n


def test_probing_is_left_out_where_it_settles_nothing(spark, monkeypatch):
    calls = []
    own = nearest.candidates
    monkeypatch.setattr(nearest, "candidates", lambda *a: calls.append(1) or own(*a))
    rng = np.random.default_rng(0)
    noise = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 64)))]
    assert nearest.nearest(spark.createDataFrame(noise, "vec_id long, embedding array<float>")).count() == 12 * 5 and not calls
    centres = rng.normal(size=(60, 64))
    near = [(i, [float(x) for x in centres[i % 60] + rng.normal(0, 0.03, 64)]) for i in range(720)]
    assert nearest.nearest(spark.createDataFrame(near, "vec_id long, embedding array<float>")).count() == 15 * 5 and calls
