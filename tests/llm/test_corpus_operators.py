"""Every operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from skyloom.llm import byte_bpe, exact_dedup, html_text, language_id, line_dedup, mixing, near_dedup, nearest, queries, sharding, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, id int, h int, found string, gone_id int, key int, c0 string, mark int, size int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n: int) -> str:
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows: nulls in every column, empty and long texts, ties, repeated rows, columns with names used inside."""
    rng = np.random.default_rng(3)
    base = [prose(rng, 60) for _ in range(12)]
    texts = [None, "", "  \t\n ", "One", "a b", base[0], base[0].replace(" ", "  ", 3), base[0].upper(), base[1], base[1] + " extra",
        *base[2:], "x\ny\nz\nx\ny\nz", "ß∂ 漢字 " * 4, prose(rng, 30_000), "12 34 !!"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, None, "zz", i, 0, "f", 1, 2, "c", 3, 4) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base[3], "en", "s1", 1, *[None] * 9), (None,) * 14]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def ranks():
    with open(public_tokenizers.path(queries.BPE_FILE), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


# --- 1: sharding


def test_sharding_places_every_row_once(docs, rows):
    out = sharding.shard_by_bytes(docs, shards=3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t
        or "").encode())) for i, t, _ in rows)
    for shard in range(3):
        own = sorted(r.slot for r in out if r.shard == shard)
        assert own == list(range(len(own)))


def test_rebalanced_bytes_are_near_equal_and_versions_stay(spark, tmp_path):
    rows = [(i, "x" * (i * 7919 % 900)) for i in range(3000)]
    path = str(tmp_path / "map")
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 24, map_path=path).groupBy("shard").sum("size").collect()
    loads = [r[1] for r in out]
    assert len(loads) == 24 and max(loads) - min(loads) <= 0.002 * sum(loads) / 24
    first, now = sharding.load_map(spark, path, 1), sharding.load_map(spark, path)
    assert (first.shard_of == sharding.SlotMap.even(24).shard_of).all() and now.version == 2
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_grown_map_moves_slots_only_into_the_new_shard():
    weight = np.random.default_rng(1).integers(0, 1000, sharding.SLOTS)
    old = sharding.SlotMap.even(24).rebalanced(weight)
    new = old.grown(weight)
    moved = old.shard_of != new.shard_of
    assert (new.shard_of[moved] == 24).all()
    assert abs(new.loads(weight)[24] - weight.sum() / 25) < 1000


# --- 2: nearest vectors


def brute_nearest(table, k, every):
    ids, vectors = np.array([i for i, _ in table]), np.array([v for _, v in table], float)
    norm = np.linalg.norm(vectors, axis=1)
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            score = vectors @ vectors[i] / (norm * norm[i])
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
            out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_nearest_reaches_the_recall_of_brute_force(spark):
    rng = np.random.default_rng(5)
    table = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((4000, 32)))]
    out = defaultdict(list)
    for r in nearest.nearest(spark.createDataFrame(table, "vec_id long, embedding array<float>"), 5, 50).orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.vec_id)
    true = brute_nearest([(i, np.float32(v)) for i, v in table], 5, 50)
    assert out.keys() == true.keys() and all(len(v) == 5 for v in out.values())
    assert sum(len({*out[q]} & {*true[q]}) for q in true) >= 0.9 * 5 * len(true)


def test_nearest_with_copies_ties_and_unusable_vectors(spark):
    a, b = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    table = [(0, a), (1, a), (2, a), (3, a), (4, b), (50, b), (7, None), (8, []), (9, [0.0, 0.0, 0.0]), (10, [1.0, None, 2.0]), (11,
        [float("nan"), 1.0, 1.0]), (12, [float("inf"), 0.0, 0.0]), (None, a), (0, a)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest.nearest(frame, 3, 50).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (50, 1, 4), (50, 2, 0), (50, 3, 1)]
    assert nearest.nearest(frame.filter("vec_id = 0"), 3, 50).count() == 0
    assert nearest.nearest(frame.limit(0), 3, 50).count() == 0


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (500, nearest.SUBSTRINGS), dtype=np.uint16)
    codes[250:] = codes[:250] ^ (rng.random(codes[:250].shape) < 0.3).astype(np.uint16)
    index = nearest.SubstringIndex(codes)
    apart = np.bitwise_count(codes[:40, None, :] ^ codes[None]).sum(axis=2)
    for radius in (0, 5, 17, 40, 104, 130):
        for q in range(40):
            assert index.within(codes[q], radius).tolist() == np.flatnonzero(apart[q] <= radius).tolist()


# --- 3: mixing


def targets(sizes: dict, share, weights):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        out = {s: 2 * sizes[s] if s in full else left * weight[s] / total for s in order}
        over = {s for s in order if s not in full and out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over


def test_mixing_meets_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(i, prose(rng, int(rng.integers(0, 40))), [None, "a", "b", "c", "d"][int(rng.integers(0, 5)) if i % 3 else 1]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(frame).collect()
    again = mixing.mix_sources(frame.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    sizes, taken, told = Counter(), Counter(), {}
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        told[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    true = targets(sizes, 1.5, (3, 1, 2))
    assert len(out) == 3000
    for s in sizes:
        assert told[s] == pytest.approx(true[s]) and abs(taken[s] - true[s]) <= 2


def test_mixed_documents_are_repeated_with_their_columns(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for r in mixing.mix_sources(docs).collect():
        taken[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +taken
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs).count() == docs.count()


# --- 4: language


def test_language_on_held_out_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    out = queries.op4_language_id(spark, sf_dir).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_language_mixtures_and_texts_without_letters(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit_language_model(table)
    text = {r.lang: r.text for r in table.filter("n_chars > 1500").select("lang", "text").collect()}
    main, score, shares = model.predict(text["en"][:1000] + " " + text["fr"][:500])
    assert main == "en" and {"en", "fr"} <= shares.keys() and 0.55 < score < 0.8
    assert model.predict(None)[0] == model.predict("")[0] == model.predict("12 - 7 !")[0] == "und"


def test_language_on_odd_rows(docs):
    model = language_id.fit_language_model(docs)
    out = {r.doc_id: r for r in language_id.identify_languages(docs.filter("doc_id IS NOT NULL"), model).collect()}
    assert out[0].lang_pred == out[1].lang_pred == "und" and out[5].lang_pred == "en" and 0 <= out[5].score <= 1
    kept = language_id.identified(docs, 0.5)
    assert kept.columns == docs.columns and {0, 1, 2} & {r.doc_id for r in kept.collect()} == set()
    assert language_id.identified(docs.limit(0), 0.5).count() == 0
    nothing = language_id.fit_language_model(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify_languages(docs, nothing).collect()} == {"und"}


# --- 5: pages


PAGES = {
    "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n  two&nbsp;three<p>Four <b>bold</b>.</article><footer>c</footer></body></html>": "A & B\nOne two three\nFour bold.",
    "": "",
    "plain words": "plain words",
    "<script>if (a < b) { document.write('<p>no</p>') }</script><style>p{}</style><p>Yes</p><!-- <p>no</p> -->": "Yes",
    "<div class='sidebar'><p>" + "side " * 60 + "</p></div><div id=content><p>" + "main " * 30 + "</p><div class=ad>buy</div><p>Short.</p></div>": "main " * 29 + "main\nShort.",
    "<article><p>Text " + "long " * 20 + "</p><div class='user-comments'><p>Reader " + "says " * 30 + "</p></div></article>": "Text " + "long " * 19 + "long",
    "<header>Site</header><form><p>Name <input></p></form><main><p>1 &lt; 2 &#233; &#x41;</p></main><aside>more</aside>": "1 < 2 é A",
    "<p class='note'>a<br>b<br><br>c</p>": "a b\nc",
    "<p>Text with <script>x = '<p>';</script>a script and <noscript>no</noscript> more.": "Text with a script and more.",
    "<div><a href=1>One</a> | <a href=2>Two</a> | <a href=3>Three</a></div><div>Body text " + "of words " * 12 + "</div><div>Copyright 2020 X</div>": "Body text " + "of words " * 11 + "of words",
    "<article>a < b and <p title='x>y'>c</p><ul><li>one<li>two</ul></article>": "a < b and\nc\none\ntwo",
}


def test_main_text_of_pages(spark):
    for page, text in PAGES.items():
        assert html_text.main_text(page) == text
    rows = [(i, None, p, i) for i, p in enumerate(PAGES)] + [(None, "u", None, 0), (3, "u", "<p>" + "x " * 200_000, 0)]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert max(r.n_chars for r in out) == 399_999 and [r.text for r in out if r.page_id is None] == [""]


def test_names_of_parts_and_wrappers_do_not_lose_the_article():
    long, side = "main " * 39 + "main", "side " * 39 + "side"
    pages = {
        f"<article><p>{long}</p><pre>x = 1 <span class='hljs-comment'># one</span> <span class='token comment'># two</span></pre></article>": f"{long}\nx = 1 # one # two",
        f"<div class='elementor-widget elementor-widget-text-editor'><p>{long}</p></div><div class='elementor-widget'><p>{side}</p></div>": f"{long}\n{side}",
        f"<a href=#c>Skip</a><div class='content-sidebar-wrap'><main><p>{long}</p></main><div class='sidebar'><p>{side}</p></div></div>": long,
        f"<p>{side}</p><div class='sidebar'><main><p>{long}</p></main></div>": long,
        f"<a href=#c>Skip</a><div class='sidebar'><article><p>{long}</p></article></div>": long,
        f"<div class='post'><div class='entry-header'><h1 class='heading'>Title</h1></div><p>{long}</p></div><div class='site-header'>Site</div>": f"Title\n{long}",
        f"<div class='site-header'>Site</div><h1 class='header'>Title</h1><p>{long}</p>": f"Title\n{long}",
        f"<a href=#c>Skip to content</a><div class='widget'><p>{long}</p></div>": f"Skip to content\n{long}",
        f"<article><p>{long}</p></article><div class='sidebar'><article><p>{side}</p></article></div>": long,
        f"<article><p>{long}</p></article><div class='comments-area'><article><p>{side}</p></article></div>": long,
        f"<article><p>{long}</p><div class='acme-related'><a href=1>One</a></div><div class='related-posts'>Two</div></article>": long,
    }
    for page, text in pages.items():
        assert html_text.main_text(page) == text, page


def test_notices_links_and_article_elements_do_not_lose_the_article():
    long, law, item = "main " * 39 + "main", "Copyright law of 1976 " + "says " * 19 + "says", "(c) 2019 was wet."
    links = [f"<a href={i}>Source number {i}</a>" for i in range(4)]
    named = [f"Source number {i}" for i in range(4)]
    cards = "".join(f"<article><a href={i}>Card {i}</a><p>Teaser {i}</p></article>" for i in range(3))
    pages = {
        f"<p>{law}</p><p>{long}</p><div>Copyright 2020 X</div>": f"{law}\n{long}",
        f"<p>{long}</p><p>{law}</p>": f"{long}\n{law}",
        f"<p>{long}</p><p>All rights reserved</p><p>{long}</p>": f"{long}\nAll rights reserved\n{long}",
        f"<p>{long}</p><ol><li>(a) one<li>(b) two<li>{item}</ol>": f"{long}\n(a) one\n(b) two\n{item}",
        f"<p>{long}</p><p>&copy; 2020 X</p><p>Made by Y</p>": f"{long}\nMade by Y",
        f"<article><p>{long}</p><ul><li>{'<li>'.join(links)}</ul></article>": "\n".join([long, *named]),
        f"<article><p>{long}</p><p>{' '.join(links)}</p><nav>{' '.join(links)}</nav></article>": f"{long}\n{' '.join(named)}",
        f"<div><p>{long}</p></div><div>{cards}</div>": long,
        f"<div>{cards}</div><div><p>{long}</p></div>": long,
        f"<div><p>{long}</p></div><article><p>Short.</p></article>": f"{long}\nShort.",
        f"<p>Beside it.</p><article><p>{long}</p></article>": long,
        f"<div><p>{long} more</p></div><div class='sidebar'><article><p>{long}</p></article></div>": f"{long} more",
    }
    for page, text in pages.items():
        assert html_text.main_text(page) == text, page


def test_main_text_of_generated_pages(spark, sf_dir):
    for r in queries.op5_html_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        assert r.text == "\n".join(filter(None, (html_text.html.unescape(re.sub(r"<[^>]*>", "", b)).strip() for b in blocks)))


# --- 6: token counts


def greedy(word: str, first: set, later: set) -> int:
    n, at = 0, 0
    while at < len(word):
        own = first if at == 0 else later
        end = next((e for e in range(len(word), at, -1) if word[at:e] in own), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_longest_match_counts_like_the_greedy_loop():
    rng = np.random.default_rng(9)
    pieces = lambda n: {"".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(n)}
    for size in (3, 8, 25):
        for _ in range(20):
            first, later = pieces(size), pieces(size)
            automaton = token_counts.LongestMatch(first, later)
            for _ in range(60):
                word = "".join(rng.choice(list("abcd"), rng.integers(1, 14), p=[0.32, 0.32, 0.32, 0.04]))
                assert automaton.count(word) == greedy(word, first, later)


def test_token_counts_agree_with_a_word_piece_library(spark, docs, rows):
    pieces = token_counts.read_pieces(public_tokenizers.path(queries.PIECE_FILE))
    vocabulary = {p: i for i, p in enumerate([*pieces[0], *("##" + p for p in pieces[1] if p), "[UNK]"])}
    library = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**9))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    got = Counter((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(docs, pieces).collect())
    true = Counter()
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        ids = library.encode(" ".join(token_counts.WORD_START + w for w in words)).ids
        true[i, len(words), len(ids), ids.count(vocabulary["[UNK]"])] += 1
    assert got == true
    assert token_counts.token_counts(docs.limit(0), pieces).count() == 0


# --- 7: exact duplicates


def test_exact_dedup_against_brute_force(docs, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    groups = defaultdict(list)
    for (i, _, _), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    true = Counter((i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _, _), t in zip(rows, norm, strict=True))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()) == true
    stay = exact_dedup.deduplicated(docs)
    assert stay.columns == docs.columns and Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in stay.collect()) == Counter(groups.keys())
    assert exact_dedup.deduplicated(docs.limit(0)).count() == 0


def test_quotient_filters_merge_without_loss():
    from skyloom.llm.quotient_filter import CountingQuotientFilter

    rng = np.random.default_rng(8)
    data = rng.choice(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2), 20_000)
    merged = CountingQuotientFilter.merged([CountingQuotientFilter.of(10, x) for x in np.array_split(data, 7)])
    values, counts = np.unique(data, return_counts=True)
    assert (merged.fingerprints() == values).all() and (merged.counts == counts).all()
    assert (merged.repeated()[0] == values[counts > 1]).all()


# --- 8: byte-level BPE


def test_bpe_is_the_librarys_and_round_trips(docs, rows):
    path, library = public_tokenizers.path(queries.BPE_FILE), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=ranks(), special_tokens={})
    bpe = byte_bpe.ByteBPE(path, public_tokenizers.PATTERN)
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 5, 9, 40, 400):
        for _ in range(60):
            piece = bytes(rng.integers(0, 256, n, dtype=np.uint8)) if n % 2 else "".join(rng.choice(list("aeinrst é漢=-\n"), n)).encode()
            assert bpe.encode_piece(piece) == library._encode_single_piece(piece)
    true = Counter()
    for i, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        true[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in byte_bpe.encode_digests(docs, path, public_tokenizers.PATTERN).collect()) == true
    out = byte_bpe.encoded(docs, path, public_tokenizers.PATTERN).collect()
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in out) and Counter(r.n_tokens for r in out) == Counter(n for _, n, _, _ in true.elements())
    assert byte_bpe.encoded(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


# --- 9: near duplicates


def shingles(text, words):
    own = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    k = min(words, len(own))
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()


def brute_components(rows, words, percent):
    sets = [shingles(t, words) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    lowest = {}
    for i, (doc_id, _, _) in enumerate(rows):
        root = find(i)
        lowest[root] = doc_id if lowest.get(root) is None else min(lowest[root], doc_id if doc_id is not None else 1 << 60)
    return [(i, len(s), lowest[find(n)], i == lowest[find(n)]) for n, ((i, _, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_against_brute_force(spark, docs, rows, words, percent):
    assert Counter(tuple(r)[:4] for r in near_dedup.near_dedup(docs, words=words, percent=percent).collect()) == Counter(brute_components(rows, words, percent))
    rng = np.random.default_rng(7)
    table = []
    for base in range(40):  # chains of small edits, so that many pairs lie near the threshold
        text = rng.choice([f"{w}{n}" for w in WORDS for n in range(20)], 80).tolist()
        for _ in range(6):
            table.append((len(table), " ".join(text), None))
            text[int(rng.integers(0, 80))] = f"new{len(table)}"
            text[int(rng.integers(0, 80))] = f"new{len(table)}"
    frame = spark.createDataFrame(table, "doc_id long, text string, source string")
    assert Counter(tuple(r)[:4] for r in near_dedup.near_dedup(frame, words=words,
        percent=percent).collect()) == Counter(brute_components(table, words, percent))


def test_near_dedup_leaves_one_of_each_group(docs, rows):
    stay = near_dedup.deduplicated(exact_dedup.deduplicated(docs).filter("doc_id IS NOT NULL"))
    assert stay.columns == docs.columns
    left = {r.doc_id for r in stay.collect()}
    assert 7 not in left and 9 not in left and {5, 8} <= left
    assert near_dedup.deduplicated(docs.limit(0)).count() == 0


def test_sketch_estimates_are_near():
    rng = np.random.default_rng(11)
    for shared in (0, 500, 900, 1000):
        a = rng.integers(0, 2**63, 1000).astype(np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, 1000 - shared).astype(np.uint64)])
        n = np.array([1000.0])
        found, _ = near_dedup.estimated(near_dedup.sketch(a)[None], near_dedup.sketch(b)[None], n, n)
        assert abs(found[0] - shared / (2000 - shared)) < 0.15


# --- 10: repeated lines


def brute_lines(rows, run):
    seen, gone = {}, defaultdict(set)
    lines = {}
    for i, text, _ in rows:
        lines[i] = [] if text is None else text.split("\n")
    for i in sorted(lines):
        for s in range(len(lines[i]) - run + 1):
            key = tuple(lines[i][s : s + run])
            if seen.setdefault(key, (i, s)) != (i, s):
                gone[i] |= set(range(s, s + run))
    return {i: None if t is None else "\n".join(x for n, x in enumerate(lines[i]) if n not in gone[i]) if gone[i] else t for i, t, _ in rows}


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(12)
    pool = [prose(rng, 4) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(0, 25))), None) for i in range(150)]
    block = "\n".join(f"shared {i}" for i in range(9))
    rows += [(200 + i, f"own {i}\n{block}\nend {i}", None) for i in range(30)] + [(300, None, None), (301, "", None), (302, "\n\n\n\n\n", None)]
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    true = brute_lines(rows, line_dedup.RUN)
    assert {i: r.text for i, r in out.items()} == true
    assert out[205].n_removed == 9 and out[200].n_removed == 0


def test_line_dedup_on_odd_rows(docs):
    out = line_dedup.line_dedup(docs).collect()
    assert len(out) == docs.count() and {r.n_removed for r in out if r.doc_id == 5} == {0}
    assert [(r.text, r.n_lines, r.n_removed) for r in out if r.text and r.text.startswith("x\n")] == [("x\ny\nz", 6, 3)]
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_of_long_passages_on_one_or_two_lines(spark):
    rng = np.random.default_rng(13)
    pool = [prose(rng, int(n)) for n in rng.integers(15, 60, 12)] + [prose(rng, n) for n in (50, 51, 25, 26)]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(1, 7))), None) for i in range(60)]
    long, half, other = prose(rng, 168), prose(rng, 30), prose(rng, 30)
    rows += [(100, long, None), (101, long, None), (102, f"{half}\n{other}", None), (103, f"own\n{half}\n{other}\nend", None), (104, half,
        None), (105, None, None), (106, "", None)]
    seen, gone = set(), defaultdict(set)
    lines = {i: [] if t is None else t.split("\n") for i, t, _ in rows}
    for i, own in lines.items():
        for size in (1, 2, 3):
            for s in range(len(own) - size + 1):
                key = tuple(own[s : s + size])
                if size == 3 or len(" ".join(key).split()) > 50:
                    gone[i] |= set(range(s, s + size)) if key in seen else set()
                    seen.add(key)
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), words=50).collect()}
    assert {i: r.text for i, r in out.items()} == {i: None if t is None else "\n".join(x for n, x in enumerate(lines[i])
        if n not in gone[i]) for i, t, _ in rows}
    assert out[101].text == "" and out[103].text == "own\nend" and out[104].n_removed == 0
