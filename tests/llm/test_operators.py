"""Every operator against brute force, exact round trips or known answers, and on odd rows: NULLs, empty and long texts,
ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from argweave.llm import boosting, jaccard, mtree, ngrams, packing, pieces, rules, toxicity, urls, wrappers
from argweave.llm.common import one_text, text_slices, within, words_of
from argweave.llm.eliasfano import EliasFano, encode
from argweave.llm.oracle import ORACLE
from argweave.llm.queries import QUERIES
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n ", "one", "a b  c\n\nd", "ÄÖ ü\tß", "word " * 5000, "same text of six words here", "same text of six words here"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "clash", k) for k, t in enumerate(ODD)] + [(None, "no id here", "clash", 0), (3, "one", "clash", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(9)], "doc_id long, quality int, toxic int")


def test_words_are_runs_of_other_than_ascii_space():
    texts = [t or "" for t in ODD] + ["x\x0by z", "a\x1cb"]
    distinct, ids, ends = words_of(pa.array(texts, pa.large_string()))
    names = distinct.to_pylist()
    assert [[names[k] for k in ids[a:b]] for a, b in zip(ends[:-1], ends[1:])] == [WORD.findall(t) for t in texts]


def test_slices_lose_no_row():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 90, 0, 3, 4)] + [None]})
    parts = list(text_slices(iter([batch]), limit=10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (7, 10), (3000, 10**6), (80_000, 2**62), (5000, 6000), (5000, 10)])
def test_elias_fano(n, top):
    chance = np.random.default_rng(n)
    values = np.sort(chance.integers(0, top, n).astype(np.uint64))
    dense = np.concatenate([values, values.max(initial=0) + np.uint64(1) + np.arange(3000, dtype=np.uint64) * np.uint64(3)])
    for held in (values, dense):
        found = EliasFano(np.frombuffer(encode(held), np.uint8))
        assert (found.access(np.arange(len(held))) == held).all()
        asked = np.concatenate([held, chance.integers(0, top, 50).astype(np.uint64), np.array([top + 10**5], np.uint64)])
        first = {int(v): k for k, v in reversed(list(enumerate(held)))}
        assert found.find(asked).tolist() == [first.get(int(v), -1) for v in asked]


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for t in "documents embeddings pages benchmark labels".split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), connection.sql(ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda df: sorted(map(tuple, df[columns].astype(str).values))
    assert key(got) == key(want)


def test_boosting_learns_and_scores_every_row(spark, odd, labels):
    chance = np.random.default_rng(1)
    x = chance.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.grow(x[:1500], y[:1500])
    assert ((boosting.probability(trees, x[1500:]) >= 0.5) == y[1500:]).mean() > 0.9
    scored = boosting.classify(odd, labels, F.col("doc_id") < 6).collect()
    assert len(scored) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert boosting.classify(odd.limit(0), labels, F.lit(True)).count() == 0


def test_rules_counts_equal_brute_force(spark, odd, labels):
    judged = rules.judge(odd, rules.fit(odd, labels), "new_").collect()
    assert len(judged) == 11
    for r in judged:
        text = r.text or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r.new_n_words, r.new_word_chars, r.new_n_symbols, r.new_n_dup_lines, r.new_n_repeat_words) == want
        assert r.new_base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and r.kept == "clash"
        assert not (r.new_base_failed and r.new_kept)


def test_viterbi_finds_the_best_sequence():
    chance = np.random.default_rng(3)
    field = rules.Field(chance.normal(size=4), chance.normal(size=2), chance.normal(size=(2, 2)))
    features, ends = chance.normal(size=(14, 4)), np.array([0, 5, 5, 6, 14])
    got = rules.decode(field, features, ends)
    for a, b in zip(ends[:-1], ends[1:]):
        gain = features[a:b] @ field.weights
        def worth(s):
            return (field.first[s[0]] if s else 0) + sum(gain[k] for k in range(len(s)) if s[k]) + sum(field.moves[s[k - 1], s[k]] for k in range(1, len(s)))
        best = max((tuple(n >> k & 1 for k in range(b - a)) for n in range(2 ** (b - a))), key=worth)
        assert tuple(got[a:b].astype(int)) == best


def test_packing_is_gapless_whole_and_exact(spark, odd):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.pack_documents(odd, packing.vocabulary_path(), 64).collect()
    texts = {}
    for row in odd.collect():
        texts.setdefault(row.doc_id, []).append([*coder.encode(row.text or "", add_special_tokens=False).ids, 0])
    for doc, held in texts.items():
        want = sorted(
            (j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            for ids in held
            for cuts in [[0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)]]
            for j, (a, b) in enumerate(zip(cuts, cuts[1:]))
        )
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc) == want
    bins = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 64 and len(bins) <= -(-sum(bins.values()) // 64) + 1


def test_swaps_improve_best_fit():
    chance = np.random.default_rng(5)
    for _ in range(20):
        sizes = [int(x) for x in chance.integers(20, 70, 60)]
        packed = packing.pack_group(sizes, 100)
        assert sorted(k for b in packed for k in b) == list(range(60)) and max(sum(sizes[k] for k in b) for b in packed) <= 100
        assert len(packed) <= len(packing.best_fit(sizes, 100))


def test_language_model_equals_brute_force(spark, odd):
    shape = ngrams.train(odd, F.coalesce(F.col("doc_id"), F.lit(0)) != 4)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    rows = [(r.doc_id, [*WORD.findall(low(r.text)), ""]) for r in odd.collect()]
    training = [t for d, t in rows if d != 4]
    c = Counter(w for t in training for w in t)
    pairs = Counter(p for t in training for p in zip(["", *t[:-1]], t))
    triples = Counter(p for t in training for p in zip(["", *t[:-2]], t[:-1], t[1:]))
    after = Counter(p[:2] for t in training for p in zip(["", *t[:-2]], t[:-1], t[1:]))
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda u, w: (pairs[u, w] + ngrams.MU * p(w)) / (c[u] + ngrams.MU)
    p3 = lambda u, x, w: (triples[u, x, w] + ngrams.MU3 * p2(x, w)) / (after[u, x] + ngrams.MU3)
    for u, x in [("", "one"), ("a", "b"), ("word", "word"), ("never", "a"), ("never", "seen")]:
        assert abs(sum(p3(u, x, w) for w in c) + 0.5 / (n + 0.5 * (v + 1)) - 1) < 0.01  # the rest: unknown words
    want = []
    for d, t in rows:
        full = math.log10(p2("", t[0])) + sum(math.log10(p3(*x)) for x in zip(["", *t[:-2]], t[:-1], t[1:]))
        want.append((str(d), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p(w)) for w in t), full))
    got = [(str(r.doc_id), *r[1:]) for r in ngrams.score(odd, shape).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * max(1, -b[4]) and abs(a[5] - b[5]) < 1e-3 * b[1]


def test_language_model_over_many_shards(spark, monkeypatch):
    """Texts whose words, pairs and triples lie in many shards, of which few may be open, score as in one."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    got = {}
    for size, held in ((1 << 30, 256), (20_000, 2)):
        monkeypatch.setattr(ngrams, "SHARD_BYTES", size)
        monkeypatch.setattr(ngrams, "OPEN", held)
        got[size] = {r.doc_id: r.score for r in ngrams.score(docs, ngrams.train(docs, F.col("doc_id") % 5 != 1)).collect()}
    one, many = got.values()
    assert one.keys() == many.keys() and all(abs(one[d] - many[d]) < 1e-6 * abs(one[d]) for d in one)


def test_language_model_without_training_rows(spark, odd):
    for usable, docs in ((F.lit(False), odd), (F.lit(True), odd.limit(0))):
        rows = ngrams.score(docs, ngrams.train(docs, usable)).collect()
        assert len(rows) == docs.count() and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)


def test_sentence_pieces_equal_the_library():
    import sentencepiece

    vocabulary = pieces.Vocabulary(pieces.model_path())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = [t or "" for t in ODD] + ["  a  b ", " ", "   ", "日本語 🙂", "don't 12,345!!", "x" * 200]
    ids, places = vocabulary.encode(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        own = ids[places[k] : places[k + 1]]
        assert own.tolist() == library.encode(t) and vocabulary.decode(own) == t


def _similar(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(text or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def test_jaccard_join_equals_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)  # large buckets are dealt into blocks
    base = [f"w{k}" for k in range(120)]
    near = [(100 + k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(0, 60, 2)]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + near
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = Counter(i for i, _ in _similar(rows))
    got = sorted((str(r.doc_id), r.links) for r in jaccard.join(docs).collect())
    assert got == sorted((str(d), links[k]) for k, (d, _) in enumerate(rows))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sum((d or 0) >= 100 for d in ids) == 1 and ids.count(3) == 1 and (7 in ids) and (8 not in ids) and {0, 1, 2} <= set(ids)
    assert jaccard.join(docs.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    chance = np.random.default_rng(2)
    rows = [(k, [float(x) for x in chance.normal(size=6)]) for k in range(400)] + [(k, [0.5] * 6) for k in range(400, 460)]
    rows += [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (550, [])]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5).collect()
    sound = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows[:460]}
    want = []
    for q in range(0, 460, 50):
        best = sorted((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("times", [2, 3, 9])
def test_top_k_of_repeated_rows_equals_brute_force(spark, times):
    chance = np.random.default_rng(times)
    rows = [(k, [float(x) for x in chance.normal(size=4)]) for k in range(1000)] * times
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 25 == 0, 5).collect()
    ids = np.array([i for i, _ in rows])
    whole = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)).astype(int)
    want = []
    for q in range(0, 1000, 25):
        others = ids != q
        best = sorted(zip(-(whole[others] @ whole[q]), ids[others]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == want


def test_urls_confirm_strings_and_prefer_the_longest(spark):
    rules_in = [("net/", "block"), ("a.net/x/", "allow"), (None, "block"), ("net/", "block")]
    pages = [(1, "http://A.net/x/1"), (2, "http://b.a.net/y"), (3, "http://a.net"), (4, None), (5, "a.net/x/"), (6, "s://na.org/?//net/")]
    judged = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules_in, "rule string, verdict string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert got == {
        1: ("a.net", "/x/1", "a.net/x/", "allow"), 2: ("b.a.net", "/y", "net/", "block"), 3: ("a.net", "", None, "allow"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("na.org", "/", None, "allow"),
    }


def test_main_text_of_pages(spark):
    shell = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>Menu</ul></nav><h2>Daily News</h2><div class='ad'>Buy {0}</div>{1}<div id=comments><p>Nice {0}</p></div><footer>&copy; f</footer></body></html>"
    rows = [(k, "http://h.org/1", shell.format(k, f"<article><h1>Head {k}</h1><p><b>Caf&eacute;  {k}<br>x<p>two\n words&nbsp;{k}</p></article>")) for k in range(12)]
    rows += [(50, "http://h.org/2", None), (51, None, "<p>free &am"), (52, "http://z.org/", ""), (53, "http://plain.org", "<div>one<p>two</div>three<")]
    got = {r.page_id: r for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].text == f"Head {k}\nCafé {k} x\ntwo words {k}" and got[k].n_chars == len(got[k].text) for k in range(12))
    assert [got[k].text for k in (50, 51, 52, 53)] == ["", "free &am", "", "one\ntwo\nthree<"]


def test_constant_nodes_of_a_host_are_template(spark):
    rows = [(k, "http://h.org/", f"<div class=body><h2>Our daily page</h2><p>Text number {k}</p></div>") for k in range(10)]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Text number {r.page_id}" for r in got)


def test_pages_without_article_keep_their_text_beside_pages_with_one(spark):
    rows = [(k, "http://h.org/", f"<article><p>In {k}</p></article><div>Out {k}</div>" if k % 2 else f"<div class=content><p>Text {k}</p></div>") for k in range(12)]
    rows += [(20, None, "<main>One</main><div>two</div>"), (21, None, "<div>Three</div>"), (22, "odd", "<article><nav>no</nav></article><p>Four</p>")]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"In {k}" if k % 2 else f"Text {k}" for k in range(12)}, 20: "One", 21: "Three", 22: "Four"}


def _texts(pages: list[str]) -> list[str]:
    """The texts of pages of one host."""
    trees = [wrappers.parse(p) for p in pages]
    wrapper = functools.reduce(wrappers._joined, [wrappers._page_wrapper(t) for t in trees])
    return ["\n".join(wrappers.extract(t, wrapper)) for t in trees]


def test_names_of_content_are_no_template():
    kept = ["<h2 id='search'>", "<h2 id='comments-in-python'>", "<section id='related-work'>", "<section id='social-policy'>", "<div class='alert-study'>", "<p class='side'>", "<div data-role='navigation' class='has-sidebar'>", "<div class='post-header'>"]
    gone = ["<div class='ad'>", "<div class='x ad-slot-3'>", "<ul class=site_nav>", "<section class='comment-list'>", "<div role=alert>", "<div class='cookie-notice'>", "<aside>", "<p role=navigation>"]
    close = lambda tag: f"</{re.match('<([a-z0-9]+)', tag)[1]}>"
    body = "".join(f"{tag}{k}{close(tag)}" for k, tag in enumerate(kept + gone))
    assert _texts([f"<article>{body}</article>"]) == ["\n".join(str(k) for k in range(len(kept)))]
    assert _texts(["<div id=comments>no</div><div id=site-header>no</div><div id=header-files>yes</div>"]) == ["yes"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a<svg class=x />b<math/>c</p><p>d", "abc\nd"), ("<object data=x>a<p>b", "a\nb"), ("<video>a</video><canvas>b<p>c", "ab\nc"), ("<audio>a<p>b", "a\nb"),
        ("<p>E = <math><mi>m</mi></math><noscript>n</noscript>", "E = mn"), ("<a title=it's>a</a><p>b's<p>c", "a\nb's\nc"), ('<p class="x"">a</p><p>b "c"', 'a\nb "c"'),
        ('<p title="a>b" id=\'c>d\'>e', "e"), ('<p title="a>b', "b"), ("<!-->a<!-- b -->c", "ac"), ("<script>a</script>b<style>c<p>", "b"),
    ],
)
def test_text_is_not_cut_at_embedded_elements_or_quotes(html, text):
    assert _texts([html]) == [text] and _texts([f"<article>{html}"]) == [text]


def test_long_runs_of_quotes_take_linear_time():
    assert _texts(["<p " + "=\"a\" ='b' " * 100_000 + ">x</p><p " + "= " * 100_000]) == ["x"]


def test_text_on_some_pages_only_is_no_template():
    lead = [f"<{tag}>{'Lead' if k in (3, 5) else ''}<p>Text {k}</p></{tag}>" for tag in ("article", "div") for k in range(9)]
    for pages in (lead[:9], lead[9:]):
        assert _texts(pages) == [f"Lead\nText {k}" if k in (3, 5) else f"Text {k}" for k in range(9)]


def test_copies_of_an_article_are_no_template():
    shell = "<!-- ad {0} --><script>track({0})</script><div class=ad>Buy {0}</div>{1}<div id=comments>Nice {0}</div>"
    for body in ("<h1>Head</h1><div>One</div><section>Two</section>", "<article><h1>Head</h1><div>One</div><section>Two</section></article>"):
        assert _texts([shell.format(k, body) for k in range(12)]) == ["Head\nOne\nTwo"] * 12
    counted = "<article><h1>Head</h1><div>One</div><section>Views: {0}</section></article>"
    assert _texts([counted.format(k) for k in range(12)]) == [f"Head\nOne\nViews: {k}" for k in range(12)]


def test_like_siblings_are_told_apart_by_elements_left_out():
    """On every other page a section with a small form stands before the template's section with a large one."""
    large = "<form>" + "".join(f"<ul class=u{k}><li>x</li></ul>" for k in range(6)) + "</form>"
    template = f"<section><p>Terms apply</p>{large}</section>"
    pages = [f"<section><p>First {k}</p><form>y</form></section><h2>Title {k}</h2>{template}" if k % 2 else f"{template}<h2>Title {k}</h2>" for k in range(12)]
    assert _texts(pages) == [f"First {k}\nTitle {k}" if k % 2 else f"Title {k}" for k in range(12)]


def test_wrappers_stay_as_small_as_a_page():
    name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    pages = [f"<h3>Our page</h3><div id=x{name(k)}><section class=y{name(k)}>Text {k}</section></div><div id=post-{k}><div>Signed</div><div>b<i>{k}</i></div></div>" for k in range(60)]
    trees = [wrappers.parse(p) for p in pages]
    wrapper = functools.reduce(wrappers._joined, map(wrappers._page_wrapper, trees))
    nodes = lambda n: 1 + sum(map(nodes, n[3]))
    assert nodes(wrapper["tree"]) <= max(nodes(wrappers._plain(t)) for t in trees)
    assert _texts(pages) == [f"Text {k}\nSigned\nb{k}" for k in range(60)]
    headed = [f"<div id=post-{k}><h3>Our page</h3><p>Text {k}</p></div>" for k in range(20)]
    assert _texts(headed) == [f"Text {k}" for k in range(20)]


def test_deep_pages(spark):
    shell = "<h3>Our page</h3>{}a{}<p>b</p><nav><div>no</div></nav><article><p>c"
    deep = [shell.format(k, "<div>" * 5000) + "</article></div>d" for k in range(9)] + ["<section><ul><li>" * 3000 + f"{k}" for k in range(9)]
    rows = [(k, f"http://{k // 9}.org/", p) for k, p in enumerate(deep)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "c" if k < 9 else str(k - 9) for k in range(18)}
    assert _texts(["<div>" * 5000 + "a<div>b</div>c<div class=ad><div>no</div></div>d"]) == ["a\nb\nc\nd"]


def test_simple_tree_matching():
    leaf = lambda label: [label, "", 1, []]
    a, b = ["r", "", 1, [leaf("x"), leaf("y"), leaf("z")]], ["r", "", 1, [leaf("x"), leaf("z"), leaf("y")]]
    assert wrappers.match(a, b) == 3 and wrappers.match(a, leaf("q")) == 0
    assert [n[0] for n in wrappers.merge(a, b)[3]].count("x") == 1


def test_toxicity_learns_from_positive_and_unlabelled(spark, odd, labels):
    chance = np.random.default_rng(4)
    plain = [f"word{k}" for k in range(300)]
    texts = [" ".join(chance.choice(plain, 60)) + (f" nasty{k % 9}" if k % 5 == 0 else "") for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(0, 400, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, marks, F.col("doc_id") < 400)).where("doc_id >= 400").collect()
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in scored) >= 195
    for model in (None, toxicity.fit(odd, labels, F.lit(True))):
        rows = toxicity.score(odd, model, "new_").collect()
        assert len(rows) == 11 and all(0 <= r.new_score <= 1 and r.kept == "clash" for r in rows)


def test_risk_and_slopes_equal_a_plain_loop():
    chance = np.random.default_rng(9)
    positive = np.arange(40) < 15
    loss = lambda z: 1 / (1 + math.exp(z))

    def risk(f, prior, rest):
        mean = lambda part, sign: sum(loss(sign * x) for x in f[part]) / part.sum()
        return prior * mean(positive, 1), (1 - prior) / (1 - rest) * (mean(~positive, -1) - rest * mean(positive, -1))

    for shift, prior, rest in ((0.0, 0.3, 0.2), (-3.0, 0.3, 0.0), (3.0, 0.4, 0.4)):
        f = chance.normal(shift * np.where(positive, -1, 1), 1)
        for turn in (1, -1):  # the bracket above and below 0
            f = f * turn
            first, bracket = risk(f, prior, rest)
            got, slope = toxicity.slopes(f, positive, prior, rest)
            assert abs(got - bracket) < 1e-12
            for k in range(40):
                near = f.copy()
                near[k] += 1e-5
                a, b = risk(near, prior, rest)
                want = (a + b - first - bracket) / 1e-5 if bracket >= 0 else (bracket - b) / 1e-5
                assert abs(slope[k] - want) < 1e-5
    assert toxicity.slopes(np.where(positive, 9.0, -9.0), positive, 0.3, 0.3)[0] < 0


def test_fits_stay_within_bounds_and_repeat(spark, monkeypatch):
    rows = [(k % 50, f"line {k}\n" * (k % 7 + 1)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.text for r in one_text(docs, "doc_id").collect()}
    again = {r.doc_id: r.text for r in one_text(docs.orderBy(F.desc("text")).repartition(3), "doc_id").collect()}
    assert one == again and len(one) == 50
    part = within(one_text(docs, "doc_id"), F.octet_length("text"), 700).collect()
    assert 0 < sum(len(r.text) for r in part) <= 700 and all(one[r.doc_id] == r.text for r in part)
    assert within(one_text(docs, "doc_id"), F.octet_length("text"), 0).count() == 0


def test_pipeline_keeps_columns_and_takes_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("kept", F.lit(1)).withColumn("_score", F.lit("x"))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert all(r.kept == 1 and r["_score"] == "x" for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert 0 < docs.count() < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", ["op1_quality_classifier", "op2_html_extraction", "op3_quality_rules", "op6_lm_scoring", "op8_sentencepiece", "op10_toxicity"])
def test_query_gives_a_row_for_each_row(spark, name):
    got = QUERIES[name](spark, FOLDER)
    source = "pages" if name.startswith("op2") else "documents"
    assert got.count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()
