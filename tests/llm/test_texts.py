"""Extraction, language, toxicity, language model and decontamination."""

import math
import os
import random
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from lexloom.llm import decontaminate as dc
from lexloom.llm import html_extract as he
from lexloom.llm import lang_cnn, suffix_lm, toxicity
from lexloom.llm.wordhash import chunks

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EDGE = "doc_id long, text string, score double"


def test_html_blocks_and_labels(spark):
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">buy now it is cheap.</div><article><h1>Head &amp; title</h1><p><b>One\n  two.<br><p>Three &lt;four&gt; <i>five</i>.</p><script>no()</script></article><footer>&copy; me &middot; all rights.</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<"), (5, "u", page)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in he.extract(df).collect()}
    assert got[1].text == got[5].text == "Head & title\nOne two.\nThree <four> five."
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[2].url is None
    assert he.extract(df.limit(0)).count() == 0


def test_html_unclosed_elements_lose_no_text():
    def texts(page):
        return [b.text for b in he.blocks(page)]

    assert texts("<head><title>t</title><body><article><p>One</p></article>") == ["One"]
    assert texts("<head><meta charset=x><title>t<link rel=y><style>p{}</style><p>One<p>Two") == ["One", "Two"]
    assert texts("<head><title>t<p>One") == ["One"]
    assert texts('<p>One <svg class="i"/> two</p><p>Three</p>') == ["One", "two", "Three"]
    for tag in ("svg", "iframe", "object", "noscript", "template"):
        assert texts(f"<p>One</p><{tag} a=b><p>Two</p><{tag}><p>Three") == ["One", "Two", "Three"]
        assert texts(f"<p>One</p><{tag}>x</{tag}><p>Two") == ["One", "Two"]
    for cut in ("<script>x", "<style>x", "<!-- x"):
        assert texts(f"<p>One</p>{cut}<p>Two") == ["One"]


def test_html_features_read_the_middle_of_a_block():
    ends = "word " * 60
    one, two = (he.features([he.Block(f"{ends}{middle} {ends}end", ("p",))])[0] for middle in ("cookie consent notice " * 9, "river valley morning " * 9))
    assert len(ends) > 240 and not np.allclose(one[he.PATH_DIM : he.PATH_DIM + he.WORD_DIM], two[he.PATH_DIM : he.PATH_DIM + he.WORD_DIM])


def test_html_held_out_generated_pages():
    model, right, total = he.trained(), 0, 0
    for page, labels in he.page_samples(150, seed=77):
        cut = he.blocks(page)
        assert len(cut) == len(labels)
        if cut:
            right += int((model.main([cut])[0] == np.array(labels, bool)).sum())
            total += len(labels)
    assert right / total > 0.98


def sample(spark, n=400):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(f"doc_id < {n}")


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lang_cnn.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    own = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(own) / len(own) > 0.97


def test_language_edges(spark):
    model = lang_cnn.ByteCnn(["a", "b"])
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "12 !", 1.0), (4, "é", 1.0), (4, "é", 1.0), (None, "xyz " * 50000, 1.0)], EDGE)
    got = lang_cnn.predict(df, model).collect()
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)] == [("und", 0.0)] * 3
    assert len({r.lang_pred for r in got if r.doc_id == 4}) == 1 and sum(r.doc_id is None for r in got) == 1
    assert {r.lang_pred for r in lang_cnn.predict(df, None).collect()} == {"und"}
    assert lang_cnn.predict(df.limit(0), model).count() == 0
    kept = lang_cnn.accept(df, model, least=0.0)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {4, None}


def test_toxicity_grades(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = [word() for _ in range(40)] + (["NASTY!", "vilething"][: 1 + i % 2] * (1 + i % 3) if bad else [])
        r.shuffle(text)
        rows.append((i, " ".join(text), 0.0))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, EDGE), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.severity(docs, lab).collect()}
    assert sum(got[i].toxic == bool(y) for i, y in labels) >= 594
    assert all(0 <= x.severity <= 3 for x in got.values())
    model = toxicity.train(docs, lab)
    assert (model.weights >= 0).all() and (np.diff(model.thresholds) > 0).all()
    edge = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "nasty " * 30000, 0.0), (3, "nasty " * 30000, 0.0)], EDGE)
    out = {x.doc_id: x.toxic for x in toxicity.grade(edge, model).collect()}
    assert out == {1: False, 2: False, 3: True}
    assert [x.doc_id for x in toxicity.accept(edge, model).orderBy("doc_id").collect()] == [1, 2]
    hashes, doc, n = toxicity.features_of(pa.array([t for _, t, _ in rows]))
    whole = toxicity.cells_of(hashes, doc, n)
    plain = toxicity.fit(*whole, n, toxicity.grades_of(*whole, n, np.array([y for _, y in labels])))
    assert np.allclose(plain.weights, model.weights, atol=1e-6) and np.allclose(plain.thresholds, model.thresholds, atol=1e-6) and (plain.features == model.features).all()
    twice = lab.union(lab.withColumn("toxic", F.lit(0))).union(spark.createDataFrame([(None, 1), (1, None), (77777, 1)], "doc_id long, toxic int"))
    assert (toxicity.train(docs.withColumn("y", F.lit("x")).withColumn("row", F.lit(1)), twice).features == model.features).all(), "of several labels the highest counts"
    assert toxicity.train(docs, lab.limit(0)) is None and not any(x.toxic for x in toxicity.grade(docs, None).collect())
    assert toxicity.grade(edge.limit(0), model).count() == 0


def test_base_scores_equal_brute_force(spark):
    docs = sample(spark, 150).select("doc_id", "text").union(spark.createDataFrame([(9001, None), (9002, ""), (9003, "Ab\x0bcd ab"), (9003, "Ab\x0bcd ab"), (None, "null id")], "doc_id long, text string"))
    rows, held = docs.collect(), lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    train = [words(r.text) for r in rows if not held(r.doc_id)]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    got = suffix_lm.score(docs, docs.filter(~suffix_lm.held_out()), frequent=50).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        w = words(r.text)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        want[r.doc_id, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_tree_scores_equal_a_plain_walk():
    texts = [b"abracadabra", b"abra abra", b"", b"cad abra cad"] * 5
    sym, counts, _ = suffix_lm.symbols(texts)
    cells = Counter(suffix_lm.context_codes(sym, counts, 3).tolist())
    rows = Counter()
    for code, n in cells.items():
        for k in range(4):
            rows[k, code & ((1 << 9 * (k + 1)) - 1)] += n
    items = sorted(rows.items())
    tree = suffix_lm.build_tree(np.array([k for (k, _), _ in items]), np.array([c for (_, c), _ in items], np.int64), np.array([n for _, n in items]), 3, divergence=0.0)
    assert tree.contexts > 10
    totals = 10.0 ** tree.logp[:, :-1].astype(float)
    shared = 257 - (tree.logp.shape[1] - 1)
    assert np.allclose(totals.sum(axis=1) + shared * 10.0 ** tree.logp[:, -1].astype(float), 1, atol=1e-4), "each state is a distribution"
    one = tree.score(sym, counts)
    each = [tree.score(*suffix_lm.symbols([t])[:2])[0] for t in texts]
    assert np.allclose(one, each) and np.allclose(one[:4], one[4:8])
    state, total = 0, 0.0
    for s in suffix_lm.symbols([texts[0]])[0]:
        total += tree.logp[state, tree.column[s]]
        state = tree.step[state, tree.column[s]]
    assert total == pytest.approx(one[0], abs=1e-4)


def test_scores_equal_a_tree_of_all_contexts_whatever_the_size(spark):
    r = random.Random(9)
    rare = [(i, "zqj kvx wpy") for i in range(4)]  # few among many: a floor that rises with the corpus lost them
    common = [(10 + i, " ".join(r.choice(["the", "man", "and", "sea"]) for _ in range(60))) for i in range(9000)]
    train = spark.createDataFrame(rare + common, "doc_id long, text string")
    docs = spark.createDataFrame([(1, "zqj kvx wpy"), (2, "the sea and"), (3, "unseen zqj"), (4, None)], "doc_id long, text string")
    got = {x.doc_id: x.score for x in suffix_lm.score(docs, train, block=1 << 16, buckets=16).collect()}
    sym, counts, _ = suffix_lm.symbols([t.encode() for _, t in rare + common])
    code, n = suffix_lm.run_lengths(suffix_lm.context_codes(sym, counts, 6))
    cells = Counter()
    for c, m in zip(code.tolist(), n.tolist(), strict=True):
        for k in range(7):
            cells[k, c & ((1 << 9 * (k + 1)) - 1)] += m
    seen = Counter()
    for (k, c), m in cells.items():
        seen[k, c >> 9] += m
    items = sorted((key, m) for key, m in cells.items() if seen[key[0], key[1] >> 9] >= 2)
    tree = suffix_lm.build_tree(np.array([k for (k, _), _ in items]), np.array([c for (_, c), _ in items], np.int64), np.array([m for _, m in items]), 6)
    for i, t in [(1, b"zqj kvx wpy"), (2, b"the sea and"), (3, b"unseen zqj"), (4, b"")]:
        assert got[i] == pytest.approx(tree.score(*suffix_lm.symbols([t])[:2])[0], abs=1e-3)


def test_language_model_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = suffix_lm.score(docs, empty).first()
    assert row.n_known == 0 and row.train_tokens == 0 and row.score == pytest.approx(4 * math.log10(1 / 257), abs=1e-3)
    assert suffix_lm.score(empty, empty).count() == 0


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 63, 300, np.uint64)
    queries = values[rng.integers(0, 300, 200)].copy()
    for i in range(200):
        for b in rng.choice(64, rng.integers(0, 24), replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(b)
    want = {(q, v) for q in range(200) for v in range(300) if int(queries[q] ^ values[v]).bit_count() <= 15}
    for blocks in (None, 4, 5, 16):
        index = dc.HammingIndex(values, 15, blocks)
        for at_once in (1 << 20, 700):
            assert set(zip(*(x.tolist() for x in index.search(queries, at_once)[:2]), strict=True)) == want and want
    assert len(dc.variants(16, 3)) == 697 and dc.HammingIndex(values[:0], 15).search(queries)[0].size == 0


def test_contamination_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(r.randint(5, 40)))) for i in range(25)] + [(90, "four words ffee dd"), (91, None), (92, ""), (None, "no id")]
    rows = []
    for i in range(200):
        own = [word() for _ in range(r.randint(0, 150))]
        if i % 3 == 0:
            passage = items[r.randrange(25)][1].split()
            if i % 2:
                passage[r.randrange(len(passage))] = word()
            at = r.randint(0, len(own))
            own[at:at] = passage
        rows.append((i, " ".join(own).upper() if i % 5 == 0 else ", ".join(own)))
    rows += [(500, None), (501, ""), (502, items[0][1]), (502, items[0][1]), (503, "a FOUR words, ffee dd b four words ffee dd"), (504, "four words ffee"), (505, "dd")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((x.doc_id, x.item_id, round(x.similarity, 9)) for x in dc.contamination(docs, bench).collect())

    def split(t):
        return (t or "").lower().replace(",", "").split()

    def weighted(w):
        return dict(Counter(x for i in range(len(w) - 4) for x in [tuple(w[i : i + 5])] * sum(map(len, w[i : i + 5]))))

    want = Counter()
    for d, t in rows:
        w = split(t)
        for i, x in items:
            n = split(x)
            if len(n) >= 5 and len(w) >= 5:
                best = max(dc.similarity(weighted(w[s : s + len(n)]), weighted(n)) for s in range(max(1, len(w) - len(n) + 1)))
                if best >= 0.8:
                    want[d, i, round(best, 9)] += 1
            elif i is not None and n and any(w[s : s + len(n)] == n for s in range(len(w))):
                want[d, i, 1.0] += 1
    assert got == want and len(want) > 20
    assert {x.doc_id for x in dc.clean(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _, _ in want}
    assert want[503, 90, 1.0] == 1
    dc.ITEMS = 7  # blocks of items, one at a time
    try:
        assert Counter((x.doc_id, x.item_id, round(x.similarity, 9)) for x in dc.contamination(docs, bench).collect()) == got
        assert {x.doc_id for x in dc.clean(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _, _ in want}
    finally:
        dc.ITEMS = 10_000
    assert dc.contamination(docs, bench.limit(0)).count() == 0 and dc.contamination(docs.limit(0), bench).count() == 0


def test_chunks_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 500, "", "c"])], ["t"])
    assert [b.num_rows for b in chunks(batch, 0, 100)] == [2, 1, 2]


def test_extra_columns_do_not_clash(spark):
    df = sample(spark, 30).withColumn("severity", F.lit(1)).withColumn("part", F.lit("x"))
    assert toxicity.grade(df, None).columns == ["doc_id", "severity", "grade", "p_toxic", "toxic"]


def test_elements_are_counted_at_any_depth():
    # a menu below 300 open elements: its end tags must close its own elements alone
    page = '<main class="content">' + "<div>" * 300 + "<nav><ul><li>menu</ul></nav>" + "</div>" * 300 + "<p>Text.</p></main><footer>foot</footer>"
    got = {b.text: b.path for b in he.blocks(page)}
    main, foot = he.path_vector(("main", ".content", "p")), he.path_vector(("footer",))
    assert (got["Text."] == main).all() and (got["foot"] == foot).all()
    assert (got["menu"] == he.path_vector(("main", ".content", *["div"] * 300, "nav", "ul", "li"))).all()


def test_signs_that_are_no_letters_have_no_language(spark):
    model = lang_cnn.ByteCnn(["a", "b"])
    df = spark.createDataFrame([(1, "² ½ Ⅷ", 1.0), (2, "٣ ①", 1.0), (3, "² ª", 1.0)], EDGE)
    assert {r.doc_id: r.lang_pred == "und" for r in lang_cnn.predict(df, model).collect()} == {1: True, 2: True, 3: False}
    assert {r.doc_id for r in lang_cnn.accept(df, model, least=0.0).collect()} == {3}
    assert lang_cnn.accept(df, None).count() == 3


def test_language_learns_any_number_of_labels(spark):
    rows = [(i, f"word {i}", f"l{i % 600:03}") for i in range(1200)]
    model = lang_cnn.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_class=2)
    assert len(model.labels) == 600


def test_numbers_sums_and_lookups():
    r = np.random.default_rng(1)
    sums, want, many = suffix_lm.Sums(most=1000), Counter(), r.integers(0, 1 << 62, 3000)
    for _ in range(30):
        code, n = suffix_lm.run_lengths(r.choice(many, 500))
        sums.add(code, n)
        want.update(dict(zip(code.tolist(), n.tolist(), strict=True)))
    code, n = sums.total()
    assert dict(zip(code.tolist(), n.tolist(), strict=True)) == want and (np.diff(code) > 0).all()
    assert (suffix_lm.unpack_numbers(suffix_lm.pack_numbers(code), np.int64) == code).all()
    look = suffix_lm.Lookup(code, n.astype(np.float32))
    asked = r.choice(code, 5000)
    assert look.get(asked).tolist() == [want[c] for c in asked.tolist()]
    with pytest.raises(KeyError):
        look.get(np.array([-5]))
    assert suffix_lm.Sums().total()[0].size == 0


def test_language_model_edges(spark):
    rows = [(1, "x" * 300_000 + " " + "ab " * 100_000, 1), (2, None, 1), (2, None, 1), (3, "", 1), (None, "ab ab", 1), (4, " \t\n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = Counter((r.doc_id, r.n_tokens, r.held_out, round(r.score, 3)) for r in suffix_lm.score_documents(df).collect())
    assert sum(got.values()) == 6 and {k[:2] for k in got} == {(1, 100_002), (2, 1), (3, 1), (None, 3), (4, 1)}
    assert len({k[3] for k in got if k[1] == 1}) == 1
    assert suffix_lm.score_documents(df.limit(0)).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


TAGS = {
    '<p data-x="a<b">Hello</p>': ["Hello"],
    '<p>x</p><img alt="5 < 6"><p>y</p>': ["x", "y"],
    "<div title=it's>in</div>out": ["in", "out"],
    '<a href="x>y</a>': ["y"],
    '<p class="a>b" id=\'c"d>e\'>t</p>': ["t"],
    "<p a=1 b = '2>' c>t</p><p \"stray>u</p>": ["t", "u"],
    "<a ": [],
    "x <3 y</ z>": ["x <3 y"],
    '<head><meta content="a>b"><title data-t="1>0">T</title></head>t': ["t"],
    '<script src="a>b">if (a < b) {}</script>t': ["t"],
    "<textarea a='>'>typed <b>in</textarea>t": ["t"],
    '<article data-note=">"><p title="</p>">one</p></article>': ["one"],
}


@pytest.mark.parametrize("page", TAGS)
def test_nothing_of_a_tag_is_text(page):
    assert [b.text for b in he.blocks(page)] == TAGS[page]


@pytest.mark.parametrize("part, times", [("<a ", 350_000), ('<a "<', 200_000), ("<a b='", 170_000), ('"<', 500_000), ('<p x="a<b">t', 80_000), ("<!--", 250_000), ("<script>", 120_000), ("<head><title>", 70_000), ("<meta content=it's>", 50_000), ("</", 400_000)])
def test_pages_are_read_in_linear_time(part, times):
    began = time.process_time()
    he.blocks(part * times)
    assert time.process_time() - began < 12


class Article(HTMLParser):
    """The text of article or main elements, without what is no article inside them: the rule that the given pages follow."""

    OUT = {"aside", "nav", "form", "script", "style", "footer", "header", "button", "textarea", "noscript", "select"}
    LINES = {"p", "div", "h1", "h2", "h3", "h4", "li", "ul", "ol", "blockquote", "pre", "section", "article", "main", "table", "tr", "td", "th", "br", "figure", "figcaption"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in self.LINES:
            self.lines.append("")
        if tag not in he.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.LINES:
            self.lines.append("")
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if {"article", "main"} & set(self.open) and not self.OUT & set(self.open):
            self.lines[-1] += data


def test_the_given_pages_give_their_articles(spark):
    """A rule for these pages that knows their tags: what the network finds without it must agree on nearly all of them."""
    rows = he.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    same = checked = 0
    for r in rows:
        rule = Article()
        rule.feed(pages[r.page_id])
        lines = [" ".join(x.split()) for x in rule.lines]
        if any(lines):
            checked += 1
            same += set(x for x in r.text.split("\n") if x) == {x for x in lines if x}
    assert checked >= 10 and same >= 0.95 * checked, (same, checked)


def test_long_words_leave_no_long_tables():
    from lexloom.llm import wordhash

    def hashes(text):
        buf, offsets = wordhash.utf8(pa.array([text]))
        return wordhash.word_hashes(buf, *wordhash.word_bounds(buf, offsets)[:2])

    r = random.Random(1)
    long = "".join(r.choice("abc") for _ in range(300_000))
    got = hashes(" ".join([long, long, long[:-1] + "d", long[1:], "d" + long[1:], "a" * 5000, "a" * 5001]))
    assert got[0] == got[1] and len(set(got.tolist())) == 6
    swapped = long[4096:8192] + long[:4096] + long[8192:]
    assert hashes(swapped)[0] != got[0]
    assert max(len(p) for p in wordhash._powers) <= wordhash.FOLD


def test_samples_are_bounded_in_rows(spark):
    from lexloom.llm.common import hashed_sample

    one = spark.range(20_000).select(F.lit(7).alias("id"), (F.col("id") % 5000).cast("string").alias("text"), F.lit("en").alias("k"))
    assert hashed_sample(one, "id", 100, "k", text_col="text").count() == 100
    few = spark.range(20_000).select(F.lit(7).alias("id"), (F.col("id") % 3).cast("string").alias("text"), F.lit("en").alias("k"))
    assert hashed_sample(few, "id", 100, "k", text_col="text").count() == 3
    assert hashed_sample(one.limit(0), "id", 100, "k", text_col="text").count() == 0
    assert hashed_sample(spark.range(5000), "id", 200).count() == 200


def test_a_labelled_id_in_many_rows_is_one_text(spark):
    from lexloom.llm import toxicity

    docs = spark.createDataFrame([(1, f"vile word{i} vile") for i in range(300)] + [(2, "kind words here")] * 50 + [(3, "vile vile thing"), (4, "kind thing")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is not None
