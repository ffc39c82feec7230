"""Language, toxicity, HTML and chat formatting."""

import hashlib
from zlib import crc32

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelframe.llm import chat_format, html_text, language_id, toxicity
from reelframe.llm.common import read
from tests.llm.helpers import TEXTS, empty, odd_documents


def test_language_gradients():
    net = language_id.BiGRU(3, hidden=3)
    rng = np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, y, w = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones((5, 4))
    _, g = net.gradients(x, y, w)
    for name in ("Uf", "Vb", "O", "c", "Ef"):
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        keep, out = net.p[name][at], []
        for step in (1e-3, -1e-3):
            net.p[name][at] = keep + step
            out.append(net.gradients(x, y, w)[0])
        net.p[name][at] = keep
        assert abs((out[0] - out[1]) / 2e-3 - g[name][at]) < 2e-3, name


def test_language_accuracy_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.query(spark, sf).join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_language_learns_from_whole_texts():
    raw = [bytes(range(1, 131)), b"ab", b"x" * 64]
    x, y, w = language_id.windows(raw, [1, 0, 2])
    assert x.shape == w.shape == (64, 5) and y.tolist() == [1, 1, 1, 0, 2]
    back = [bytes(x[:, i][w[:, i] > 0]) for i in range(5)]
    assert b"".join(back[:3]) == raw[0] and back[3:] == raw[1:]


def test_language_sample_is_bounded_by_rows_and_characters(spark):
    rows = [(i, "abc " * 25, "en") for i in range(1, 60)] + [(i, "xyz " * 25, "de") for i in range(100, 160)] + [(3, "abc " * 25, "en")] * 300 + [(99, "q" * 5000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []

    def train(self, x, y, w):
        seen.append(w.sum())

    before, language_id.BiGRU.train = language_id.BiGRU.train, train
    try:
        language_id.train(docs, chars=1000)
        language_id.train(docs, docs=3)
    finally:
        language_id.BiGRU.train = before
    assert seen[0] == 2 * 1000 and seen[1] in (2 * 300, 5 * 100 + 5000)


def test_language_network_against_a_loop():
    """Position by position, plain numbers: the same states and probabilities."""
    net, rng = language_id.BiGRU(3, hidden=4, seed=1), np.random.default_rng(2)
    x = rng.integers(0, 256, 9).astype(np.uint8)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(order, d):
        h, out = np.zeros(4), {}
        for t in order:
            e = net.p[f"E{d}"][x[t]].astype(float)
            z, r = sig(e[:4] + h @ net.p[f"U{d}"][:, :4]), sig(e[4:8] + h @ net.p[f"U{d}"][:, 4:])
            h = (1 - z) * h + z * np.tanh(e[8:] + (r * h) @ net.p[f"V{d}"])
            out[t] = h
        return out

    ahead, back = states(range(9), "f"), states(range(8, -1, -1), "b")
    want = np.array([np.concatenate([ahead[t], back[t]]) @ net.p["O"] + net.p["c"] for t in range(9)])
    assert np.allclose(net.logits(x[:, None])[:, 0], want, atol=1e-4)


def test_signs_are_no_letters():
    assert not any(map(language_id.has_letter, ["²", "½", "①", "12 ³", "", None, "_-!"]))
    assert all(map(language_id.has_letter, ["² a", "é", "字", "ʰ"]))


def test_language_windows_do_not_depend_on_the_batch():
    model = language_id.Model(["a", "b"], language_id.BiGRU(2))
    texts = ["short", "longer text " * 200, "x"]
    whole = model.predict(texts)
    for i, t in enumerate(texts):
        one = model.predict([t])
        assert one[0][0] == whole[0][i] and abs(one[1][0] - whole[1][i]) < 1e-5


def test_language_odd_rows(spark):
    docs = odd_documents(spark)
    model = language_id.train(docs, docs=20)
    got = language_id.identify(docs, model, keep=["doc_id", "text"]).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        letters = r["text"] and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not letters), r["text"]
    assert language_id.identify(empty(docs), model).count() == 0
    none = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs, none).collect()} == {("und", 0.0)}


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = read(spark, sf, "labels").select("doc_id", "toxic")
    got = toxicity.query(spark, sf).join(labels, "doc_id").where("held_out").collect()
    s, y = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got])
    auc = np.mean(s[y == 1][:, None] > s[y == 0][None, :])
    assert auc > 0.93
    assert np.mean([r["predicted"] for r in got if not r["toxic"]]) < 0.01
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_ftrl_learns_and_is_sparse():
    rng, h, model = np.random.default_rng(0), toxicity.Hasher(), toxicity.FTRL()
    words = [f"w{i}" for i in range(300)]
    data = []
    for i in range(600):
        own = list(rng.choice(words, 20)) + (["badword"] if i % 5 == 0 else [])
        rng.shuffle(own)
        data.append((h.features(" ".join(own)), int(i % 5 == 0)))
    for _ in range(3):
        for x, y in data:
            model.learn(x, y)
    scorer = model.sparse()
    assert len(scorer.at) < 0.05 * len(np.unique(np.concatenate([x for x, _ in data])))
    w = scorer.dense()
    right = [(toxicity.sigmoid(scorer.bias + w[x].sum()) >= 0.5) == bool(y) for x, y in data]
    assert np.mean(right) > 0.98


def test_ftrl_against_a_plain_loop():
    """The published per-coordinate update, one coordinate at a time, in a dictionary."""
    rng, model = np.random.default_rng(4), toxicity.FTRL(bits=6)
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == 64 else toxicity.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(400):
        x = np.unique(rng.integers(0, 64, 8)).astype(np.int32)
        y = int(3 in x or 7 in x)
        at = [*x.tolist(), 64]
        p = 1 / (1 + np.exp(-sum(map(weight, at))))
        assert abs(model.learn(x, y) - p) < 1e-9
        for i in at:
            w, g = weight(i), p - y
            s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
            z[i], n[i] = z.get(i, 0.0) + g - s * w, n.get(i, 0.0) + g * g
    scorer = model.sparse()
    assert {int(i): round(float(w), 5) for i, w in zip(scorer.at, scorer.w, strict=True)} == {i: round(float(np.float32(weight(i))), 5) for i in range(64) if weight(i)}


def test_toxicity_folds_repeated_ids(spark, monkeypatch):
    rows = [(1, "some text")] * 500 + [(1, "other words")] * 3 + [(i, f"word{i}") for i in range(2, 6)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity.FTRL, "learn", lambda self, x, y: seen.append(y))
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, hold_out=(1, 5))
    assert len(seen) == 5 * toxicity.EPOCHS


def test_toxicity_learns_from_long_texts(spark):
    """The features of all texts are over what the driver may get as one result; the weights are those of a plain loop."""
    rng = np.random.default_rng(6)
    texts = [" ".join([f"w{x}" for x in rng.integers(0, 50_000, 4000)] + ["badword"] * (i % 2)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    conf, own = spark.sparkContext._jsc.sc().conf(), {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, most = {k: spark.conf.get(k) for k in own}, conf.get("spark.driver.maxResultSize", "1g")
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        conf.set("spark.driver.maxResultSize", "1m")
        got = toxicity.train(docs, labels, hold_out=(1, 5))
    finally:
        conf.set("spark.driver.maxResultSize", most)
        for k, v in before.items():
            spark.conf.set(k, v)
    h, model = toxicity.Hasher(), toxicity.FTRL()
    x = [h.features(t) for t in texts]
    assert sum(map(len, x)) * 4 > 4 << 20 and all((toxicity.unpack(toxicity.pack(f)) == f).all() for f in [*x[:3], x[0][:0], x[0][:1]])
    for _ in range(toxicity.EPOCHS):
        for i in sorted(range(120), key=lambda i: crc32(str(i).encode())):
            model.learn(x[i], i % 2)
    want = model.sparse()
    assert len(want.at) and got.at.tolist() == want.at.tolist() and got.w.tolist() == want.w.tolist() and got.bias == want.bias


def test_features_of_ngrams_and_skipgrams():
    h = toxicity.Hasher()
    assert len(h.features("a b c")) == 3 + 2 + 1 and len(h.features(None)) == 0 and len(h.features("!!")) == 0
    assert set(h.features("A, b! C")) == set(h.features("a b c"))


def test_toxicity_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(3, 1, None), (3, 0, None), (None, 1, 1), (4, None, 0), (7, 0, 1), (11, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_texts(docs, model, keep=["doc_id", "text"]).collect()
    assert len(got) == len(TEXTS) + 3 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_texts(empty(docs), model, keep=["doc_id"]).count() == 0
    assert toxicity.train(docs, empty(labels)) is None
    assert {r["score"] for r in toxicity.score_texts(docs, None, keep=["doc_id"]).collect()} == {0.0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>x</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li>More</ul></nav><div class="cookie-notice">We use cookies, a long notice about cookies and more.</div>
<article><header><h1>Title &amp; more</h1></header><p>First  <b>para</b>graph\nis here &lt;ok&gt;.<p>Short.<div class="ad-box">Buy now</div><ul><li>one<li>two</ul><p hidden>no</p>
<section id="comments"><p>A reader says a lot of things in a long comment about this.</p></section></article>
<aside>Related</aside><form>Name <input></form><footer>&copy; me</footer></body></html>"""


def test_html_cases():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph is here <ok>.\nShort.\none\ntwo"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("only text &eacute;") == "only text é"
    divs = "<body><div id=menu><a>a</a><a>b</a></div><div><div><p>" + "long text " * 20 + "</p><p>b.</p></div></div><div class=footer>f</div></body>"
    assert html_text.main_text(divs) == ("long text " * 20).strip() + "\nb."
    classes = '<div class="layout has-sidebar"><div class="post-header"><h1>T</h1></div><div class="entry"><p>' + "text " * 30 + '</p></div><div class="sidebar">s</div><div class="header">h</div></div>'
    assert html_text.main_text(classes) == "T\n" + ("text " * 30).strip()
    assert html_text.main_text("<article><p>" * 3000 + "deep") == "deep"
    assert html_text.main_text("<article><p>cut off in a tag <b") == "cut off in a tag"


def test_html_names_decide_little_inside_an_article():
    prose = "<p>" + "long text " * 20 + "</p>"
    for inner in ('<div class="recommended-dose">Two a day</div>', '<p class="related-work">Others did too.</p>', '<section id="related-work"><p>Others.</p></section>', '<h2 id="navigation">Ships</h2>', '<section id="search"><p>We looked.</p></section>', '<div id="legal-status">Banned.</div>', "<p><math><mi>x</mi></math></p>"):
        assert html_text.main_text(f"<body><article>{prose}{inner}{prose}</article></body>").count("\n") == 2, inner
    table = '<table class="menu-prices"><tr><td>Tea</td><td>2</td></tr></table>'
    assert "Tea" in html_text.main_text(f"<article>{prose}{table}</article>")
    for inner in ('<div class="ad">Buy</div>', '<div id="ad">Buy</div>', '<div class="comment-list"><p>I say</p></div>', '<ul class="related-posts"><li>More</ul>', '<div class="cookie-notice">We use</div>', "<aside>Side</aside>", '<div class="share-links">Tell</div>', '<p class="advert">Buy</p>'):
        assert html_text.main_text(f"<body><article>{prose}{inner}{prose}</article></body>").count("\n") == 1, inner


def test_html_time_grows_with_the_page():
    import time

    def seconds(page):
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    for make in (lambda n: "<p>" + "<b>x</i>" * n, lambda n: "<div>x" * n, lambda n: "<div>" + "<b>" * n + "<p>x</p>" * n, lambda n: "</p>" * n + "<i>" * n + "</u>" * n):
        assert seconds(make(20_000)) < 4 * 4 * max(0.1, seconds(make(5000)))


def test_html_against_the_template(spark):
    """An independent rule for the pages at hand: the blocks of the article element, by a tree built here."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.parts, self.skip, self.inside = [], [], 0, 0

        def cut(self):
            if t := " ".join("".join(self.parts).split()):
                self.out.append(t)
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag in html_text.VOID:
                return
            own = dict(attrs)
            if self.skip or tag in ("nav", "aside", "form", "footer", "script", "style") or "ad" in (own.get("class"), own.get("id")):
                self.skip += 1
            elif tag in ("article", "main"):
                self.inside += 1
            elif tag in html_text.BLOCKS:
                self.cut()

        def handle_endtag(self, tag):
            if tag in html_text.VOID:
                return
            if self.skip:
                self.skip -= 1
            elif tag in html_text.BLOCKS:
                self.cut()
                self.inside -= tag in ("article", "main")

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.parts.append(data)

    sf, same = "/root/testdata/sf0.01", []
    rows = html_text.query(spark, sf).join(read(spark, sf, "pages").select("page_id", "html"), "page_id").collect()
    for r in rows:
        tree = Tree()
        tree.feed(r["html"] or "")
        tree.cut()
        same.append("\n".join(tree.out) == r["text"])
    assert len(same) == 250 and np.mean(same) >= 0.99, [r["page_id"] for r, s in zip(rows, same, strict=True) if not s][:5]


def test_html_parts():
    assert html_text.threshold([1.0, 1.0, 9.0, 9.0]) == 5.0
    s = html_text.smooth([0.0, 0.0, 9.0, 0.0, 0.0])
    assert s[2] == max(s) and s[1] == s[3] > s[0] == s[4] > 0


def test_html_odd_rows(spark):
    rows = [(1, "u", PAGE, "t", 1), (1, "u", PAGE, "t", 1), (None, None, None, None, None), (2, "u", "<p>" + "w " * 200_000, "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract(pages, keep=["page_id", "url"]).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert max(r["n_chars"] for r in got) == 399_999
    assert html_text.extract(empty(pages), keep=["page_id"]).count() == 0


texts = st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "\\\\", " ", "a", "\n", "<s", "INST]", "<"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), texts), texts), max_size=5))
def test_chat_round_trip(turns):
    formatted, spans = chat_format.render(turns)
    assert chat_format.parse(formatted) == turns
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_trees(spark):
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "user", "c", None), (1, 5, 4, "assistant", None, 0.5), (2, 1, 99, "user", "orphan", 0.0), (None, 1, None, "user", "x", 0.0)]
    messages = spark.createDataFrame(tree, "tree long, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["rank"]): r for r in chat_format.format_trees(messages).collect()}
    assert len(got) == 4 and got[1, 1]["leaf"] == 5 and got[1, 1]["score"] == 2.5
    assert chat_format.parse(got[1, 1]["formatted"]) == [("user", "q"), ("assistant", "b"), ("user", "c"), ("assistant", "")]
    assert chat_format.parse(got[1, 2]["formatted"]) == [("user", "q"), ("assistant", "a")]
    assert chat_format.format_trees(messages, best=1).count() == 3
    assert chat_format.format_trees(empty(messages)).count() == 0
    twice = chat_format.format_trees(messages.unionByName(messages))
    assert sorted(r["formatted"] for r in twice.collect()) == sorted(r["formatted"] for r in got.values())


def test_chat_circles_and_repeated_ids(spark):
    rows = [(1, 1, 2, "user", "a", 1.0), (1, 2, 3, "assistant", "b", 0.0), (1, 3, 1, "user", "c", 0.0), (1, 4, 2, "assistant", "d", 0.0), (2, 7, 7, "user", "me", 0.0), (3, 1, None, "user", "x", 0.0), (3, 1, 9, "user", "w", 0.0), (3, 2, 1, "assistant", "y", 0.0)]
    rows += [(4, i, i % 6 + 1, "user", str(i), 0.0) for i in range(1, 7)]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): [t for _, t in chat_format.parse(r["formatted"])] for r in chat_format.format_trees(messages).collect()}
    # the circle 1 -> 2 -> 3 -> 1 is cut above its smallest message
    assert got == {(1, 4): ["a", "c", "b", "d"], (2, 7): ["me"], (3, 2): ["x", "y"], (4, 2): ["1", "6", "5", "4", "3", "2"]}


def test_chat_chains(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b", "z"), (1, 0, "user", "a", "z"), (1, 1, "assistant", "b", "z"), (2, None, None, None, None), (None, 0, "user", "n", "z"), (3, 0, "assistant", said * 50, "z")] + [(4, i, "user", str(i), "z") for i in range(70)]
    flat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_trees(chat_format.chain(flat), best=1)).collect()}
    assert len(got) == 5
    by = {1: [("user", "a"), ("assistant", "b"), ("assistant", "b")], 2: [("", "")], None: [("user", "n")], 3: [("assistant", said * 50)], 4: [("user", str(i)) for i in range(70)]}
    for key, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[key]["n_turns"] == len(turns) and got[key]["loss_chars"] == len(learned)
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[key]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert chat_format.format_trees(chat_format.chain(empty(flat))).count() == 0
