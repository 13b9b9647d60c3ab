"""Toxicity, HTML extraction, language model and URL filters: held-out accuracy and brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from marginalia.llm import op05_toxicity as toxicity
from marginalia.llm import op06_html as pages
from marginalia.llm import op07_lm as lm
from marginalia.llm import op08_urls as urls
from marginalia.llm.html_pages import labelled_pages


def test_grammar_tells_clauses_apart():
    scorer = toxicity.Scorer({"moron$": 3.0, "lowei": 2.0})
    event = lambda text: {toxicity.EVENTS[i] for i in np.flatnonzero(scorer.features(text)[:-1])}
    assert event("what a moron") == {"insult"}
    assert event("you are a moron") == {"insult_aimed"}
    assert event("he is not a moron") == {"insult_denied"}
    assert event("they said it was some moron thing") == {"insult_quoted"}
    assert event("you loweischaft") == {"insult_aimed"}
    assert event("not here. moron") == {"insult"}
    assert event("I will kill") == {"threat"}
    assert not event("nothing at all") and not event("")


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(["an", "er", "in", "the", "ti", "on", "re"], k=rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "scumbag", "zorchling", "zorchen", "zorchtum"]))
        docs.append((i, " ".join(words), 1))
        labels.append((i, int(toxic)))
    docs += [(2000, None, 1), (2001, "", 1), (None, "x", 1)]
    labels += [(5000, 1), (3, None), (None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    out = toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(docs)
    truth = dict(labels)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert {r["doc_id"] for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    none = toxicity.score(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_blocks_of_odd_pages():
    text = lambda page: [b.text for b in pages.blocks(page)]
    assert text("<p><b>one<br>two &amp; three<p>four</p></p>five<div> six\n\t seven</div>") == ["one two & three", "four", "five", "six seven"]
    assert text('<p title="a>b">x</p><!-- c > d --><script>var t="</p>";</script><style>p{}</style>y') == ["x", "y"]
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == ["a", "b", "c", "d", "e"]
    assert text("a < b &copy &nbsp; c <unknown>d</unknown>") == ["a < b © c d"]
    assert text("<head><title>t</title></head><body>b") == ["b"]
    assert text("") == [] and text("<p>") == [] and text("<!--") == [] and text("<a href='x") == []


def test_ancestors_at_any_depth():
    for open_, close in (("<div>", "</div>"), ("<b>", "")):
        page = open_ * 1000 + "<nav>menu</nav><article>some<div>text</div></article>" + close * 999 + "after<footer>foot</footer>"
        found = pages.blocks(page)
        assert [b.text for b in found] == ["menu", "some", "text", "after", "foot"]
        menu, some, text, after, foot = map(set, pages.features(found))
        assert {"in:nav", "near:nav"} <= menu and {"in:footer", "near:footer"} <= foot
        assert {"in:article", "near:article", "tag:article"} <= some and {"in:article", "near:article", "tag:div"} <= text
        assert "near:none" in after and not {"in:nav", "in:article", "in:footer"} & after


def test_telling_words_in_the_middle_of_a_long_block():
    page = "<p>" + "some words " * 40 + "all rights reserved " + "more words " * 40 + "<p>" + "some words " * 80
    notice, plain = map(set, pages.features(pages.blocks(page)))
    assert "speaks:False" in notice and not {"speaks:False", "speaks:True"} & plain


def test_extraction_on_unseen_pages():
    crf = pages.train()
    right = wrong = 0
    for page in labelled_pages(150, seed=99):
        found = pages.blocks(page, labelled=True)
        guess = crf.viterbi(crf.emissions(pages.features(found)))
        for b, y in zip(found, guess, strict=True):
            right += y == b.label
            wrong += y != b.label
    assert right / (right + wrong) > 0.97


def test_viterbi_is_the_best_chain():
    crf = pages.Crf(["a", "b"])
    crf.weights, crf.moves, crf.first = np.array([0.5, -1.0]), np.array([[0.3, -0.4], [-0.2, 0.6]]), np.array([0.1, -0.3])
    rng = random.Random(1)
    for _ in range(50):
        e = [rng.uniform(-1, 1) for _ in range(rng.randint(1, 7))]

        def value(chain, e=e):
            return crf.first[chain[0]] + sum(x for x, y in zip(e, chain, strict=True) if y) + sum(crf.moves[a, b] for a, b in zip(chain, chain[1:], strict=False))

        best = max(value([k >> i & 1 for i in range(len(e))]) for k in range(1 << len(e)))
        assert abs(value(crf.viterbi(e)) - best) < 1e-9


def test_extract_table(spark):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>Some text that says a thing. And more of it.</p></article><footer>&copy; 2020 us</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 4), (3, "v", "", 5), (1, "u", page, 3)], "page_id long, url string, html string, n_chars long")
    rows = pages.extract(df).collect()
    assert [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in rows if r["page_id"] == 1] == [(1, "u", "Title\n\nSome text that says a thing. And more of it.", 51)] * 2
    assert {(r["page_id"], r["text"], r["n_chars"]) for r in rows if r["page_id"] != 1} == {(2, "", 0), (3, "", 0)}
    assert pages.extract(df.where("false")).count() == 0


def test_pages_that_training_never_saw():
    text = lambda page: pages.main_text(page, pages.train())
    first, second = "The first paragraph says one thing. It goes on.", "The second paragraph says another thing. It goes on too."
    around = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>%s</p>%s<p>%s</p></article><footer>&copy; us</footer></body></html>"
    want = f"Title\n\n{first}\n\n{second}"
    for between in ("", "<button>Share", "<select><option>One<option>Two", "<div data-label='Price'></div>", "<td data-label=Price>", "<svg>", "<object>", "<template>", "<button>A</button><button>B</button>", "<script>if (a < b) { x('</p>') }</script>"):
        assert text(around % (first, between, second)) == want, between
    # the labels of training pages mean nothing elsewhere
    assert text(around.replace("<article>", "<article data-label=0>") % (first, "", second)) == want
    assert "<b>" in [b.text for b in pages.blocks("<p><![CDATA[<b>")] and [b.text for b in pages.blocks("<p><![CDATA[<b>]]>x")] == ["<b>x"]
    assert first in text(around % (first, f"<noscript><p>{second}</p></noscript>", second))
    # elements at any depth
    deep = "<div>" * 1000 + around[12:-14] % (first, "", second) + "</div>" * 1000
    assert text(f"<html><body>{deep}</body></html>") == want
    assert text(around % (first * 2000, "", second)) == f"Title\n\n{first * 2000}\n\n{second}"


def test_gradients_are_right():
    shape = lm.Shape(np.array([50.0, 20, 10, 5, 3, 1]))
    gru = lm.Gru(shape)
    gru.theta[:] = np.random.default_rng(0).normal(0, 0.3, len(gru.theta))
    hs, goal = np.random.default_rng(1).normal(0, 1, (5, lm.HIDDEN)).astype(np.float32), np.array([0, 5, 2, 3, 1])
    grad = np.zeros_like(gru.theta)
    gru.output(hs, goal, grad)
    for k in ("wc", "bc", "ww", "bw"):
        at = gru.slices[k][0]
        for i in (at, at + 1):
            keep = gru.theta[i]
            values = []
            for d in (-1e-2, 1e-2):
                gru.theta[i] = keep + d
                values.append(float(gru.output(hs, goal)[0].astype(np.float64).sum()))
            gru.theta[i] = keep
            assert abs((values[1] - values[0]) / 2e-2 - grad[i]) < 2e-2
    assert np.allclose(np.exp(gru.output(np.repeat(hs[:1], 6, 0), np.arange(6))[0]).sum(), 1, atol=1e-4)


def test_state_goes_through_windows():
    gru = lm.Gru(lm.Shape(np.array([50.0, 20, 10, 5, 3, 1])))
    gru.theta[:] = np.random.default_rng(0).normal(0, 0.5, len(gru.theta))
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 6, n) for n in (1, 3, 40, 7, 100)]
    whole, cut = gru.score(docs, window=1000), gru.score(docs, window=7)
    assert np.allclose(whole, cut, atol=1e-3)
    assert np.allclose(whole, [gru.score([d])[0] for d in docs], atol=1e-3)


def test_lm_base_equals_brute_force_and_is_beaten(spark):
    rng = random.Random(3)
    docs = []
    for i in range(500):
        language = [["a%d" % k for k in range(30)], ["b%d" % k for k in range(30)]][i % 2]
        docs.append((i, " ".join(rng.choices(language, k=rng.randint(1, 40))).title() + (" new%d" % i)))
    docs += [(600, None), (601, ""), (0, docs[0][1]), (None, "a1 a2")]
    out = lm.score(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string"), every=1, rounds=8).collect()
    words = lambda t: (t or "").lower().split()
    teach = Counter(w for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in [*words(t), "\n"])
    n, v = sum(teach.values()), len(teach)
    want = sorted((round(sum(math.log10((teach[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), "\n"]), 6), len(words(t)) + 1, sum(teach[w] > 0 for w in [*words(t), "\n"]), n) for _, t in docs)
    assert sorted((round(r["base_score"], 6), r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out) == want
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lm_learns_from_every_training_document(spark):
    """A language that only documents outside one hash class of eight speak; its next word follows from the last."""
    rng = random.Random(4)
    ids = spark.range(3000).selectExpr("id", "pmod(xxhash64(id), 8) = 0 AS eighth").collect()
    docs = []
    for i, eighth in ids:
        if eighth:
            text = rng.choices(["a%d" % k for k in range(30)], k=40)
        else:
            at = rng.randrange(30)
            text = ["b%d" % ((at + k) % 30) for k in range(40)]
        docs.append((i, " ".join(text)))
    out = lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    eighth = dict(tuple(r) for r in ids)
    held = [r for r in out if r["held_out"] and not eighth[r["doc_id"]]]
    assert len(held) > 300
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)


def test_lm_knows_more_words_with_more_training_tokens(spark, monkeypatch):
    assert lm.HIDDEN >= 32 and lm._items(10**6) >= 4096 and lm._items(10**10) >= 100_000
    sizes = []
    make = lm.Shape
    monkeypatch.setattr(lm, "Shape", lambda counts: sizes.append(len(counts)) or make(counts))
    monkeypatch.setattr(lm, "VOCABULARY", 50)
    for n in (100, 1600):
        docs = [(i, " ".join("w%d" % (k * 7 + i) for k in range(20))) for i in range(n)]
        lm.score(spark.createDataFrame(docs, "doc_id long, text string"), rounds=0)
    tokens = 21 * sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(1600))
    assert sizes == [52, math.isqrt(tokens) + 2]


def test_lm_counts_are_right_where_the_head_is_full(spark):
    """One text of 70,000 words that occur once each: all counts but one are in one step, and more than the head holds."""
    teach = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 5 != 1)
    held = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 5 == 1)
    docs = [(teach, " ".join("w%d" % k for k in range(70_000))), (held, "w1 w69999 other")]
    counts = spark.createDataFrame([(b"\n", 1), *((b"w%d" % k, 1) for k in range(70_000))], "word binary, c long")
    head = [bytes(r["word"]) for r in lm._head(counts, lm.HEAD)]
    assert head == [b"\n", *sorted(b"w%d" % k for k in range(70_000))[: lm.HEAD]]
    out = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), rounds=0).collect()}
    once, never = (math.log10(c / (70_001 + 0.5 * 70_002)) for c in (1.5, 0.5))
    assert (out[teach]["n_known"], out[held]["n_known"]) == (70_001, 3)
    assert abs(out[teach]["base_score"] - 70_001 * once) < 1e-3
    assert abs(out[held]["base_score"] - (3 * once + never)) < 1e-9
    # the end has the head's lowest count: words beyond the head still meet theirs
    few = spark.createDataFrame([(b"\n", 1), (b"a", 9), (b"b", 5), (b"c", 4)], "word binary, c long")
    assert [bytes(r["word"]) for r in lm._head(few, 2)] == [b"a", b"b", b"\n"]


def test_lm_counts_beyond_a_small_head(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 5)
    monkeypatch.setattr(lm, "VOCABULARY", 3)
    rng = random.Random(5)
    docs = [(i, " ".join("w%d" % min(rng.randrange(40), rng.randrange(40)) for _ in range(60))) for i in range(12)]
    out = lm.score(spark.createDataFrame(docs, "doc_id long, text string"), rounds=0).collect()
    teach = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*t.split(), "\n"])
    n, v = sum(teach.values()), len(teach)
    want = {i: sum(math.log10((teach[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.split(), "\n"]) for i, t in docs}
    assert all(abs(r["base_score"] - want[r["doc_id"]]) < 1e-6 for r in out)


def test_url_parts_and_rules(spark):
    rows = [
        (1, "https://WWW.Example.COM/en/7?x#y"),
        (2, "http://a.example.com/en/8"),
        (3, "ftp://example.net/de/8/x"),
        (4, "x://net/de/1"),
        (5, "https://notcom/en/"),
        (6, "https://example.org#/es/"),
        (7, None),
        (8, "no scheme/en/"),
        (9, "https://example.org/es/ÄÖ"),
        (10, "://"),
    ]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge(df).collect()}
    assert got[1] == ("www.example.com", "/en/7", "example.com/en/7")
    assert got[2] == ("a.example.com", "/en/8", "com/en/")
    assert got[3] == ("example.net", "/de/8/x", "example.net/de/8")
    assert got[4] == ("net", "/de/1", "net/de/")
    assert got[5] == ("notcom", "/en/", None)
    assert got[6] == ("example.org", "", None)
    assert got[7] == got[8] == got[10] == ("", "", None)
    assert got[9] == ("example.org", "/es/ÄÖ", "org/es/")
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
    assert verdicts[1] == "allow" and {verdicts[i] for i in (2, 3, 4, 9)} == {"block"}


def test_url_rules_have_the_verdicts_of_the_contract(spark):
    """Each rule alone and where a longer one overrules it, whatever the model says of the name."""
    want = {
        "https://a.com/en/1": ("com/en/", "block"),
        "https://example.com/en/7": ("example.com/en/7", "allow"),
        "https://library.net/de/1": ("net/de/", "allow"),
        "https://free-casino.net/de/1": ("net/de/", "allow"),
        "https://x.example.net/de/7": ("net/de/", "allow"),
        "https://x.example.net/de/80": ("example.net/de/8", "block"),
        "https://library.org/es/1": ("org/es/", "block"),
    }
    df = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in urls.judge(df).orderBy("page_id").collect()] == list(want.values())


def test_url_model_on_held_out_rows(spark):
    table = urls.label()
    hosts = sorted({u.split("/")[2] for u, _ in table})
    held = set(hosts[::5])
    teach = [x for x in table if x[0].split("/")[2] not in held]
    test = [x for x in table if x[0].split("/")[2] in held]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(test)], "page_id long, url string, y int")
    rows = urls.judge(df, rules=(), table=teach).collect()
    right = sum((r["verdict"] == "block") == bool(test[r["page_id"]][1]) for r in rows)
    assert right >= 0.75 * len(rows)
    clear = spark.createDataFrame([(0, "http://www.cheap-pills.example.com/fr/9"), (1, "https://library.example.org/fr/12")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(clear).collect()} == {0: "block", 1: "allow"}


def test_late_updates_equal_dense_ones():
    """Rows whose missed updates are made up for at once end where an Adam that moves all rows in every update brings them."""
    for size in (1.0, 1e-5, 1e-7):
        rng = np.random.default_rng(0)
        first = rng.normal(0, 0.1, (40, 6)).astype(np.float32)
        rows, dense, m, v = first.copy(), first.copy(), np.zeros(240, np.float32), np.zeros(240, np.float32)
        late = lm._Late(rows, [0.006 * min(1, (w + 1) / 20) for w in range(300)])
        for w, pace in enumerate(late.pace):
            items = np.unique((40 * rng.random(6) ** 3).astype(int))
            grad = np.zeros_like(dense)
            grad[items] = rng.normal(0, size, (len(items), 6))
            given = late.take(items, w)
            assert np.abs(given - dense[items]).max() < 0.01 * max(1e-3, np.abs(dense - first).max())
            late.put(items, grad[items], 1.0, w)
            lm._adam(dense.reshape(-1), grad.reshape(-1), m, v, 1.0, pace, w + 1)
        late.finish()
        assert np.abs(rows - dense).max() < 0.01 * np.abs(dense - first).max()


def test_output_of_large_logits_and_many_buffers(monkeypatch):
    rng = np.random.default_rng(3)
    gru = lm.Gru(lm.Shape(np.sort(rng.integers(1, 1000, 50))[::-1].astype(float)))
    gru.theta[:] = rng.normal(0, 40, len(gru.theta))
    hs, goal = rng.normal(0, 1, (70, lm.HIDDEN)).astype(np.float32), rng.integers(0, 50, 70)
    results = []
    for most in (1 << 18, 8):
        monkeypatch.setattr(lm, "FLAT", most)
        grad = np.zeros_like(gru.theta)
        results.append((*gru.output(hs, goal, grad), grad))
    for x, y in zip(*results, strict=True):
        assert np.isfinite(x).all() and np.allclose(x, y, rtol=1e-4, atol=1e-3)
    s = gru.shape
    for h, t, lp in zip(hs.astype(float), goal, results[0][0], strict=True):
        c = s.cls[t]
        of_class, inside = h @ gru.wc + gru.bc, gru.ww[s.begin[c] : s.begin[c + 1]] @ h + gru.bw[s.begin[c] : s.begin[c + 1]]
        want = of_class[c] - np.logaddexp.reduce(of_class) + inside[t - s.begin[c]] - np.logaddexp.reduce(inside)
        assert abs(want - lp) < 1e-2
