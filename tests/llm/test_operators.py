"""Each operator against brute force or a round trip, with nulls, empties, ties, repeated rows and clashing columns."""

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinforge.llm import ann, decontaminate, html, langid, license_scan, lm, mixing, near_duplicates, tokens, warc
from kinforge.llm.common import tokens_of, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, words int"


def docs_of(spark, rows):
    """Documents with two extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.0, 1) for i, t, lang, s in rows], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture()
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        text = prose(rng, rng.choice([3, 30, 80]))
        rows.append((i * 3, text, "en", f"s{i % 3}"))
    base = prose(rng, 120).split()
    for i in range(90):  # a group larger than a hot bucket
        near = list(base)
        near[rng.randrange(120)] = f"new{i}"
        rows.append((1000 + i, " ".join(near), "en", None))
    rows += [(2000, None, None, "s1"), (2001, "", "de", "s1"), (2002, "!!!", "de", "s2"), (None, prose(rng, 20), "fr", None)]
    rows += [rows[5], rows[5], rows[60]]
    return docs_of(spark, rows)


def test_jaccard_join_equals_brute_force(spark, corpus):
    rows = corpus.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = words_of(r["text"])
        m = min(5, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set())
    n = len(rows)
    match = [[bool(sets[i]) and i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in range(n) if match[i][j])]) for i in range(n)]
        if new == label:
            break
        label = new
    ids = [r["doc_id"] for r in rows]
    name = {c: min((ids[i] for i in range(n) if label[i] == c and ids[i] is not None), default=None) for c in label}
    want = sorted((ids[i] if ids[i] is not None else -1, name[label[i]] if name[label[i]] is not None else -1, sum(match[i])) for i in range(n))
    got = sorted(tuple(-1 if v is None else v for v in r) for r in near_duplicates.jaccard_join(corpus).collect())
    assert got == want
    kept = near_duplicates.one_of_each(corpus).select("doc_id", "text").collect()
    assert len(kept) == len({(k, t) for k, t in map(tuple, kept)}) == len(set(label)) - 0
    assert near_duplicates.jaccard_join(corpus.limit(0)).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = near_duplicates.banding(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands <= 40


def test_anisotropic_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    rows = [(i, [float(v) for v in r], 1, 0.5) for i, r in enumerate(x)]
    rows += [(600 + i, [float(v) for v in x[7]], 1, 0.5) for i in range(20)]  # ties
    rows += [(None, [1.0] * 16, 1, 0.5), (700, None, 1, 0.5), (750, [0.0] * 16, 1, 0.5), (800, [float("nan")] * 16, 1, 0.5), (801, [None] + [1.0] * 15, 1, 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")
    got: dict = {}
    for r in ann.neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids = np.array([r[0] for r in rows[:620]])
    unit = np.array([r[1] for r in rows[:620]], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = 0
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[q]
        s[q] = -9
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        found += len(set(best) & {v for v, _ in got[q]})
        assert [v for _, v in got[q]] == sorted((v for _, v in got[q]), reverse=True)
    assert found >= 0.9 * 5 * len(got) and 750 not in got and 700 not in got
    assert ann.neighbours(df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted(r["vec_id"] for r in ann.neighbours(few).collect()) == [1, 2]


def test_search_is_exact_among_near_copies(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate((rng.normal(size=(400, 16)), rng.normal(size=16) + 1e-4 * rng.normal(size=(1000, 16)), 1e200 * rng.normal(size=(10, 16))))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(1395, x[1300].tolist()), (1395, (-x[1300]).tolist())]  # a repeated id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    unit = np.array([r[1] for r in rows])
    unit /= np.abs(unit).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = np.array([r[0] for r in rows])
    for q in range(0, len(x), 50):
        best: dict = {}
        for i, s in zip(ids, unit @ unit[q], strict=True):
            best[i] = max(s, best.get(i, -2))
        best.pop(q)
        assert got[q] == sorted(best, key=lambda i: (-best[i], i))[:5]
    assert len(got) == 29


def test_wu_manber_equals_brute_force(spark):
    rng = random.Random(9)
    items = [(str(i), prose(rng, n, 12)) for i, n in enumerate([1, 2, 3, 5, 9, 10, 14, 30, 10])] + [("9", "w1x w2x"), ("9", "w1x w2x")]
    bench = spark.createDataFrame([(int(i), t) for i, t in items] + [(77, None), (None, "w1x"), (78, "")], "item_id long, text string")
    texts = [prose(rng, n, 12) for n in (0, 1, 5, 40, 300)] + [items[6][1].upper() + " zz " + items[7][1], None, ""]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    want = []
    for i, t in enumerate(texts):
        w = words_of(t)
        hit, found = set(), set()
        for item, text in items:
            v = words_of(text)
            m = min(10, len(v))
            for a in range(len(v) - m + 1):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == v[a : a + m]:
                        hit.update(range(p, p + m))
                        found.add(item)
        want.append((i, len(w), len(hit), sorted(found)))
    for portion in (4 << 20, 30):  # one portion, and many
        got = decontaminate.scan_documents(docs, bench, portion_bytes=portion).select("doc_id", "n_words", "n_hit", "items").orderBy("doc_id")
        assert [tuple(r) for r in got.collect()] == want
        assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench, portion_bytes=portion).collect()) == [i for i, _, h, _ in want if not h]
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="content"><div class="article-body"><h2>Head &amp; line</h2><p>First   <b>bold</b> words<br>here &eacute;.</p><!-- x --><p>Second one of many words
<div class="ad">Buy</div><form><input><label>mail</label></form><p>Third.</div></div>
<div id="comments"><p>Reader says many many many words that are long and longer still and on and on</p></div>
<aside>Related</aside><footer>&copy; 2020</footer></body></html>"""


def test_html_text(spark):
    want = "Head & line\nFirst bold words here é.\nSecond one of many words\nThird."
    assert html.extract(PAGE, []) == want
    rows = [(1, "http://a.example/1", PAGE), (1, "http://a.example/1", PAGE), (2, "http://A.example:80/2", None), (3, None, "plain <text"), (None, "bad url", "<p>a<p>b"), (5, "http://b.example/", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html.extract_pages(pages).select("page_id", "text", "n_chars").collect()]
    assert sorted(got, key=str) == sorted([(1, want, len(want))] * 2 + [(2, "", 0), (3, "plain <text", 11), (None, "a\nb", 3), (5, "", 0)], key=str)
    assert html.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("body", "want"), [
    ("<div class='layout with-sidebar'><div class='content'><p>a long text of the page</p></div><div class='sidebar'>side</div></div>", "a long text of the page"),
    ("<div class='page sidebar-left'><main><p>a long text</p></main><nav>menu</nav></div>", "a long text"),
    ('<p title="abc>Text one', "Text one"),
    ('<p title="abc>Text</p><p class=x>two</p>', "Text\ntwo"),
    ('<p title="a > b">Text</p>', "Text"),
    ("<p title='the hidden gem'>kept</p>", "kept"),
    ("<article><p>own words of it</p></article><div class='related'><p>other words that are many more than the own ones of the page</p></div>", "own words of it"),
])
def test_html_wrappers_and_odd_tags(body, want):
    assert html.extract(f"<html><body>{body}</body></html>", []) == want


def test_html_consensus_equals_brute_force(spark):
    """Votes of all pages added up by hand, then the winning path of each page by the rule as it is stated."""
    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(99)}" for _ in range(n))
    rows, truth = [], []
    for i in range(120):
        text, kind = [words(rng.randrange(3, 40)) for _ in range(rng.randrange(1, 6))], rng.randrange(4)
        inner = "".join(f"<p>{t}</p>" for t in text)
        body = {
            0: f"<nav>{words(5)}</nav><div class='content'>{inner}</div><footer>{words(9)}</footer>",
            1: f"<div class='top menu'>{words(4)}</div><article class='p{i}'>{inner}<aside>{words(3)}</aside></article>",
            2: f"<table><tr><td class='nav'>{words(3)}</td><td class='c'>{inner}</td></tr></table>",
            3: f"<div>{inner}</div>",
        }[kind]
        rows.append((i, rng.choice(["http://a.x/1", "https://A.x:8/2", "http://b.x/", None]), f"<html><body>{body}</body></html>"))
        truth.append("\n".join(text))
    votes: dict = {}
    for _, url, page in rows:
        best = html.vote(page)
        if url and best:
            sums = votes.setdefault(("a.x" if "a.x" in url.lower() else "b.x", best[0]), [0.0, 0])
            sums[0] += best[1]
            sums[1] += 1
    want = []
    for i, url, page in rows:
        host = url and ("a.x" if "a.x" in url.lower() else "b.x")
        ranked = sorted((-round(v[0], 3), path) for (h, path), v in votes.items() if h == host and v[1] > 1)
        blocks = html.blocks_of(page)
        inside = [{up.path() for up in node.chain() if up.tag in html.CONTAINER} for _, node in blocks]
        own, score = html.vote(page)
        held = lambda p, q=None: sum(len(t.split()) for (t, _), at in zip(blocks, inside, strict=True) if p in at and (q is None or q in at))  # noqa: B023, E731
        path = next((p for less, p in ranked if -less >= score and 2 * held(p, own) > held(own)), own)
        path = path if ranked and any(p == path for _, p in ranked) else own
        want.append((i, "\n".join(t for (t, _), at in zip(blocks, inside, strict=True) if path in at)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in html.extract_pages(pages).collect())
    assert got == want and [t for _, t in got] == truth


def test_html_text_of_hosts_with_many_templates(spark):
    long, short = "word " * 60, "teaser"
    page = lambda body: f"<html><body>{body}</body></html>"
    rows = [page(f"<div><p>{long}{i}</p></div>") for i in range(30)]  # the host's commonest path is html>body>div
    rows += [page(f"<div>{short}</div><article><p>{long}x{i}</p></article>") for i in range(3)]
    for kind in range(8):  # more templates than there were places
        rows += [page(f'<div>{short}</div><section class="t{"abcdefgh"[kind]}"><p>{long}y{i}</p></section>') for i in range(2)]
    rows += [page(f'<div>{short}</div><div class="only"><p>{long}z</p></div>')]
    pages = spark.createDataFrame([(i, "http://h.example/", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    for r in html.extract_pages(pages).collect():
        assert r["text"].count("word") == 60 and short not in r["text"]


@pytest.mark.parametrize(("body", "want"), [
    ("<article class='post comments-open'><p>kept text</p></article>", "kept text"),
    ("<article id='discussion-42'><p>kept text</p></article>", "kept text"),
    ("<div class='post comments-open'><p>kept text</p></div>", "kept text"),
    ("<div title='the hidden cost'><p>kept text</p></div>", "kept text"),
    ("<div class='x hidden md:block'><p>kept text</p></div>", "kept text"),
    ("<p>seen</p><div hidden><p>gone</p></div><div hidden=''>gone</div><div id=a hidden>gone</div>", "seen"),
    ("<p>a</p><svg width='1'/><p>b</p><svg><text>no</text></svg><p>c</p><svg><p>d</p>", "a\nb\nc\nd"),
    ("<p>a <math/> b <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='t'>x=2</annotation></math> c</p>", "a b x=2 c"),
    ("<div class='paywall'>Pay</div><article hidden><p>whole text</p></article>", "whole text"),
    ("<article style='display:none'><div class='sidebar'><p>whole text</p></div></article><nav>menu</nav>", "whole text"),
    ("<article><p>text here</p><div id='comments'><p>said</p></div><ol class='comment-list'><li class='comment' id='comment-7'><article><p>said</p></article></li></ol><div id='respond'>say</div></article>", "text here"),
    ("<div class='cookie-notice'>We use cookies</div>", ""),
])
def test_html_names_do_not_take_articles(body, want):
    assert html.extract(f"<html><body>{body}</body></html>", []) == want


def test_katz_sums_to_one_and_scores(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40, 30), "en", "s") for i in range(200)] + [(1000, None, None, None), (1001, "", None, None), (None, "new words here", None, None), (7, rows7 := "w1x  w2x", "en", "s"), (7, rows7, "en", "s")]
    docs = docs_of(spark, rows)
    out = lm.score(docs, shards=3, order=2).collect()
    assert len(out) == len(rows)
    train, n = {}, 0
    pairs: dict = {}
    for i, t, *_ in rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 10:
            before = None
            for w in [*tokens_of(t), 0]:
                train[w] = train.get(w, 0) + 1
                pairs.setdefault(before, {}).setdefault(w, 0)
                pairs[before][w] += 1
                before, n = w, n + 1
    counts = lambda values: np.array([sum(v == r for v in values) for r in range(1, lm.CUT + 2)])
    base = lm.Unigrams(np.array([n, len(train), *counts(list(train.values()))]))
    p1 = lambda w: float(base.p(np.array([train.get(w, 0)]))[0])
    assert sum(map(p1, train)) + base.unknown == pytest.approx(1)
    d = lm.discounts(counts([c for x in pairs.values() for c in x.values()]))

    def p2(h, w):
        seen = pairs.get(h, {})
        total = sum(seen.values())
        types = np.array([[sum(c == r for c in seen.values()) for r in range(1, lm.CUT + 1)]], float)
        scale, alpha = lm.backoff(np.array([total]), types, np.array([sum(map(p1, seen))]), d)
        return float(lm.discounted(np.array([seen[w]]), d)[0] * scale[0]) if w in seen else float(alpha[0]) * p1(w)

    assert sum(p2(b"w1x", w) for w in train) + p2(b"w1x", b"never") == pytest.approx(1)
    want = []
    for i, t, *_ in rows:
        w = [*tokens_of(t), 0]
        want.append((len(w), sum(x in train for x in w), sum(np.log10((train.get(x, 0) + 0.1) / (n + 0.1 * (len(train) + 1))) for x in w), sum(np.log10(p2(h, x)) for h, x in zip([None, *w[:-1]], w, strict=True))))
    got = sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in out)
    assert np.allclose(got, sorted(want), atol=1e-6) and {r["train_tokens"] for r in out} == {n}
    assert lm.score(docs.limit(0), shards=2).count() == 0


def test_katz_of_order_three(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 30, 12), "en", "s") for i in range(120)] + [(900, None, None, None), (901, "", None, None), (None, "new words w1x", None, None), (7, "w1x w2x", "en", "s")]
    grams: list[dict] = [{}, {}, {}]  # context -> word -> count
    n, texts = 0, [(zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0, [None, None, *tokens_of(t), 0]) for i, t, *_ in rows]
    for held, w in texts:
        for j in range(2, len(w) if not held else 0):
            n += 1
            for k in range(3):
                own = grams[k].setdefault(tuple(w[j - k : j]), {})
                own[w[j]] = own.get(w[j], 0) + 1
    of = lambda k: [c for x in grams[k].values() for c in x.values()]
    counts = lambda k: np.array([sum(v == r for v in of(k)) for r in range(1, lm.CUT + 2)])
    base = lm.Unigrams(np.array([n, len(grams[0][()]), *counts(0)]))
    d = [None, lm.discounts(counts(1)), lm.discounts(counts(2))]

    def p(w, h):
        if not h:
            return float(base.p(np.array([grams[0][()].get(w, 0)]))[0])
        seen, own = grams[len(h)].get(h, {}), d[len(h)]
        types = np.array([[sum(c == r for c in seen.values()) for r in range(1, lm.CUT + 1)]], float)
        scale, alpha = lm.backoff(np.array([sum(seen.values())]), types, np.array([sum(p(x, h[1:]) for x in seen)]), own)
        return float(lm.discounted(np.array([seen[w]]), own)[0] * scale[0]) if w in seen else float(alpha[0]) * p(w, h[1:])

    assert sum(p(w, (b"w1x", b"w2x")) for w in grams[0][()]) + p(b"never", (b"w1x", b"w2x")) == pytest.approx(1)
    want = sorted(sum(np.log10(p(w[j], tuple(w[j - 2 : j]))) for j in range(2, len(w))) for _, w in texts)
    for unit, shards in ((1 << 20, 3), (400, 7), (60, 2)):  # one unit a task, and many: contexts within and across units, split ones
        got = sorted(r["score"] for r in lm.score(docs_of(spark, rows), shards=shards, order=3, unit_tokens=unit).collect())
        assert np.allclose(got, want, atol=1e-6)


def test_katz_shuffles_each_reply_once(spark):
    rng = random.Random(8)
    docs = docs_of(spark, [(i, prose(rng, 30, 60), "en", "s") for i in range(120)]).coalesce(1)
    units, shards = 10, 4  # 13 documents have 403 tokens
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    old = stages()
    before = {old.apply(i).stageId() for i in range(old.size())}
    assert lm.score(docs, shards=shards, order=4, unit_tokens=400).count() == 120
    now = stages()
    moved = [x.shuffleWriteRecords() for i in range(now.size()) if (x := now.apply(i)).stageId() not in before]
    assert units * shards <= max(moved) <= units * shards + units  # the replies of one round and the units, not of all rounds


def test_language_id(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcde ", "bb": "defgh ", "cc": "жзийк "}
    rows = [(i, "".join(rng.choice(a) for _ in range(300)), lang, "s") for i, (lang, a) in enumerate(list(alphabets.items()) * 40)]
    rows += [(900, None, "aa", None), (901, "", None, None), (902, "12 !!", "bb", None), (None, "a" * 10, None, None)]
    docs = docs_of(spark, rows)
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang, _ in rows[:120])
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[5]["held_out"] == (zlib.crc32(b"5") % 4 == 2)
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs.limit(0)).count() == 0
    whole, old = langid.counted("ab cé " * 3000), langid.CHUNK
    try:
        langid.CHUNK = 1000
        cut = langid.counted("ab cé " * 3000)
    finally:
        langid.CHUNK = old
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_language_id_equals_brute_force(spark):
    from collections import Counter

    rng = random.Random(14)
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 7))) for _ in range(30)) + rng.choice("!?\U0001f600É"), lang, "s") for i, (lang, a) in enumerate([("aa", "abcdeé"), ("bb", "cdefgh"), ("cc", "efghij")] * 30)]
    rows += [(500, "q", "bb", "s"), (501, "abc " * 5, "aa", "s")]

    def grams(text):
        runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        out = Counter(c for w in runs for c in w)
        row = [c for w in runs for c in [None, *w]] + [None] if runs else []
        out.update((a, b) for a, b in zip(row, row[1:], strict=False))
        out.update((a, b, c) for a, b, c in zip(row, row[1:], row[2:], strict=False) if b is not None)
        return out

    code = lambda g: sum((langid.EDGE.item() if c is None else ord(c)) << (21 * k) for k, c in enumerate(reversed(g if isinstance(g, tuple) else (g,))))
    order = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:300]]
    learned: dict = {}
    for i, t, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            learned.setdefault(lang, Counter()).update(grams(t))
    places = {lang: {g: k for k, g in enumerate(order(c))} for lang, c in sorted(learned.items())}
    want = []
    for i, t, *_ in rows:
        own = order(grams(t))
        cost = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(own)) for lang, p in places.items()}
        best = min(cost, key=lambda lang: (cost[lang], lang))
        want.append((i, best, round(1 - cost[best] / (300 * len(own)), 9)))
    docs = docs_of(spark, rows).withColumns({"__text": F.lit("x"), "gram": F.lit(1)})
    assert sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.identify(docs).collect()) == want
    kept = langid.predict(docs, langid.learn(docs), names=("p", "q"))
    assert kept.columns == [*docs.columns, "p", "q"] and kept.where("score <> 0 or __text <> 'x'").count() == 0


def test_index_cuts_give_each_line_once():
    lines = [f"line {i} {'x' * (i % 7)}".encode() for i in range(200)]
    raw = io.BytesIO()
    writer = warc.ZipWriter(raw)
    for name, data in (("indexes/a.cdxj", b"\n".join(lines) + b"\n"), ("indexes/b.cdx.gz", warc.gzip.compress(b"\n".join(lines)))):
        writer.begin(name)
        writer.write(data)
        writer.end()
    writer.close()

    class Sized(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    package = warc.ZipReader(Sized(raw.getvalue()))
    size = package.members["indexes/a.cdxj"][2]
    for span in (1, 5, 64, 1000, size):
        for step in (3, 50, 1 << 20):
            if span > 1 or step > 3:
                got = [x for at in range(0, size, span) for x in warc.Cut(package, "indexes/a.cdxj").lines(at, min(size, at + span), step)]
                assert got == lines, (span, step)
    assert list(warc.Cut(package, "indexes/b.cdx.gz").lines(0, 9)) == lines


def test_packages_are_of_bounded_size_and_described(spark):
    import json
    import zipfile

    pages = spark.createDataFrame([(i, f"http://www.a{i % 3}.example/p?{i}", f"<p>{i % 40} " + "y" * 50) for i in range(120)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, package_bytes=2000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == 120
    with zipfile.ZipFile(manifest.first()["path"].removeprefix("file://")) as z:
        index = z.read(warc.INDEX).decode().splitlines()
        assert index == sorted(index) and index[0].startswith("example,a0)/p?") and index[0].split(" ")[1] == "20000101000000"
        about = json.loads(z.read("datapackage.json"))
        for r in about["resources"]:
            assert len(z.read(r["path"])) == r["bytes"] and "sha256:" + warc.hashlib.sha256(z.read(r["path"])).hexdigest() == r["hash"]
    rows = warc.read_archives(manifest, span=300).collect()
    assert sorted(r["page_id"] for r in rows) == list(range(120)) and sum(r["record_type"] == "response" for r in rows) == 40
    assert all(r["refers_to"] == r["page_id"] % 40 for r in rows if r["record_type"] == "revisit")


def test_warc_round_trip(spark):
    rows = [(3, "http://x/ 1", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (9, "u", "alone"), (9, "u", "alone"), (8, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    got = sorted((tuple(r) for r in warc.warc_table(pages).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min(j for j, _, x in rows if (x or "") == (h or "") and j is not None)
        own = i == first
        want.append((i, len(raw), warc.base32_sha1(raw), "response" if own else "revisit", None if own else first))
    assert got == sorted(want, key=str)
    assert warc.warc_table(pages.limit(0)).count() == 0


def test_zip_reader_reads_plain_zip():
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("archive/data.warc", b"0123456789")
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 no end"

    class Sized(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = warc.ZipReader(Sized(raw.getvalue()))
    assert reader.read("archive/data.warc", 3, 4) == b"3456"
    with pytest.raises(ValueError):
        reader.range_of("packed")
    own = io.BytesIO()
    writer = warc.ZipWriter(own)
    writer.begin("a")
    writer.write(b"hello")
    writer.end()
    writer.close()
    assert zipfile.ZipFile(io.BytesIO(own.getvalue())).read("a") == b"hello"


def test_license_rules(spark):
    assert len(license_scan.rules()) > 250
    text = "Licensed under the Apache License, Version 2.0. MIT-License; released under the GNU Lesser General Public License v2.1 or later"
    got = license_scan.scan_text(text)
    assert (got["n_base"], got["first_word"], got["last_word"]) == (3, 3, 15) and got["base_labels"] == "apache,gpl,mit"
    assert got["labels"] == "apache,gpl,lgpl,mit" and got["score"] == 1.0
    kept = [(d["first_word"], d["first_word"] + d["n_words"]) for d in got["detections"]]
    assert not any(a != b and a[0] >= b[0] and a[1] <= b[1] for a in kept for b in kept)
    docs = docs_of(spark, [(1, None, "en", "s"), (1, "", "en", "s"), (None, "no licence here", "en", "s"), (4, "mit license " * 2000, "en", "s")])
    rows = license_scan.scan(docs).collect()
    assert sorted(r["n_base"] for r in rows) == [0, 0, 0, 2000] and rows[0]["labels"] == ""
    assert license_scan.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("line", "labels"), [
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("GNU GPL version 3", "gpl"), ("GPLv2", "gpl"), ("GPL-2.0-or-later", "gpl"), ("This is gplv3+ code", "gpl"),
    ("uses the LGPL", "lgpl"), ("LGPL-2.1-only", "lgpl"), ("AGPLv3", "agpl"), ("GNU Lesser GPL v3", "lgpl"), ("BSD-3-Clause", "bsd"), ("the 2-clause BSD", "bsd"),
    ("License: BSD", "bsd"), ("CC BY-SA 4.0", "cc-by-sa"), ("CC-BY-4.0", "cc-by"), ("CC BY-NC-SA 3.0", "cc-by-nc-sa"), ("by-nc-nd 4.0", "cc-by-nc-nd"),
    ("shared under CC BY", "cc-by"), ("CC0 1.0 Universal", "cc0"), ("Apache-2.0", "apache"), ("Apache v2", "apache"), ("licensed under Apache", "apache"),
    ("the Unlicense", "unlicense"), ("Released under MIT.", "mit"), ("MIT-licensed", "mit"), ("MIT OR Apache-2.0", "apache,mit"), ("MPL-2.0", "mpl"), ("MPL v2", "mpl"),
    ("EPL-2.0", "epl"), ("CDDL-1.1", "cddl"), ("EUPL v1.2", "eupl"), ("BSL-1.0", "boost"), ("BSL 1.1", "busl"), ("SSPL", "sspl"), ("OFL-1.1", "ofl"), ("WTFPL", "wtfpl"),
    ("ODbL", "odbl"), ("0BSD", "bsd-0"), ("license: ISC", "isc"), ("under zlib", "zlib"), ("Artistic-2.0", "artistic"),
    ("Creative Commons Attribution 4.0 International License", "cc-by"), ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"),
    ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "cc-by-nc-sa"), ("SPDX-License-Identifier: GPL-3.0-only", "gpl"),
    ("http://creativecommons.org/licenses/by-nc/4.0/", "cc-by-nc"), ("GPL-2.0 with Classpath exception", "gpl-classpath"),
    ("Wir fahren mit dem Bus, cc by mail, apache helicopter, zlib 1.2, FreeBSD 13", ""),
])
def test_license_short_names(line, labels):
    got = license_scan.scan_text(line)
    assert got["labels"] == labels and (got["score"] > 0) == bool(labels)


def example_of(pattern: str) -> str:
    """A shortest text that the pattern matches, by its parse tree."""
    from re import _constants as C
    from re import _parser

    def make(tree) -> str:
        out = ""
        for op, arg in tree:
            if op is C.LITERAL:
                out += chr(arg)
            elif op is C.SUBPATTERN:
                out += make(arg[3])
            elif op is C.BRANCH:
                out += make(arg[1][0])
            elif op is C.MAX_REPEAT:
                out += make(arg[2]) * arg[0]
            elif op is C.IN:
                kind, value = arg[0]
                out += "x" if kind is C.NEGATE else chr(value if kind is C.LITERAL else value[0])
            elif op is C.NOT_LITERAL:
                out += "x"
            else:
                assert op is C.ASSERT_NOT
        return out

    return make(_parser.parse(pattern))


def test_every_license_rule_matches_its_example():
    for rule in license_scan.rules():
        text = example_of(rule.pattern.pattern.decode())
        assert b" " + rule.keyword in b" " + text.encode(), rule.name
        assert rule.pattern.search(text.encode()), rule.name
        assert license_scan.scan_text(f"aa {text} bb")["detections"], rule.name


def test_license_scan_equals_brute_force():
    rng = random.Random(5)
    parts = ["mit license", "apache license", "general public license", "licensed under the", "version 2 0", "gpl", "the", "cc by 4 0", "license", "public", "apache", "or later", "zlib", "bsd"]
    for _ in range(60):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))
        words, got = text.split(), license_scan.scan_text(text)
        base = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert got["n_base"] == len(base) and got["first_word"] == min((i for i, _ in base), default=None) and got["last_word"] == max((i for i, _ in base), default=None)
        raw = text.encode()
        found = sorted(((r.priority, m.start() - m.end(), m.start(), m.end(), r) for r in license_scan.rules() for m in r.pattern.finditer(raw)), key=lambda x: x[:3])
        kept: list = []
        for x in found:
            if not any(k[2] <= x[2] and k[3] >= x[3] for k in kept):
                kept.append(x)
        want = [(x[4].name, raw[: x[2]].count(b" "), raw[x[2] : x[3]].count(b" ") + 1) for x in kept]
        assert [(d["rule"], d["first_word"], d["n_words"]) for d in got["detections"]] == want
        assert got["labels"] == ",".join(sorted({label for _, label in base} | {x[4].label for x in kept}))
        assert got["score"] == max([0.65 * bool(base), *(x[4].weight for x in kept)])


def test_license_scan_of_very_long_texts():
    import time

    took = []
    for n in (2_000, 20_000):
        began = time.perf_counter()
        got = license_scan.scan_text("released under the mit license and apache license version 2 0 " * n)
        took.append(time.perf_counter() - began)
        assert got["n_base"] == 2 * n and len(got["detections"]) == 2 * n
    assert took[1] < 25 * took[0] + 0.5  # ten times the text


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5], [7, 7, 7], np.sort(rng.integers(0, 1 << 40, 1000)), np.cumsum(rng.integers(0, 3, 5000))):
        values = np.asarray(values, np.int64)
        ef = tokens.EliasFano.of(values)
        assert (ef.select_run(0, len(values)) == values).all() and [ef.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()
        for a, b in ((1, 2), (63, 65), (64, 128), (100, 777), (3, len(values))):
            if a <= b <= len(values):
                assert (ef.select_run(a, b) == values[a:b]).all()
        assert len(ef.low) + len(ef.high) <= len(values) * (2 + max(1, np.log2((values.max() if len(values) else 1) / max(1, len(values)) + 1))) / 8 + 40


def test_token_files(spark):
    from tokenizers import Tokenizer

    texts = ["Hello, world", "a  b", " lead", "trail ", "x\ny z.\nq!! don't 'tis", "tab\tone", "é ü ß", "", None, "…—“q” <|endoftext|> t", "1,2 3.4 a1.", "w x y", "end\n"]
    rows = [(None if i == 3 else i * 7 % 5, t, "en", "s") for i, t in enumerate(texts)]
    docs = docs_of(spark, rows)
    tok = Tokenizer.from_file(tokens.default_vocabulary())
    marks = {r["text"]: r["m"] for r in docs.select("text", F.xxhash64("text").alias("m")).collect()}
    ordered = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), marks[r[1]]))
    at, want = 0, []
    for i, t, *_ in ordered:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    manifest = tokens.write_tokens(docs, tokens.default_vocabulary(), files=3)
    got = [tuple(r) for r in tokens.read_tokens(manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    file = tokens.TokenFile(manifest.orderBy("part", "place").first()["path"])
    assert zlib.crc32(file.document(0).astype("<u4").tobytes()) == want[0][3]
    many = tokens.write_tokens(docs, tokens.default_vocabulary(), files=2, file_bytes=20)  # a file ends after some ids
    assert many.count() > 2 and sorted((tuple(r) for r in tokens.read_tokens(many, run=1).collect()), key=lambda r: r[1]) == want
    assert tokens.token_table(docs.limit(0)).count() == 0


def mix_by_hand(rows, weights=(3, 1, 2)):
    """(size, taken) and so on of (doc_id, text, source) rows, one word at a time in exact arithmetic."""
    import hashlib
    from collections import defaultdict
    from fractions import Fraction

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    seen: dict = defaultdict(int)
    flows: dict = defaultdict(list)
    for i, text, source in rows:
        copy = seen[i, text, source]
        seen[i, text, source] += 1
        mark = "" if text is None else md5(text)
        flows[source].append((i, len((text or "").split()), lambda p, i=i, mark=mark, copy=copy: md5(f"{'' if i is None else i}:{p}:{mark}:{copy}")))
    order = sorted(flows, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(x[1] for x in flows[s]) for s in order}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, target = Fraction(3, 2) * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] < level * weight[s]}
        target |= {s: Fraction(2 * size[s]) for s in full} or {s: level * weight[s] for s in open_}
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    parts = []
    for k, s in enumerate(order):
        at = 0
        for p in (1, 2):
            for row, (_, n, key) in sorted(enumerate(flows[s]), key=lambda x: (x[1][2](p), x[1][0] is not None, x[1][0] or 0, x[1][1])):
                if n:
                    cut = min(n, mixing.PACKETS) if at < target[s] < at + n else 1
                    bounds = [n * j // cut for j in range(cut + 1)]
                    parts += [((at + b) / target[s], k, at + b, b - a, s, row) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                at += n
    budget, taken = sum(size.values()) * 3 // 2, defaultdict(int)
    for *_, n, s, row in sorted(parts):
        taken[s, row] += min(n, budget)
        budget -= min(n, budget)
    return [(x[0], x[1], size[s], float(target[s]), taken[s, row]) for s in order for row, x in enumerate(flows[s])]


def test_fair_mix(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([1, 50, 400])), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows += [(900, None, "en", "a"), (901, "", "en", "empty"), (None, "x y", "en", "a"), (5, "dup", "en", "a"), (5, "dup", "en", "a"), (6, prose(rng, 9000), "en", "b")]
    rows += [(None, "null id", "en", "a"), (None, "null id", "en", "a"), (None, None, "en", None)]
    key = lambda r: (r[0] is not None, *(x or 0 for x in r))
    got = [sorted((tuple(r) for r in mixing.mix_table(docs_of(spark, x), bucket_rows=b).collect()), key=key) for x, b in ((rows, 1000), (rows[::-1], 7))]
    assert got[0] == got[1]
    want = sorted(mix_by_hand([(i, t, s) for i, t, _, s in rows]), key=key)
    assert [r[:3] + r[4:] for r in got[0]] == [r[:3] + r[4:] for r in want]
    assert np.allclose([r[3] for r in got[0]], [r[3] for r in want])
    assert all(r[4] <= 2 * r[1] for r in want)
    taken: dict = {}
    for r in want:
        taken[r[2], r[3]] = taken.get((r[2], r[3]), 0) + r[4]
    assert all(abs(n - t) <= 9000 / mixing.PACKETS + 2 for (_, t), n in taken.items())
    assert mixing.mix_table(docs_of(spark, rows).limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix_table(docs_of(spark, [(1, None, "en", None)])).collect()} == {0}


def test_mixed_documents(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([1, 50, 200])), "en", rng.choice(["a", "b", None])) for i in range(100)]
    rows += [(7, "twin twin", "en", "a")] * 3 + [(None, "no id", "en", "b"), (None, "no id too", "en", "b"), (None, None, None, "b"), (8, "", "de", "a")]
    docs = docs_of(spark, rows).withColumns({c: F.lit(c) for c in ("vfinish", "__id", "mark", "more", "row", "mix_finish", "mix_n")})
    want: dict = {}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        key = (r["doc_id"], r["text"], r["source"])
        want[key] = want.get(key, 0) + 1
        assert r["vfinish"] == "vfinish" and r["mix_n"] == "mix_n"
    known = {(i, t, s) for i, t, _, s in rows}
    assert set(want) <= known and all(n <= 2 * rows.count((k[0], k[1], "en", k[2])) for k, n in want.items() if k[1])
    words = sum(len((k[1] or "").split()) * n for k, n in want.items())
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    assert abs(words - 1.5 * total) <= 3 * 200
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_one_of_each_keeps_rows_not_ids(spark):
    rng = random.Random(12)
    base = prose(rng, 100).split()
    near = " ".join([*base[:50], "changed", *base[51:]])
    base, other = " ".join(base), prose(rng, 90)
    kept = lambda rows: sorted(((r["doc_id"], r["text"]) for r in near_duplicates.one_of_each(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, kept_id string, mark string, key string")).collect()), key=str)
    assert kept([(2, base), (5, near), (5, other)]) == sorted([(2, base), (5, other)], key=str)
    assert len(kept([(None, base), (None, near), (None, other)])) == 2
    assert kept([(None, base), (9, near), (9, near), (None, None), (None, None), (3, "!!"), (3, "!!")]) == sorted([(9, near), (None, None), (None, None), (3, "!!"), (3, "!!")], key=str)
    assert kept([(5, base), (5, base), (5, base)]) == [(5, base)]


def test_prefix_filter_loses_no_link():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 50))) for _ in range(120)]
    sets += [np.unique(np.concatenate((sets[0], rng.choice(pool, k)))) for k in range(6)]
    at = np.arange(len(sets))
    got = near_duplicates.linked(sets, at, at, 0.8)
    want = [[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9 for b in sets] for a in sets]
    assert (got == np.array(want)).all() and got.sum() > len(sets)


def test_pipeline(spark, tmp_path, corpus):
    import corpus_pipeline

    corpus.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "w1x w2x w3x w4x w5x w6x w7x w8x w9x w10x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count() > 40


def test_pipeline_stages_one_by_one(spark, tmp_path):
    """Each stage on its own input, with columns whose names the operators use inside."""
    import corpus_pipeline

    rng = random.Random(17)
    base = prose(rng, 80)
    near = base.replace(base.split()[40], "changed", 1)
    item = prose(rng, 14, 50)
    texts = [(i, prose(rng, 60)) for i in range(40)] + [(100, base), (50, near), (101, base), (50, "12 !!"), (None, prose(rng, 30)), (60, None), (61, "?? 34"), (62, f"{prose(rng, 20)} {item} tail"), (63, prose(rng, 3000))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, kept_id long, mark long, vfinish double, __text string, `row` string"
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), -7.0, "was", 1, 2, 3.0, "x", "y") for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "mixing", "token_files"]
    want = [r for r in texts if r[1] and any(c.isalpha() for c in r[1])]
    out = stages["language"](spark, docs, str(tmp_path))
    assert key(out) == sorted(want, key=str)
    want = [r for r in want if r not in ((100, base), (101, base))]  # the near copy has the smaller id
    out = near_out = stages["near_duplicates"](spark, out, str(tmp_path))
    assert key(out) == sorted(want, key=str)
    want = [r for r in want if r[0] != 62]
    out = stages["decontamination"](spark, out, str(tmp_path))
    assert key(out) == sorted(want, key=str)
    clean = out
    out = stages["mixing"](spark, out, str(tmp_path))
    taken = {(r[0], near_r) for r in want for near_r in (r[1],)}
    mixed = key(out)
    assert set(mixed) <= taken and max(mixed.count(r) for r in set(mixed)) <= 2
    words = lambda rows: sum(len(t.split()) for _, t in rows)
    assert abs(words(mixed) - 1.5 * words(want)) <= 4 * 80 + 3000 // 2
    for d in (out, clean, near_out):
        assert d.columns == docs.columns
        assert d.where("score <> -7 or lang_pred <> 'was' or kept_id <> 1 or mark <> 2 or vfinish <> 3 or __text <> 'x' or `row` <> 'y'").count() == 0
    ids = stages["token_files"](spark, out, str(tmp_path)).orderBy("start").collect()
    assert len(ids) == len(mixed) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ids, ids[1:], strict=False))


def test_very_long_texts(spark):
    from tokenizers import Tokenizer

    words = [f"w{i % 4000}x" for i in range(60_000)]
    long = " ".join(words)
    docs = docs_of(spark, [(1, long, "en", "a"), (2, f"{long} end", "en", "b"), (3, "short text here", "en", "a")])
    assert sorted(tuple(r) for r in near_duplicates.jaccard_join(docs).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
    bench = spark.createDataFrame([(1, " ".join(words[-12:]))], "item_id long, text string")
    hits = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert hits == {1: (60_000, 15 * 12), 2: (60_001, 15 * 12), 3: (3, 0)}
    assert {r["doc_id"]: r["n_tokens"] for r in lm.score(docs, shards=2).collect()} == {1: 60_001, 2: 60_002, 3: 4}
    assert {r["size"] for r in mixing.mix_table(docs).collect()} == {60_000, 60_001, 3}
    assert license_scan.scan_text(long)["n_words"] == 60_000 and langid.counted(long)[1].sum() > 300_000
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_table(docs).collect()}
    assert got[1] == len(Tokenizer.from_file(tokens.default_vocabulary()).encode(long, add_special_tokens=False).ids) + 1
    page = f"<html><body><nav>menu</nav><article><p>{long}</p></article></body></html>"
    assert html.extract(page, []) == long
    pages = spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")
    assert warc.warc_table(pages).first()["payload_bytes"] == len(long)


def test_ties(spark):
    """Equal scores, sizes and profiles: the stated order, whatever the order of rows."""
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(9)] + [(50, [1.0, 0.0, 0.0, 0.0])]
    for some in (rows, rows[::-1]):
        got = ann.neighbours(spark.createDataFrame(some, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
        assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4] and {r["score"] for r in got} == {1.0}
    profiles = langid.Profiles([("bb", ord("a"), 0), ("aa", ord("a"), 0)], 300)
    assert profiles.predict("a")[0] == "aa"
    same = [(i, "one two three", "en", "ab"[i % 2]) for i in range(10)]
    first, second = (sorted(tuple(r) for r in mixing.mix_table(docs_of(spark, x)).collect()) for x in (same, same[::-1]))
    assert first == second
    two = "<div class='a'><p>one two three</p></div><div class='b'><p>four five six</p></div>"
    assert html.vote(f"<html><body>{two}</body></html>") == html.vote(f"<html><body>{two}</body></html>")


@pytest.mark.parametrize("limit", [3, 1000])
def test_encoder_equals_library_on_odd_texts(limit):
    encode = tokens.Encoder(tokens.default_vocabulary(), limit)
    odd = ["a\tb c", "  x y", "x \n y", "a\n\nb c", "x\n\n\ny z", "é  b", "tail ", "\tq w", "a <|endoftext|> b", " a", "don't 're x's", "x y 　 z"]
    odd += ["é,,x1a a1b2", "À×b ÷a", "a\r\nb c", "İi ɏɐ", "x_y a\\b [q] ^_`{~}", "a’b", "\nq w", "4th x²y", "Ⅷa ªb", "a\x1c b", "", "\n", "ǅ'll we'll", "end.\nNext, word*** a.\n-b"]
    for text in odd * 2:
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_small_tables_go_to_few_files(spark, corpus, monkeypatch):
    from contextlib import nullcontext
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    want = sorted(near_duplicates.jaccard_join(corpus).collect(), key=str)
    monkeypatch.setattr(near_duplicates, "scratch", lambda _: nullcontext())
    before = set(shared.iterdir())
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert sorted(near_duplicates.jaccard_join(corpus).collect(), key=str) == want
        kept = near_duplicates.one_of_each(corpus)
        assert kept.rdd.getNumPartitions() <= 4
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = {p.name: len([*p.glob("part-*")]) for p in set(shared.iterdir()) - before}
    rounds = {n: k for n, k in files.items() if n.startswith(("near-nodes", "near-buckets", "near-hot-groups", "near-groups", "near-about", "near-kept"))}
    assert len(rounds) == 11
    assert max(rounds.values()) <= 4  # one for each core; it was one for each shuffle partition that has rows


def test_language_counts_a_few_texts_at_a_time():
    import tracemalloc

    rng = random.Random(8)
    texts = [prose(rng, 300) for _ in range(2000)] + ["", "ß", "Ä b", prose(rng, 60_000)]
    for some in (texts, texts[-4:], [], [""]):
        whole, parts = langid.counted("\n".join(some)), langid.counted_together(some)
        assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    tracemalloc.start()
    langid.counted_together(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # 63 MB with all texts joined, 12 MB in runs


def test_workers_give_free_memory_back(monkeypatch):
    import pyarrow as pa

    from kinforge.llm import common

    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    assert [b.num_rows for b in common.pieces(iter([batch, batch]), 600, release=True)] == [600, 400, 600, 400]
    assert calls == [1]
    some = common.pieces(iter([batch]), 600, release=True)
    next(some)
    some.close()  # a task that stops early
    assert calls == [1, 1]
    monkeypatch.undo()
    common.release_memory()
