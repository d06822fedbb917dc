"""Quality model, HTML extraction, license scan and URL filter."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("lineshed.llm")
from lineshed.llm import html_text, license_scan, quality_lm, url_filter  # noqa: E402
from lineshed.llm.queries import QUERIES, URL_RULES  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute_kneser_ney(texts, order=quality_lm.ORDER):
    """Interpolated modified Kneser-Ney over bytes, from dictionaries."""

    def symbols(t):
        return [0] * (order - 1) + list(t.encode())

    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = symbols(t)
        for k in range(order - 1, len(s)):
            counts[order][tuple(s[k - order + 1 : k + 1])] += 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    cut, total, off = {}, defaultdict(int), defaultdict(float)
    for n in range(1, order + 1):
        of = Counter(counts[n].values())
        n1, n2, n3, n4 = (of[k] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y)
        cut[n] = [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]
        for g, c in counts[n].items():
            total[n, g[:-1]] += c
            off[n, g[:-1]] += cut[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        lower = 1 / 256 if n == 1 else p(g[1:])
        if (n, g[:-1]) not in total:
            return lower
        c = counts[n].get(g, 0)
        own = (c - cut[n][min(c, 3) - 1]) / total[n, g[:-1]] if c else 0
        return own + off[n, g[:-1]] / total[n, g[:-1]] * lower

    def perplexity(t):
        s = symbols(t)
        return math.exp(-sum(math.log(p(tuple(s[k - order + 1 : k + 1]))) for k in range(order - 1, len(s))) / len(t)) if t else None

    return perplexity


def test_quality_model_is_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(quality_lm, "SHARD", 1000)  # several shards, each dealt to several tasks
    monkeypatch.setattr(quality_lm, "BLOCK_TASK", 10_000)
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdé. ,\nXY7!", weights=[9, 5, 4, 3, 2, 2, 8, 1, 1, 1, 1, 1, 1], k=rng.randint(1, 400))) for _ in range(30)]
    model = quality_lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = brute_kneser_ney(texts)
    probe = texts[:5] + texts[:1] + ["zzz???", "aXb", "", None, "日本 \U0001f600", "a\0b", "ab" * 30_000]
    frame = spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in quality_lm.perplexity(frame, model, keep=("doc_id",)).collect()}
    assert len(rows) == len(probe) and rows[0]["perplexity"] == rows[5]["perplexity"]
    for k, r in rows.items():
        exact = want(probe[k] or "")
        assert r["perplexity"] == (pytest.approx(exact, rel=1e-6) if exact else None) and r["chars"] == len(probe[k] or "")


def test_quality_query(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op2_quality_classifier"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    good = [r["kept"] for r in rows if r["doc_id"] in labels and labels[r["doc_id"]]["quality"] == 1 and labels[r["doc_id"]]["toxic"] == 0]
    bad = [r["kept"] for r in rows if r["doc_id"] in labels and labels[r["doc_id"]]["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.5  # the model of so few texts is weak


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "ab ab ab", None, 1.0), (2, None, "en", 2.0), (None, "", "en", 3.0), (4, "ab", "fr", 4.0)], "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, None), (4, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_lm.judge(docs, labels).collect()}
    assert got == {1: True, 2: False, None: False, 4: True}
    assert [tuple(r) for r in quality_lm.keep(docs, labels).orderBy("doc_id").collect()] == [(1, "ab ab ab", None, 1.0), (4, "ab", "fr", 4.0)]
    assert {r["kept"] for r in quality_lm.judge(docs, labels.filter("false")).filter("doc_id in (1, 4)").collect()} == {True}
    assert quality_lm.judge(docs.filter("false"), labels).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu<li>Two</ul></nav><div class="cookie-notice">Accept?</div>
<article class='post'><header><h1>Real &amp; Title</h1></header><p>First <b>bo</b>ld  text&nbsp;&eacute;<br>line<p class="ad x">Buy <i>now<p>Second
 &lt;p&gt; 3 < 4<script>var a = "</p>";</script><form><input name=a>Name</form><table><tr><td>cell one is here<td>two</table>
<div id="comments"><div>I disagree, at great length, with all of this.</div></div></article><aside>Side</aside>
<footer>&copy; us</footer><!-- <p>hidden</p> --></body></html>"""


def test_html_extraction():
    assert html_text.main_text(PAGE, html_text.Weights()) == "Real & Title First bold text é line Second <p> 3 < 4 cell one is here two"
    plain = re.sub("</?article[^>]*>", lambda m: m[0].replace("article", "div"), PAGE).replace("<header><h1>Real", "<h1>Real").replace("Title</h1></header>", "Title</h1>")
    assert html_text.main_text(plain, html_text.Weights()) == "Real & Title First bold text é line Second <p> 3 < 4 cell one is here two"
    for page in (None, "", "<", "<p", "<!--", "<script>x", "</p></div>", "<a b='", "<div class=ad>x"):
        assert isinstance(html_text.main_text(page, html_text.Weights()), str)
    assert html_text.main_text("just words", html_text.Weights()) == "just words"
    assert html_text.main_text("<p>" * 20000 + "end", html_text.Weights()) == "end"


def trained():
    """Weights from pages whose article is marked, with text beside it that no list names."""
    pages = [f"<body><div><p>intro of {k} words here</p></div><article><h2>t</h2><p>one two three four five</p><ul><li>a b c d e</ul><p>six seven</p></article><section><p>tail of page</p></section></body>" for k in range(30)]
    counts = Counter()
    for p in pages:
        counts += html_text.counted(html_text.blocks(p))
    return html_text.Weights.of_counts(dict(counts))


def test_pages_are_scored_alike_with_and_without_marks():
    w = trained()
    story = "".join(f"<p>{'word ' * 40}{k}</p>" for k in range(8))
    text = " ".join(f"{'word ' * 40}{k}" for k in range(8))
    assert html_text.main_text(f"<body><div>{story}</div><article><p>a teaser of six words only</p></article></body>", w) == text
    assert html_text.main_text(f"<body><p>intro</p><article>{story}</article><p>tail</p></body>", w) == text
    assert html_text.main_text(f"<body><div>{story}</div></body>", w) == text
    assert w.tag["article"] < -5 and w.tag["/article"] < w.tag["/p"] and w.tag["li"] > -1


def test_main_text_keeps_formulas_and_search_results():
    w = html_text.Weights()
    assert html_text.main_text("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p>", w) == "let x=2 be"
    assert html_text.main_text('<div class="search-results"><p>found this</p></div><form class="search">q</form>', w) == "found this"
    assert html_text.main_text('<p data-class="ad" alt="class=ad">kept</p><p CLASS=ad>gone</p>', w) == "kept"
    deep = "".join(f"<section><p>{'many ' * 9}{k}" for k in range(60)) + "<li>x" + "<b>" * 50 + "<li>y"  # the first item ends, 50 elements up
    assert html_text.blocks("<ul>" + deep + "</ul><p>z")[-2].text == "y"


@pytest.mark.parametrize("page", ["<a " * 400_000, '<a ">" ' * 100_000, "<div>" * 50_000 + "</x>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, "<ul>" + "<li>x" * 50_000, "<" * 500_000, "<p class" + " " * 500_000])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.main_text(page, html_text.Weights())
    assert time.process_time() - began < 10


def test_weights_learn_all_names_of_enough_uses(spark):
    long = "x-" + "long" * 20
    names = [f"t{k}-x" for k in range(2500)] + [long]
    page = "<article>" + "".join(f"<{n}>word</{n}>" for n in names) + "</article>"
    w = html_text.fit(spark.createDataFrame([(page,), (None,), ("",)], "html string"))
    assert set(names) <= w.tag.keys()
    assert html_text.fit(spark.createDataFrame([], "html string")) == html_text.Weights()
    pages = spark.createDataFrame([(1, None, "<p>a", 1), (1, None, "<p>a", 1), (None, "u", None, 2)], "page_id long, url string, html string, __text long")
    got = html_text.extract(pages, w, keep=("page_id", "url", "__text")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["__text"]) for r in got) == [(0, "", 0, 2), (1, "a", 1, 1), (1, "a", 1, 1)]
    assert html_text.extract(pages.filter("false"), w).count() == 0


def test_best_run_is_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        scores = [(-rng.random() * 3, rng.uniform(-2, 4)) for _ in range(rng.randint(0, 9))]

        def value(i, j):
            return sum(w for _, w in scores[i:j]) + sum(t for t, _ in scores[i + 1 : j])

        first, last = html_text.best_run(scores)
        best = max([value(i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)], default=0)
        assert (value(first, last) if last else 0) == pytest.approx(max(best, 0))


def test_html_query(spark):
    import html

    rows = {r["page_id"]: r for r in QUERIES["op3_html_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inside))).split())
        assert rows[r["page_id"]]["text"] == want and rows[r["page_id"]]["n_chars"] == len(want)


def brute_licenses(text, templates):
    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def runs(w):
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    own = words(text)
    out = set()
    for k, _, t in templates:
        w = words(t)
        best = max((len(runs(own[a : a + len(w)]) & runs(w)) / len(runs(w)) for a in range(max(1, len(own) - len(w) + 1))), default=0)
        if best >= 0.8:
            out.add(k)
    return out


def test_license_scan(spark):
    templates = [(k, n, t) for k, (n, t) in enumerate(license_scan.NOTICES)]
    docs = [(k, t) for k, (_, t) in enumerate(license_scan.NOTICES)]
    docs += [(50, "filler words here " * 30 + license_scan.NOTICES[6][1].upper().replace("free software:", "free  software -") + " and more " * 20), (51, None), (52, ""), (53, "the license of the software")]
    docs += [(54, "Released\nunder the MIT license. Released under the MIT License."), (None, license_scan.NOTICES[0][1])]
    got = defaultdict(set)
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, band string")
    for r in license_scan.scan(frame, license_scan.notices(spark)).collect():
        got[r["doc_id"]].add(r["template_id"])
    assert dict(got) == {d: m for d, t in docs if (m := brute_licenses(t, templates))}
    assert license_scan.scan(frame.filter("false"), license_scan.notices(spark)).count() == 0


def test_long_templates_are_contained_as_a_whole(spark):
    words = [f"clause{k}" for k in range(103)]
    template = spark.createDataFrame([(1, "L", " ".join(words)), (2, "R", " ".join(words[:50] + words[:50]))], "template_id long, license string, template string")

    def cut(*holes):
        return " ".join(["before"] * 30 + [w if k not in holes else f"other{k}" for k, w in enumerate(words)] + ["after"] * 30)

    docs = [(1, cut()), (2, cut(5, 12, 19)), (3, cut(*range(5, 103, 12))), (4, cut(33, 66)), (5, None)]
    got = {(r["doc_id"], r["template_id"]): r["containment"] for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), template).collect()}
    assert len(license_scan.segments(template).collect()) > 2

    def share(text):
        runs = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        return len(runs(text.split()) & runs(words)) / 99

    assert {d: v for (d, t), v in got.items() if t == 1} == pytest.approx({d: share(t) for d, t in docs if t and share(t) >= 0.8})
    assert {d for d, t in got if t == 1} == {1, 2, 4}  # in document 2 one segment alone has too little


def test_license_query(spark):
    templates = [(k, n, t) for k, (n, t) in enumerate(license_scan.NOTICES)]
    got = defaultdict(set)
    for r in QUERIES["op4_license_scan"](spark, SF).collect():
        got[r["doc_id"]].add(r["template_id"])
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 1500 or lower(text) like '%licen%'").collect()
    for r in docs:
        assert got.get(r["doc_id"], set()) == brute_licenses(r["text"], templates)
    assert got.keys() <= {r["doc_id"] for r in docs} and got


def test_url_rules(spark):
    urls = ["http://A.org/x", "https://example.org/es/1", "http://www.Example.org/en/12?x#y", "http://b.com/fr/", "http://b.com/de/1", "http://c.net", "x", None, "http://org/", "ftp://e.org?x=/es/", "http://notexample.org/es/", "http://com/de/#f://g"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, [], URL_RULES).collect()}
    assert got == {
        0: ("a.org", "/x", "org/", "allow"),
        1: ("example.org", "/es/1", "example.org/es/", "block"),
        2: ("www.example.org", "/en/12", "example.org/en/1", "block"),
        3: ("b.com", "/fr/", "com/fr/", "allow"),
        4: ("b.com", "/de/1", "com/de/", "block"),
        5: ("c.net", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("org", "/", "org/", "allow"),
        9: ("e.org", "", None, "allow"),
        10: ("notexample.org", "/es/", "org/", "allow"),
        11: ("com", "/de/", "com/de/", "block"),
    }


def brute_rules(rows, support, confidence, lift, least):
    """All rules by counting every token set; of sets that fit the same rows only the first is a rule."""
    from itertools import combinations

    tokens = sorted({t for ts, _ in rows for t in ts})
    rules = []
    for size in range(1, len(tokens) + 1):
        for own in combinations(tokens, size):
            have = [v for ts, v in rows if set(own) <= set(ts)]
            for verdict in ("allow", "block"):
                n = have.count(verdict)
                share = sum(v == verdict for _, v in rows) / len(rows)
                if n >= max(support * len(rows), least) and n / len(have) >= confidence and n / len(have) / share >= lift:
                    rules.append((own, verdict, n / len(have), n / len(rows)))
    return [r for r in rules if not any(set(s[0]) < set(r[0]) and s[1] == r[1] and s[2] >= r[2] for s in rules)]


def test_mined_rules_are_those_of_counting(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(400):
        tokens = [t for t in "abcdefg" if rng.random() < 0.5]
        p = 0.9 if {"a", "b"} <= set(tokens) else 0.8 if {"c", "d", "e", "f"} <= set(tokens) else 0.1
        rows.append((["z"] + tokens + ["aa"] * ("a" in tokens), "block" if rng.random() < p else "allow"))
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    rules = url_filter.mine(frame, support=0.02, least=5)
    plain = [([t for t in ts if t not in ("z", "aa")], v) for ts, v in rows]  # z is in all, aa always with a
    want = brute_rules(plain, 0.02, 0.6, 1.1, 5)
    assert {(r[0], r[1]): (round(r[2], 9), round(r[3], 9)) for r in rules} == {(r[0], r[1]): (round(r[2], 9), round(r[3], 9)) for r in want}
    assert any(len(r[0]) == 4 for r in rules) and len(rules) == len(want)
    index = url_filter.rule_index(rules)
    assert sum(map(len, index.values())) == len(rules)
    assert url_filter.mine(frame.filter("false")) == []


def test_urls_are_judged_as_by_trying_all_rules(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    labels = spark.range(400).selectExpr("id as doc_id", "cast(id % 3 != 0 as int) as quality", "0 as toxic")
    labelled = url_filter.labelled_urls(pages, labels)
    rules = url_filter.mine(labelled, support=0.02, confidence=0.5, lift=1.0, least=2)
    parts = {r["page_id"]: set(r["tokens"]) for r in url_filter.with_parts(pages).collect()}
    assert rules
    for r in url_filter.judge(pages, rules).collect():
        fit = [x for x in rules if set(x[0]) <= parts[r["page_id"]]]
        best = min(fit, key=lambda x: (-x[2], -x[3], len(x[0]), " & ".join(x[0])), default=None)
        assert (r["verdict"], r["mined_rule"]) == ((best[1], " & ".join(best[0])) if best else ("allow", None))


def test_long_url_tokens_stay_whole(spark):
    one, two = "a" * 64 + "b", "a" * 64 + "c"
    pages = spark.createDataFrame([(k, f"http://h.net/{one if k % 2 else two}/{k}", "x") for k in range(80)], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)] + [(None, 1, 0), (999, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rules = url_filter.mine(url_filter.labelled_urls(pages, labels))
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules).collect()}
    assert got == {k: "allow" if k % 2 else "block" for k in range(80)}
    assert url_filter.judge(pages.filter("false"), rules).count() == 0


def test_url_query(spark):
    rows = QUERIES["op9_url_filter"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert {r["verdict"] for r in rows} <= {"allow", "block"}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    from lineshed.session import materialize

    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, kept[-1], SF), name)
        assert out.columns == docs.columns and out.exceptAll(kept[-1]).count() == 0
        kept.append(out)
    counts = [k.count() for k in kept]
    assert counts[1] >= 0.98 * counts[0] and counts == sorted(counts, reverse=True) and counts[3] < counts[2]
    clean = [d for d, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    ids = {r["doc_id"] for r in kept[2].collect()}
    assert sum(d in ids for d in clean) >= 0.98 * len(clean)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept[-1].collect()}


def test_stages_take_odd_rows(spark):
    import corpus_pipeline

    from lineshed.session import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    named = docs.withColumns({"__row": F.lit("r"), "__text": F.lit(7), "__again": F.lit(1.5), "perplexity": F.lit(None).cast("double"), "Offset": F.lit(2)})
    text = docs.filter("length(text) between 500 and 3000 and lang = 'en'").orderBy("doc_id").first()["text"]
    odd = [(None, None), (None, text), (None, text), (-1, ""), (-2, text + " one more"), (-2, text + " one more"), (-3, "word"), (-4, "\u65e5\u672c " * 40), (-5, text * 60)]
    more = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    here = named.unionByName(more.withColumns({"__row": F.lit("r"), "__text": F.lit(7), "__again": F.lit(1.5), "perplexity": F.lit(None).cast("double"), "Offset": F.lit(2)}))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, here = here, materialize(stage(spark, here, SF), name)
        assert here.schema.simpleString() == before.schema.simpleString() and here.exceptAll(before).count() == 0, name
        empty = stage(spark, before.filter("false"), SF)
        assert empty.columns == before.columns and empty.count() == 0, name
    ids = [r["doc_id"] for r in here.collect()]
    assert ids.count(None) == 2 and ids.count(-2) <= 1 and not {-1, -4} & set(ids)
    pieces = corpus_pipeline.STAGES[-1][1](spark, here, SF)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r["doc_id"] for r in pieces.collect()} == set(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, here.filter("false"), SF).count() == 0


def test_a_block_is_asked_in_bounded_memory():
    import random
    import tracemalloc

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    payloads = [" ".join(rng.choices(words, k=800)).encode() for _ in range(600)]
    size = sum(map(len, payloads))
    tracemalloc.start()
    rows = list(quality_lm._requests(payloads, 4))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 * size
    asked = sum(int(often.sum()) for _, z in rows for often in quality_lm.unsqueeze(z)[3:])
    assert asked == size


def test_grams_of_payloads_by_hand():
    payloads = [b"", b"abc", b"", b"x" * 400, b"y", b""]
    grams, owner = quality_lm.gram_codes(payloads)
    want = [(int.from_bytes((b"\0" * 4 + p)[k : k + 5], "big"), i) for i, p in enumerate(payloads) for k in range(len(p))]
    assert list(zip(grams.tolist(), owner.tolist())) == want and not len(quality_lm.gram_codes([])[0])


def test_short_texts_have_an_allowance(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([(0,), (4,), (10_000,)], "n long").select(quality_lm.allowance(F.col("n"))).collect()]
    assert got == pytest.approx([math.exp(2), math.exp(1), math.exp(0.02)])
