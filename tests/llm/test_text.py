import html
import itertools
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat_format, decontamination, html_text, quality, queries, toxicity, url_filters

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[OUT]", "[ROLE]", "[TURN]", "[/ROLE]", "\\", "\\[INST]", "<", "[", "\n", "é😀", " "]


def test_chat_round_trip(spark):
    r = random.Random(1)
    rows = []
    for c in range(40):
        for turn in range(r.randint(1, 6)):
            text = "".join(r.choice(CONTROLS + ["word"]) for _ in range(r.randint(0, 8)))
            rows.append((c, turn, r.choice(["user", "assistant", "system", "tool", "[TURN]", None]), None if r.random() < 0.1 else text, 1))
    rows += [(None, 0, "user", "null id", 1), (50, 0, "user", "tie", 1), (50, 0, "user", "tie", 1), (51, None, "assistant", "x" * 200_000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered int")
    out = chat_format.read_back(chat_format.format_chats(df)).collect()
    want = {}
    for c, turn, role, text, _ in rows:
        want.setdefault(c, []).append((turn, role or "", text or ""))
    assert len(out) == len(want)
    for row in out:
        turns = sorted(want[row["conv_id"]], key=lambda t: (-1 if t[0] is None else t[0], t[1]))
        assert [(t["role"], t["text"]) for t in row["turns"]] == [t[1:] for t in turns]
        assert row["loss_text"] == "".join(t for _, who, t in turns if who == "assistant")
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_plain_text_is_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi [there]"), (1, 1, "assistant", "a </s> b")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_chats(df).first()
    assert row["formatted"] == "<s>[INST]hi [there][/INST][OUT]a <\\/s> b</s>" and row["n_escaped"] == 1


def test_chat_parser_is_strict(spark):
    texts = {"<s>[INST]a[/INST]": ["a"], "<s>[INST]a[OUT]b[/INST]": [], "<s>[INST]a</s>[OUT]b</s>": ["b"], "<s>[ROLE]r[TURN]x[/ROLE]": ["x"], "<s>[TURN]x[/ROLE]": [], "": []}
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert {r[0]: [t["text"] for t in r[1]] for r in df.select("s", chat_format.parse(F.col("s"))).collect()} == texts


def item(seed, n):
    r = random.Random(seed)
    return [f"t{r.randrange(10**6)}" for _ in range(n)]


def leaked(doc, bench, reach=13, share=0.8):
    """Whether any alignment has a window that agrees enough; needs no seeds."""
    for shift in range(-len(bench), len(doc)):
        same = [0 <= shift + k < len(doc) and doc[shift + k] == w for k, w in enumerate(bench)]
        n = min(reach, len(bench))
        if any(sum(same[k : k + n]) >= np.ceil(n * share) for k in range(len(bench) - n + 1)):
            return True
    return False


def test_decontamination(spark):
    bench = {1: item(1, 40), 2: item(2, 16), 3: item(3, 5), 4: []}
    noise = lambda s, n: item(1000 + s, n)
    every = lambda w, step: [x if (k + 1) % step else f"sub{k}" for k, x in enumerate(w)]
    docs = {
        1: noise(1, 50) + bench[1] + noise(2, 50), 2: bench[2], 3: noise(3, 9) + every(bench[1], 9) + noise(4, 9), 4: noise(5, 300),
        5: noise(6, 20) + bench[3], 6: noise(7, 5) + bench[3][:3] + noise(8, 5), 7: noise(9, 30) + bench[1][10:30], 8: bench[1][:8] + noise(10, 50), 9: [],
    }
    docs[11] = noise(30, 9) + bench[1] + noise(31, 20_000)  # very long
    rows = [(i, " ".join(w).upper() + "!", i) for i, w in docs.items()] + [(10, None, 0), (1, " ".join(docs[1]), 0), (4, " ".join(noise(40, 9)), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id long").withColumns({"key": F.lit("clash"), "words": F.lit(1), "seed": F.lit(2.0)})
    items = spark.createDataFrame([(i, ", ".join(w)) for i, w in bench.items()] + [(5, None)], "item_id long, text string")
    want = {i for i, w in docs.items() if any(b and leaked(w, b) for b in bench.values())}
    assert want == {1, 2, 3, 5, 7, 11}
    assert {r["doc_id"] for r in decontamination.contaminated(df, items).collect()} == want
    by_shuffle = decontamination.leaks(df, items, most_broadcast=0)
    assert {r["doc_id"] for r in by_shuffle.collect()} == want
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(df, items).collect()) == [4, 4, 6, 8, 9, 10]
    assert decontamination.leaks(df.limit(0), items).count() == 0 and decontamination.decontaminate(df, items.limit(0)).count() == len(rows)


def test_decontamination_masks():
    for n in range(5, 14):
        lost = n - int(np.ceil(n * 0.8))
        for at in itertools.combinations(range(n), lost):
            same = "".join("01"[k not in at] for k in range(n))
            assert any(all(same[p + k] == "1" for k, bit in enumerate(m) if bit == "1") for m in decontamination.masks_of(n, lost) for p in range(n - len(m) + 1)), (n, at)


def test_decontamination_of_every_substitution(spark):
    bench = {n: item(50 + n, n) for n in (*range(3, 14), 20)}
    docs = []
    for n, b in bench.items():
        for lost in range(4):
            for at in itertools.combinations(range(min(n, 13)), lost):
                docs.append([w if k not in at else f"sub{k}" for k, w in enumerate(b)] + item(len(docs) + 5000, 2))
        docs += [b[1:], b[:-1], b[2:], b[:-2]]  # cut off at an end of the text
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in bench.items()], "item_id long, text string")
    want = {i for i, w in enumerate(docs) if any(leaked(w, b) for b in bench.values())}
    assert {r["doc_id"] for r in decontamination.leaks(df, items).collect()} == want


def test_urls(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    urls = {
        1: ("http://A.example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("https://example.net/de", "example.net", "/de", "net/", "block"),
        3: ("https://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), 4: (None, "", "", None, "allow"), 5: ("no scheme", "", "", None, "allow"),
        6: ("x://b.org/fr/?q#f", "b.org", "/fr/", "org/fr/", "allow"), 7: ("x://c.net", "c.net", "", None, "allow"), 8: ("a://b://c.net/", "b:", "//c.net/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u[0], "old", 1.0) for i, u in urls.items()], "page_id long, url string, verdict string, bad_lower double")
    none = spark.createDataFrame([], "host string, bad int")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, none, rules).collect()}
    assert out == {i: u[1:] for i, u in urls.items()}
    assert url_filters.filter_urls(pages.limit(0), none, rules).count() == 0


def test_reputation(spark):
    rows = [("spam.bad.com", 1)] * 40 + [("one.bad.com", 1)] + [(f"h{k}.good.org", 0) for k in range(30) for _ in range(5)] + [("new.bad.com", None)]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    low = {r["host"]: r["bad_lower"] for r in url_filters.reputation(url_filters.host_counts(outcomes), z=1.645).collect()}
    assert low["spam.bad.com"] > 0.5 > low["h1.good.org"] and low["spam.bad.com"] > low["one.bad.com"] >= low["new.bad.com"] > low["h1.good.org"]
    # the reputation decides verdicts; a rule stands above it
    urls = ["x://spam.bad.com/a", "x://spam.bad.com/a", "x://spam.bad.com/ok/1", "x://h1.good.org/" + "a" * 100_000, "x://other.net/", None]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, known_host string")
    verdicts = lambda o, **k: [r["verdict"] for r in url_filters.filter_urls(pages, o, {"bad.com/ok/": "allow"}, **k).orderBy("page_id").collect()]
    assert verdicts(outcomes) == ["block", "block", "allow", "allow", "allow", "allow"]
    assert verdicts(outcomes.limit(0)) == verdicts(outcomes, threshold=1.0) == ["allow"] * 6


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.com": ("b.com", "com"), "com": ("com", "com"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r[0]: (r[1], r[2]) for r in df.select("host", url_filters.domain_of(F.col("host")), url_filters.suffix_of(F.col("host"))).collect()}
    assert got == hosts


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><header>Top</header>
<div class="ad">Buy</div><article><h1>Head %d</h1><p><b>First &amp; foremost&lt;3<br>next<p>Para   two %d</p><!-- no --><p>Same line</p>
<aside>side</aside><form><input>send</form><div id="comments"><p>reader says</p></div></article><footer>&copy; host</footer></body></html>"""


def test_html(spark):
    rows = [(k, f"http://h{k % 2}.com/{k}", PAGE % (k, k)) for k in range(8)]
    rows += [(20, None, None), (21, "http://one.com/", "<p>Lonely text"), (22, "http://h1.com/", ""), (0, "http://h0.com/0", PAGE % (0, 0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_text.main_text(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    for k in range(8):
        assert got[k] == f"Head {k}\n\nFirst & foremost<3\n\nnext\n\nPara two {k}\n\nSame line"
    assert got[20] == got[22] == "" and got[21] == "Lonely text"
    slots = {r["host"]: (r["slot"], r["article"]) for r in html_text.deduced(df).collect()}
    assert slots["h0.com"][0].endswith("article") and slots["*"][0].endswith("article") and slots["h0.com"][1] and not slots["one.com"][1]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_html_keeps_all_content(spark):
    bodies = {
        "split": "<div class=intro><p>In %d</p></div><div class=body><p>Body %d</p><p>More %d</p></div>",
        "sections": "<section id=a>A %d</section><section id=b>B %d</section><section id=c>C %d</section>",
        "nested": "<main><h1>H %d</h1><article><p>P %d</p><article>Q %d</article></article></main>",
        "plain": "<div class=strap>Subscribe here</div><div class=body><p>Body %d</p><p>Two %d</p><p>Three %d</p></div>",
        "copies": "<div class=intro>Same start</div><div class=body><p>Same body</p><p>Same end</p></div><!-- %d %d %d -->",
    }
    rows = [(10 * n + k, f"http://{host}.com/{k}", f"<html><body><nav>Menu</nav>{body % (k, k, k)}</body></html>") for n, (host, body) in enumerate(bodies.items()) for k in range(4)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(4):
        assert got[k] == [f"In {k}", f"Body {k}", f"More {k}"]
        assert got[10 + k] == [f"A {k}", f"B {k}", f"C {k}"]
        assert got[20 + k] == [f"H {k}", f"P {k}", f"Q {k}"]
        assert got[30 + k] == [f"Body {k}", f"Two {k}", f"Three {k}"]
        assert got[40 + k] == ["Same start", "Same body", "Same end"]


def test_html_losses(spark):
    """Text that odd quotes, misleading names or several containers must not swallow."""
    bodies = {
        "quotes": ("<p title=it's>One %d</p><p>Two's <b class='x'>bold</b> %d</p>", ["One {k}", "Two's bold {k}"]),
        "names": ("<div class='content with-sidebar'><p>Long text of the page %d</p><p>More %d</p><div class=sidebar>Side %d</div></div>", ["Long text of the page {k}", "More {k}"]),
        "head": ("<article><div class=article-header><h1>Head %d</h1></div><header>By me %d</header><p>Text %d</p></article>", ["Head {k}", "By me {k}", "Text {k}"]),
        "siblings": ("<div>Short %d</div><div>A much longer text of the page %d</div>", ["Short {k}", "A much longer text of the page {k}"]),
        "named": ("<div class=body>A long text that is the page %d</div><div class=ad>Buy %d</div><section id=comments><p>Reader %d</p></section>", ["A long text that is the page {k}"]),
        "beside": ("<div>Teaser %d</div><article>Article %d</article><div>Next %d</div>", ["Article {k}"]),
        "open": ("<p>One %d<p>Two %d <a href='x", ["One {k}", "Two {k}"]),
    }
    rows = [(10 * n + k, f"http://{host}.com/{k}", "<body>" + body.replace("%d", str(k))) for n, (host, (body, _)) in enumerate(bodies.items()) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "kept": F.lit(1), "text": F.lit("x")})
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_text.main_text(df).collect()}
    for n, (_, want) in enumerate(bodies.values()):
        for k in range(4):
            assert got[10 * n + k] == [w.format(k=k) for w in want]


def test_html_templates_decide(spark, tables, monkeypatch):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    text = lambda: {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    found = text()
    for page in pages.collect():  # these pages have one plain article each
        inside = re.sub(r"<!--.*?-->", "", re.search(r"(?s)<article>(.*)</article>", page["html"])[1])
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inside)]
        assert found[page["page_id"]] == "\n\n".join(filter(None, blocks))
    real = html_text.deduced
    monkeypatch.setattr(html_text, "deduced", lambda *a: real(*a).limit(0))
    without = text()
    assert all(without[k] != found[k] and found[k] in without[k] for k in found)


@pytest.mark.parametrize("part", ['<a "', "<a b='", '<a ="', "<", "<div>", "</div>", "<!x", "<script></script", "<a x ", "</a ", "&", "<p>x", "<a b=\"' '\" "])
def test_html_hostile_pages(part):
    """Time grows with the length alone, whatever is left open: a megabyte takes seconds."""
    page = "<p>begin</p>" + part * (1_000_000 // len(part))
    began = time.thread_time()
    text = html_text.extract(page)
    html_text.tokens_of(page)
    assert time.thread_time() - began < 20 and text.startswith("begin")


def test_html_names():
    kept = ["div.related-work", "section.side-effects", "div.share-prices", "div.notice-period", "div.comment-free", "p.notice", "span.ad", "div.article-header"]
    out = ["div.ad", "div.cookie-notice", "div.nav-bar", "div.x ad-slot-2", "div.comment-list", "ul.share", "section.related", "div.sidebar-left"]
    assert [x for x in kept + out if html_text.kind_of(x.split(".")[0], {"class": x.split(".")[1]}) == html_text.NAMED] == out


def test_quality(spark):
    r = random.Random(2)
    good = [" ".join(f"w{r.randrange(400)}" for _ in range(r.randint(5, 80))) + "." for _ in range(200)]
    junk = [" | ".join(f"W{r.randrange(9)}!!" for _ in range(r.randint(5, 80))) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate(good + junk)] + [(900, None), (901, ""), (902, "x" * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k < 200)) for k in range(400) if k % 5] + [(5000, 1), (901, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, "quality")
    scores = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[k] > 0.5) == (k < 200) for k in range(0, 400, 5))
    x = np.array([quality.statistics_of(t or "") for _, t in rows])
    np.testing.assert_allclose(model.predict(x), [scores[i] for i, _ in rows], rtol=1e-9)
    none = quality.fit(docs, labels.limit(0), "quality")
    assert quality.score(docs.limit(3), none).first()["score"] == 0.5


def test_toxicity(spark):
    r = random.Random(3)
    rows, bad = [], {}
    for k in range(300):
        w = [f"word{r.randrange(300)}" for _ in range(r.randint(10, 60))]
        bad[k] = k % 4 == 0
        if bad[k]:
            for _ in range(r.randint(2, 6)):
                w[r.randrange(len(w))] = r.choice(["vilest", "vilely.", "Rotten", "scorn"])
        rows.append((k, " ".join(w), None))
    long = " ".join(f"word{k % 300}" for k in range(100_000))
    more = [(900, None, 1), (901, "", 1), (902, long, 1), (903, f"{long} vilest rotten scorn", 1), (904, "vilest rotten", 1), (904, "vilest rotten", 1)]
    docs = spark.createDataFrame([*rows, *more], "doc_id long, text string, severity int")
    labels = spark.createDataFrame([(k, int(b)) for k, b in bad.items() if k % 3] + [(7000, 1), (901, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    assert toxicity.score(docs, model).count() == 306 and [out[k]["rejected"] for k in range(900, 905)] == [False, False, False, True, True]
    assert all(out[k]["rejected"] == b for k, b in bad.items() if k % 3 == 0)
    assert model.thresholds == sorted(model.thresholds) and 0 <= out[1]["severity"] < out[0]["severity"] <= 3
    none = toxicity.fit(docs, labels.limit(0))
    assert not any(x["rejected"] for x in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_toxicity_in_every_language(spark, tables, sf):
    folder = f"{Path(tables).parent}/{sf}"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").select("lang", "toxic", "rejected").collect()
    for lang in {r["lang"] for r in rows}:
        for toxic in {r["toxic"] for r in rows if r["lang"] == lang}:
            judged = [r["rejected"] for r in rows if (r["lang"], r["toxic"]) == (lang, toxic)]
            assert sum(x == bool(toxic) for x in judged) >= 0.9 * len(judged), (lang, toxic)


def test_toxicity_grades_and_cut():
    """Deduced grades follow what other rows teach, graded labels are taken as they are, and the cut
    separates rows that were left out."""
    r = random.Random(8)
    marks = ["vile", "rotten", "scorn", "filth"]
    sets, labels = [], []
    for k in range(400):
        n = 0 if k % 4 else 1 + k // 4 % 4
        sets.append({f"w{r.randrange(50)}" for _ in range(8)} | set(marks[:n]))
        labels.append(int(n > 0))
    y, chosen = np.array(labels, float), [*marks, "w1", "w2"]
    model = toxicity.train(sets, y, chosen)
    assert len(model.thresholds) == 3 and model.thresholds == sorted(model.thresholds)
    low, high = model.severity({"vile"}), model.severity(set(marks))
    assert low[0] < high[0] <= 3 and low[1] >= model.cut > model.severity(set())[1]
    graded = np.array([4.0 if "filth" in x else 2.0 if "rotten" in x else 1.0 if "vile" in x else 0.0 for x in sets])
    four = toxicity.train(sets, graded, chosen)
    assert len(four.thresholds) == 4 and four.severity(set(marks))[0] > 3 > four.severity({"vile", "rotten"})[0] > 1.2
    few = toxicity.train(sets[:6], y[:6], chosen)  # too few to leave rows out
    assert few.cut == 0.5


@pytest.mark.parametrize("sf, least, most", [("sf0.01", 0.6, 0.04), ("sf0.1", 0.85, 0.015)])
def test_toxicity_held_out(spark, tables, sf, least, most):
    """A third of the labelled rows is left out of fitting: share caught, share of clean ones rejected."""
    folder = f"{Path(tables).parent}/{sf}"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    model = toxicity.fit(docs, labels.filter(~held))
    rows = toxicity.score(docs.join(labels.filter(held), "doc_id"), model).groupBy("toxic").agg(F.avg(F.col("rejected").cast("double")).alias("share")).collect()
    share = {x["toxic"]: x["share"] for x in rows}
    assert share[1] >= least and share[0] <= most


def test_toxicity_query_against_plain_version(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {x["doc_id"]: x for x in queries.op2_toxicity(spark, tables).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and model.weights
    for row in rows:
        words = set(re.findall(r"\w+", row["text"].lower()))
        names = words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n}
        margin = sum(w for f, w in model.weights.items() if f in names)
        p = [1 / (1 + np.exp(t - margin)) for t in model.thresholds]
        x = got[row["doc_id"]]
        assert abs(x["severity"] - sum(p)) < 2e-6 and abs(x["toxicity"] - p[0]) < 2e-6 and x["toxic"] == (p[0] >= model.cut)


def plain_statistics(text):
    """What ``quality.statistics_of`` counts, one thing at a time."""
    if not text:
        return dict.fromkeys(quality.STATISTICS, 0.0)
    data, words, lines = text.encode(), text.split(), [x for x in text.split("\n") if x]
    of = lambda chars: sum(data.count(c) for c in chars) / len(data)
    w, k = max(len(words), 1), max(len(lines), 1)
    return {
        "n_bytes": np.log(1 + len(data)), "n_words": np.log(1 + len(words)), "n_lines": np.log(1 + len(lines)), "mean_word": len(text) / w,
        "upper": of(range(ord("A"), ord("Z") + 1)), "digits": of(range(ord("0"), ord("9") + 1)), "symbols": of(b"#$%&*@^~=+_<>{}[]\\/"), "pipes": of(b"|"),
        "marks": of(b"!?"), "stops": of(b".,;:"), "blanks": of(b" \t\r\n"), "non_ascii": sum(b > 127 for b in data) / len(data),
        "distinct_words": len(set(words)) / w, "top_word": max((words.count(x) for x in set(words)), default=0) / w, "distinct_lines": len(set(lines)) / k,
        "top_line": max((lines.count(x) for x in set(lines)), default=0) / k, "repeat_next": sum(a == b for a, b in zip(words, words[1:])) / w,
        "end_marks": sum(x.endswith((".", "!", "?")) for x in lines) / k,
    }


def test_quality_query_against_plain_version(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{name}.parquet") for name in ("documents", "labels"))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = quality.fit(docs, labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), "quality")
    got = {x["doc_id"]: x for x in queries.op1_quality(spark, tables).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and model.rules
    for row in rows:
        s = plain_statistics(row["text"])
        x = [s[name] for name in quality.STATISTICS]
        margin = model.intercept + sum(a for rule, a in model.rules if all((x[k] > cut) == above for k, above, cut in rule))
        margin += sum(a * (min(max(x[k], low), high) - low) for k, low, high, a in model.linear)
        mine = got[row["doc_id"]]
        assert abs(mine["score"] - 1 / (1 + np.exp(-margin))) < 1e-9 and mine["held_out"] == held(row["doc_id"]) and mine["predicted"] == (mine["score"] >= 0.3)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, "c", 2)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == 3 and quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs.limit(0), labels).predict(np.zeros((1, len(quality.STATISTICS)))) == [0.5]


def test_crc_is_the_registered_split(spark):
    got = spark.range(50).select("id", (F.crc32(F.col("id").cast("string")) % 5).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
