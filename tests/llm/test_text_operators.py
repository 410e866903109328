"""PII, decontamination, quality, language, HTML, chat and BPE against brute force, the library or held-out labels."""

import hashlib
import html
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwise.llm import bpe, chat, decontam, html_extract, langid, pii, quality
from labelwise.llm.queries import bpe_path

from .conftest import SF, WORD, fold

# ---- PII
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for k, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, 12 <= len(d) <= 19 and luhn(d or "0"), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns(documents):
    rnd = random.Random(1)
    texts = [t or "" for _, t in documents]
    for alphabet in ("0123456789 .-+()", "ab@._.c-@1 ", "12 -.+(0@a"):
        texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t)


def _number(rnd, ok):
    d = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if luhn(d + c) == ok)


def test_trees_add_what_the_patterns_miss(table):
    rnd = random.Random(2)
    shapes = [lambda: f"mail a{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.example.com", lambda: _number(rnd, True), lambda: _number(rnd, False),
              lambda: ".".join(str(rnd.randint(1, 255)) for _ in range(4)), lambda: f"+1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}",
              lambda: f"version {rnd.randint(1, 9)}.0.{rnd.randint(300, 999)}.1", lambda: "plain words only"]
    rows = [(i, " and ".join(rnd.choice(shapes)() for _ in range(4))) for i in range(900)]
    a, b = _number(rnd, True), _number(rnd, True)
    rows += [(5000, f"x {a} {b} y"), (5001, "call +1 (843) 555-7672 170.106.47.218 now"), (5002, None), (5003, ""), (5004, "nothing 12 here")]
    got = {r["doc_id"]: r for r in pii.find_pii(table(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = brute_spans(t)
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in want) for j in range(4)]
        assert set(joined.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert got[5000]["spans"] == "card:2:18,card:19:35"
    assert got[5001]["spans"] == "phone:5:22,ip:23:37"
    assert got[5004]["spans"] == got[5002]["spans"] == ""


def test_the_trees_in_spark_equal_those_of_a_list(spark):
    """All spans of the middle table: the weak labels of all documents, the sample, the trees and the thresholds, in plain Python."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    detector = pii.fit_examples([e for r in rows for e in pii.weak_examples(r.text)])
    assert max(detector.cuts) < 1  # every kind has a threshold
    got = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    added = Counter()
    for r in rows:
        base, every = detector.spans(r.text)
        assert got[r.doc_id] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in every)
        for a, k, b in set(every) - set(base):  # only what the patterns lose to a neighbour is added, and it passes its check
            added[k] += 1
            assert pii.checked(pii.KINDS[k], r.text[a:b])
    assert added[2] and added[3]


def test_few_examples_per_label_are_a_sample(documents):
    examples = [e for _, t in documents for e in pii.weak_examples(t)]
    a, b = pii.fit_examples(examples, per_label=10), pii.fit_examples(examples + examples, per_label=10)
    assert a.cuts == b.cuts and (a.model is None) == (b.model is None)
    assert pii.fit_examples([]).spans("call +1 (843) 555-7672 now")[1] == [(5, 3, 22)]


def test_redaction(table):
    rows = [(1, "to a.b@c.de now", 9), (2, None, 0), (3, "clean", 5)]
    out = pii.redact_documents(table(rows, "doc_id long, text string, n_email int"))
    assert out.columns == ["doc_id", "text", "n_email"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "to [EMAIL] now", 2: None, 3: "clean"}
    assert pii.redact("aXXbYYc", [(1, 0, 3), (2, 1, 3), (4, 2, 6)]) == "a[EMAIL]b[CARD]c"


def test_long_runs_are_linear():
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@" * 50_000) == []
    assert len(pii.candidates("1 " * 50_000 + "a" * 300_000 + "@b" * 50_000)) < 20 * 50_000


# ---- decontamination
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(table, documents):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    items += [(900, "of the"), (901, "Licensed"), (902, ""), (903, None), (None, "ab cd ab cd ab cd"), (904, items[0][1])]
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(fold(t))
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[k:k + 10])].add(i)
    sizes = {len(w) for w in windows}
    want = Counter()
    for d, t in documents:
        w, hit, named = ALNUM.findall(fold(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    named |= found
        names = sorted(str(i) for i in named if i is not None)
        want[d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    docs, bench = table(documents, "doc_id long, text string"), table(items, "item_id long, text string")
    for block_bytes in (1 << 20, 3000):
        out = decontam.contamination(docs, bench, block_bytes=block_bytes)
        got = Counter(tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
        assert got == want
    kept = decontam.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])


def test_longest_match_is_located(table):
    item = " ".join(f"w{i}" for i in range(30))
    doc = "x y " + " ".join(f"W{i}" for i in range(5, 22)) + " z"
    row = decontam.find_matches(table([(1, doc)], "doc_id long, text string"), table([(7, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in row["matches"]] == [("7", 2, 5, 17)] and row["hit"] == [[2, 19]]


def test_empty_benchmark(spark, table):
    out = decontam.contamination(table([(1, "a b", 3)], "doc_id long, text string, hit int"), spark.createDataFrame([], "item_id long, text string"))
    assert out.first()["contaminated"] is False


# ---- quality
def test_quality_signals(table, documents):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                  for r in quality.signals(table(documents, "doc_id long, text string")).collect())
    want = Counter()
    for d, t in documents:
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        cover = {i + k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)] += 1
    assert got == want


def test_label_model_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.rate_documents(docs).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, True), 0) >= 0.97 * sum(v for (q, _), v in n.items() if q == 1)
    assert n.get((0, False), 0) >= 0.8 * sum(v for (q, _), v in n.items() if q == 0)


def test_quality_plan_is_native(spark, table):
    df = quality.rate_documents(table([(1, "a b c")], "doc_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_quality_edges(spark, table):
    assert quality.keep_good(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = table([(1, None, 1, "a"), (2, " ", 2, "b")], "doc_id long, text string, n_words int, kept string")
    assert quality.keep_good(df).columns == df.columns and quality.keep_good(df).count() == 0
    assert quality.fit_label_model({}) == {}


# ---- language
def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.cross_fold(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97


def test_phrases_are_longest_matches():
    rnd = random.Random(4)
    samples = {"a": "".join(rnd.choice("abc ") for _ in range(300)), "b": "".join(rnd.choice("bcd ") for _ in range(300))}
    model = langid.LanguageModel(samples, 300)
    lookup = model.lookup()
    for _ in range(50):
        text = "".join(rnd.choice("abcde .") for _ in range(rnd.randint(1, 200)))
        symbols = lookup[langid.code_points([text])[0]].astype(np.int32)
        for lang, table_ in zip(model.langs, model.tables):
            known = "".join(c if c.isalpha() else " " for c in samples[lang])
            flat = "".join(c if c.isalpha() else " " for c in text)
            phrases, at = 0, 0
            while at < len(flat):
                n = 0
                while at + n < len(flat) and flat[at:at + n + 1] in known:
                    n += 1
                if at + n == len(flat):
                    break
                phrases += 1
                at += n  # the character that ends a phrase begins the next one, unless the sample lacks it
                at += flat[at] not in known
            assert model.phrases(symbols, np.array([len(symbols)]), table_)[0] == phrases


def test_language_edges(spark, table):
    df = table([(1, "hello there", "en"), (2, None, None), (3, "12 !", "en"), (4, "hallo", None), (None, "hello", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.cross_fold(df).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[2]["score"] == 0.0 and got[None]["held_out"] is False
    empty = langid.cross_fold(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "held_out", "lang_pred", "score"]


def test_languages_of_few_distinct_texts_are_learned(spark):
    """Every language has a sample however often its texts are copied, and not of their first characters alone."""
    rows = spark.range(8 * 3000).selectExpr("concat('l', id % 8) AS lang", "concat(repeat('same words first ', 60), repeat(concat(' ', repeat(char(97 + id % 8), 5)), 300)) AS text")
    model = langid.fit(rows)
    assert model.langs == [f"l{i}" for i in range(8)]
    texts = [" ".join([chr(97 + i) * 5] * 20) for i in range(8)]
    assert model.predict(texts, model.lookup())[0] == model.langs


@pytest.mark.parametrize("cells", [langid.DENSE_CELLS, 0])
def test_large_scripts(cells, monkeypatch):
    """Languages that differ only in letters outside the most frequent few hundred are told apart."""
    monkeypatch.setattr(langid, "DENSE_CELLS", cells)
    rnd = random.Random(8)

    def words(first, letters, n):
        return ["".join(chr(first + rnd.randrange(letters)) for _ in range(rnd.randint(2, 3))) for _ in range(n)]

    common, own = words(0x4E00, 200, 400), {"s": words(0x7000, 600, 300), "t": words(0x8000, 600, 300)}

    def text(lang, n):
        return "".join(rnd.choice(own[lang] if rnd.random() < 0.2 else common) for _ in range(n))

    model = langid.LanguageModel({"s": text("s", 6000), "t": text("t", 5000)}, 20_000)
    texts = ["".join(rnd.choice(own[lang]) for _ in range(60)) for lang in ("s", "t")] + [text(lang, 200) for lang in ("s", "t")]
    assert model.predict(texts, model.lookup())[0] == ["s", "t", "s", "t"]
    assert len(model.symbols) > 600


# ---- HTML
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header class="site"><a href="/">Home</a></header>
<nav><ul><li><a href="/x">Menu {i}</a></li></ul></nav><div class="cookie-notice">We use cookies {i}</div>
<div id="wrap"><div class="{main}"><h1>Title {i}</h1><p>First &amp; <b>bold</b>&nbsp;text {body}.<br>After break<p>Second{i} paragraph, with <a href="#">a link</a>.
<div class="ad-box">Buy {i}</div><ul><li>One {i}<li>Two {i}</ul><p>Read more from our desk.</p><form><p>Sign {i}</p></form></div>
<aside>Side {i}</aside><section class="comments"><p>Reader {i} says a very long and thoughtful thing about this, twice over.</p></section></div>
<script>var a = "<p>no</p>";</script><footer>&copy; {i}</footer></body></html>"""


def page(i, main="article-body"):
    return PAGE.format(i=f"n{i}", main=main, body=" ".join(f"word{i}x{k}" for k in range(40)))


def want(i, constant):
    body = " ".join(f"word{i}x{k}" for k in range(40))
    return "\n".join([f"Title n{i}", f"First & bold text {body}. After break", f"Secondn{i} paragraph, with a link.", f"One n{i}", f"Two n{i}"]
                     + ["Read more from our desk."] * constant)


def test_wrapper_induction(table):
    rows = [(i, f"https://a.example.com/{i}", page(i)) for i in range(6)] + [(10, "http://b.example.com/", page(10)), (11, None, page(11, "main")),
            (12, "http://c.example.com", None), (13, "http://c.example.com/2", ""), (14, "x", "<p>broken <b>text"), (15, "x", "<p>broken <b>text")]
    for part_pages in (400, 2):
        got = {r["page_id"]: r for r in html_extract.extract(table(rows, "page_id long, url string, html string"), part_pages=part_pages).collect()}
        assert len(got) == len(rows)
        for i in range(6):  # the sentence that all pages of the host carry is template
            assert got[i]["text"] == want(i, 0)
        assert got[10]["text"] == want(10, 1) and got[11]["text"] == want(11, 1)
        assert got[12]["text"] == got[13]["text"] == "" and got[14]["text"] == got[15]["text"] == "broken text"
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_pages_table(spark):
    rows = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for i, source in rows:
        inner = re.search("<article>(.*)</article>", source, re.S)[1]
        inner = re.sub("</?b>", "", inner.replace("<br>", " "))
        blocks = [" ".join(html.unescape(x).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got[i] == "\n".join(b for b in blocks if b)


def test_tree_matching_size():
    a, b = html_extract.parse("<ul><li>x<li>y<li>z</ul>"), html_extract.parse("<ul><li>x<li>z</ul><p>q</p>")
    pairs = []
    assert html_extract.match(a, b, pairs) >= 4
    assert sorted((x.text, y.text) for x, y in pairs if x.tag == "#") == [("x", "x"), ("z", "z")]


def test_deep_pages_and_broken_markup():
    deep = "<html><body>" + "<div>" * 3000 + "<p>Text number %d of a page that is nested deeply goes on.</p>" + "</div>" * 3000 + "</body></html>"
    wrapper = html_extract.Wrapper([deep % i for i in range(3)])
    assert html_extract.main_text(deep % 7, wrapper) == "Text number 7 of a page that is nested deeply goes on."
    for bad in ("<a x ", "<!x ", "<b>", "<p>", "<!--", "<", "<li>", "<a '", "<a \" '", "<!DOCTYPE ", "<a href=\"x>", "</x>", "<div></x>", "<a><"):
        html_extract.main_text(bad * 20_000 + "end")  # ends, in time that grows with the page


def test_pages_without_an_article_element():
    two = ("<html><body><div id=top>Site name</div><div><div class=c1><p>" + "First part. " * 20 + "</p><p>More words.</p></div><div class=c2><p>" + "Second part. " * 8
           + "</p></div></div></body></html>")
    text = html_extract.main_text(two)
    assert text.startswith("First part.") and "More words." in text and text.endswith("Second part.") and "Site name" not in text
    menu = "".join(f"<li><a href=/{i}>Menu entry {i}</a></li>" for i in range(30))

    def page(i):
        return f"<html><body><div><ul>{menu}</ul></div><div><h2>Title {i}</h2><p>Short article {i} text.</p></div><div>All rights held</div></body></html>"

    for k in (2, 3, 4):
        wrapper = html_extract.Wrapper([page(i) for i in range(k)])
        assert html_extract.main_text(page(1), wrapper) == "Title 1\nShort article 1 text."
    other = "<html><body><table><tr><td>Another layout</td></tr></table></body></html>"
    wrapper = html_extract.Wrapper([page(0), page(1), page(2), other])
    assert html_extract.main_text(page(3), wrapper) == "Title 3\nShort article 3 text."  # one page of another layout does not undo the template


def test_what_an_article_holds_stays():
    page = ("<article><header><h1>Head</h1></header><p>Body.</p><div class='legal text'><p>Terms.</p></div><div class='comment-body'><p>no</p></div>"
            "<div class='share'>no</div><form>no</form></article><header>no</header>")
    assert html_extract.main_text(page) == "Head\nBody.\nTerms."


def test_long_lists_are_aligned_whole(monkeypatch):
    def page(i):
        rows = "".join(f"<li>row {j}</li>" if j % 40 else f"<li>own {i} {j}</li>" for j in range(1, 300))
        return f"<html><body><ul>{'<li>odd</li>' * (i % 2)}{rows}</ul></body></html>"

    for cells in (250_000, 50):
        monkeypatch.setattr(html_extract, "MAX_CELLS", cells)
        wrapper = html_extract.Wrapper([page(1), page(2), page(3)])
        assert html_extract.main_text(page(2), wrapper).split("\n") == [f"own 2 {j}" for j in range(40, 300, 40)]


def test_matching_does_not_depend_on_the_length_of_lists(monkeypatch):
    rng = random.Random(11)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["<p>one</p>", "<p>two</p>", f"<p>own {rng.random()}</p>", "<hr>", "<div></div>", "loose text", "<p>a<div>b</div></p>"])
        tag = rng.choice(["div", "ul", "section"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(6))) + f"</{tag}>"

    for _ in range(60):
        a, b = (html_extract.parse("".join(tree(3) for _ in range(rng.randrange(1, 9)))) for _ in range(2))
        found = []
        for cells in (1 << 60, 12, 0):
            monkeypatch.setattr(html_extract, "MAX_CELLS", cells)
            pairs = []
            size = html_extract.match(a, b, pairs)
            found.append((size, {(id(x), id(y)) for x, y in pairs}))
        assert found[0] == found[1] == found[2]


def test_rows_of_a_long_table_are_told_by_all_their_cells(monkeypatch):
    def page(i, n):
        rows = "".join(f"<tr><td>name {j}</td><td>yes</td><td>own {i} {j}</td></tr><tr><td>{i}.{j}</td></tr>" for j in range(i, n))
        return f"<html><body><table>{rows}</table></body></html>"

    for n in (30, 600):  # 600: lists of 1.4 million pairs
        wrapper = html_extract.Wrapper([page(i, n) for i in range(3)])
        assert html_extract.main_text(page(2, n), wrapper).split("\n") == [x for j in range(2, n) for x in (f"own 2 {j}", f"2.{j}")]


def test_references_of_a_host_do_not_depend_on_its_size(spark):
    hashes = {"a": [64 * k for k in range(-3, 9)] + [*range(700, 900)], "b": [64] * 30 + [128] * 30, "c": [*range(500, 450, -1)], "d": [None] * 20}
    rows = [(host, h) for host, hs in hashes.items() for h in hs]
    found = html_extract._large_hosts(spark.createDataFrame(rows, "host string, h long"), 4, 10).collect()
    assert {r.host: r.refs for r in found} == {"a": [-192, -128, -64, 0], "b": [64, 128], "c": [451, 452, 453, 454], "d": None}


def test_extract_defined_cases(table):
    assert html_extract.extract(table([], "page_id long, url string, html string")).collect() == []
    rows = [(1, None, None, "x", 1), (2, "http://a.b/c", "", "y", 2), (None, "no host", "<p>words here", "z", 3), (2, "http://a.b/c", "<p>twice</p>", "y", 2)]
    got = html_extract.extract(table(rows, "page_id long, url string, html string, text string, host int")).collect()
    assert sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in got if r.url) == [("2", "http://a.b/c", "", 0), ("2", "http://a.b/c", "twice", 5), ("None", "no host", "words here", 10)]
    assert [(r.page_id, r.text) for r in got if r.url is None] == [(1, "")]


# ---- chat
def brute_cost(recorded):
    best = chat.NEVER
    for roles in itertools.product((1, 2, 3), repeat=len(recorded)):
        change = sum(0 if a == b else chat.NAME if a == 0 else chat.RELABEL for a, b in zip(recorded, roles))
        for merges in itertools.product((0, 1), repeat=max(len(recorded) - 1, 0)):
            if any(m and roles[i] != roles[i + 1] for i, m in enumerate(merges)):
                continue
            path = [r for i, r in enumerate(roles) if i == 0 or not merges[i - 1]]
            states = list(zip([chat.START, *path], path))
            if all(s in chat.BETWEEN for s in states):
                put = sum(len(chat.BETWEEN[s]) for s in states) + len(chat.FINISH[path[-1] if path else chat.START])
                best = min(best, change + chat.MERGE * sum(merges) + chat.INSERT * put)
    return best


def test_repair_is_cheapest():
    rnd = random.Random(4)
    for _ in range(250):
        recorded = [rnd.randrange(4) for _ in range(rnd.randint(0, 5))]
        assert chat.repair(recorded)[0] == brute_cost(recorded)


def test_format_conversations(spark, table):
    rnd = random.Random(9)
    rows = [(c or None, t, rnd.choice(["user", "assistant", "system", "Human", None, "x"]), rnd.choice(["hi", None, "", "a\nb"]))
            for c in range(40) for t in range(rnd.randint(1, 9))]
    rows += [(99, t, rnd.choice(["user", "assistant", "assistant", "system"]), f"t{t}") for t in range(300)]
    df = table(rows, "conv_id long, turn long, role string, text string")
    turns = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2] is not None, r[2] or "", r[3] or "")):
        turns[c].append((r, x))
    for parts, whole in ((1, 20_000), (23, 20_000), (23, 3)):
        got = defaultdict(list)
        for r in chat.format_conversations(df, parts=parts, whole_turns=whole).collect():
            got[r["conv_id"]].append(r)
        assert set(got) == set(turns)
        for c, rows_ in turns.items():
            cost, done, last = chat.repair([chat.state_of(r) for r, _ in rows_])
            mine = sorted(got[c], key=lambda r: r["part"])
            assert sum(r["cost"] for r in mine) == cost and sum(r["n_turns"] for r in mine) == len(rows_)
            text = "".join(r["rendered"] for r in mine)
            roles = re.findall(r"<\|(system|user|assistant)\|>\n", text)
            assert re.fullmatch("(system )?(user assistant )*", "".join(r + " " for r in roles)) and len(roles) == sum(r["n_out"] for r in mine)
            if whole > 3:
                assert len(mine) == 1 and text == chat.render([x or "" for _, x in rows_], done, chat.FINISH[last], False, False)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# ---- BPE
@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe_path()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_path())


def test_bpe_equals_library(encoder, library, documents):
    rnd = random.Random(5)
    texts = ["", "a" * 5000, "ab" * 3000, "<|endoftext|>x<|startoftext|> <|endoftext|", "Don't we'LL ", "ΑΣ ΣΑΣ", "the" * 2000 + " ok"]
    texts += ["".join(rnd.choice("abcdeth tinasΣßÉİé'sll 9٣<|>!?😀\u0085\x1c ́日本") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["".join(rnd.choice("thenandiogs") for _ in range(rnd.randint(40, 2000))) for _ in range(80)]
    texts += ["".join(rnd.choice("!?#.-") for _ in range(rnd.randint(40, 900))) for _ in range(40)]
    for t in texts + [t or "" for _, t in documents]:
        ids = encoder.encode(t)
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert encoder.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_tree_equals_whole(encoder):
    rnd = random.Random(6)
    for _ in range(60):
        symbols = [rnd.choice(encoder.inner[97:105]) for _ in range(rnd.randint(2, 400))]
        small = bpe.Encoder.__new__(bpe.Encoder)
        small.__dict__.update(encoder.__dict__, leaf=3)
        assert small.tree(symbols) == encoder.merge(symbols)


def test_token_digests(table, documents, library):
    got = Counter(tuple(r) for r in bpe.token_digests(table([(d, t, 1) for d, t in documents], "doc_id long, text string, n_tokens int"), bpe_path()).collect())
    want_ = Counter()
    for d, t in documents:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want_[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
              hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want_


def test_encode_and_decode_tables(table, library):
    df = table([(1, "Hello world"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in bpe.decode_documents(bpe.encode_documents(df, bpe_path()), bpe_path()).collect()}
    ids = library.encode("Hello world", add_special_tokens=False).ids
    assert out[1]["ids"] == ids and out[1]["decoded"] == library.decode(ids, skip_special_tokens=False) and out[2]["ids"] == [] and out[2]["decoded"] == ""
