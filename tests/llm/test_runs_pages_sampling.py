"""Periodic runs, main text of pages and importance resampling against brute force, with odd rows and clashing columns."""
import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sessionmill.llm import importance, page_text, periodic, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, `a.b` int, __t string, runs int, collapsed string, k string, score int, rank int, t string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    base = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(9001, None), (9002, ""), (9003, " \n\t "), (None, "no key " * 30), (9005, "same text " * 40), (9005, "same text " * 40), (9005, "other text"),
           (9006, "a " * 3000), (9007, "x\x0by\x0cz\r\n" * 9), (9008, "Ä ö\x1c日本   ß " * 20), (9009, " ".join(["one two three four"] * 7 + ["end"]) * 9),
           (9010, "ONE two-two 3rd été x_y " * 8)]
    rows = [(k, t, 1, "t", 2, "c", "k", 3, 4, "u") for k, t in base + odd]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if j > i and size >= max(24, 3 * q) and not any(all(w[k] == w[k - d] for k in range(s + d, j)) for d in range(1, q)):
                out.append((s, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs))


def test_runs_equal_brute_force(docs, empty):
    got = Counter((r["doc_id"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.find_runs(docs, ["doc_id"]).collect())

    def want(k, t):
        w = WORD.findall(t or "")
        runs = brute_runs(w)
        return k, tuple(runs), brute_collapse(w, runs)
    expected = Counter(want(r["doc_id"], r["text"]) for r in docs.collect())
    assert got == expected and sum(bool(k[1]) for k in expected) >= 5
    assert periodic.find_runs(empty, ["doc_id"]).count() == 0 and periodic.find_runs(docs, ["a.b"]).columns == ["a.b", "runs", "collapsed"]


def test_runs_of_nested_and_close_periods():
    rng, texts = random.Random(3), []
    for _ in range(900):
        w, k = [], rng.choice([1, 2, 2, 3, 6, 40])
        while len(w) < rng.choice([20, 90, 220]):
            unit = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 31, 33]))]
            w += (unit * 70)[:rng.randrange(1, 5 * len(unit) + 20)]
            if rng.random() < 0.4:
                a = rng.randrange(len(w))
                w += w[a:a + rng.randrange(1, 60)]
        texts.append(w)
    split, ids, begin = periodic.split_words(pa.array([" ".join(map(str, w)) for w in texts]))
    at, lags = periodic.openings(ids, begin)
    found = 0
    for n, w in enumerate(texts):
        mine = (at >= begin[n]) & (at < begin[n + 1])
        runs = periodic.sweep(w, (at[mine] - begin[n]).tolist(), lags[mine].tolist())
        assert runs == brute_runs(w)
        found += len(runs)
    assert found > 500


def test_few_diagonals_open_where_a_word_never_ends():
    _, ids, begin = periodic.split_words(pa.array(["a " * 20_000, ("p q " * 9 + "r ") * 900]))
    at, _ = periodic.openings(ids, begin)
    assert len(at) < 20_000


def test_query_of_runs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows)
    edited = 0
    for d in rows:
        w, h = WORD.findall(d["text"] or ""), zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            edited += 1
        runs, r = brute_runs(w), got[d["doc_id"]]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapse(w, runs).encode()).hexdigest()
    assert edited > 5


def test_minimum_cut_equals_all_labellings():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randrange(1, 9)
        pull = [rng.choice([0.0, rng.uniform(-3, 3)]) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(label):
            return sum(max(p, 0) if not x else max(-p, 0) for p, x in zip(pull, label)) + sum(c for a, b, c in edges if label[a] != label[b])
        assert math.isclose(cost(page_text.min_cut(pull, edges)), min(map(cost, itertools.product((False, True), repeat=n))), abs_tol=1e-6)


PAGES = [
    (1, "<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><main><h1>Head &amp; line</h1><p>First  para\n with <b>bold</b> "
        "and <a href=y>a link</a>.<p>Second, &eacute;t&eacute; &#8212; &ampx.<script>var x='</p>';</script></p><div class='share-buttons'><a>Share</a></div>"
        "<section id=comments><article><p>I liked this piece very much, it is well written.</p></article></section></main><aside><p>Related things to read today.</p></aside>"
        "<footer>&copy; 2024</footer>", "Head & line\nFirst para with bold and a link.\nSecond, été — &x."),
    (2, "<div class='cookie-notice'><p>We use cookies to make this site work, please agree.</p></div><div id='content'><h2 class=title>Words</h2><p>A long sentence stands here, and it has a "
        "second part as well.</p><ul><li>one thing<li>another</ul><form><label>Name</label><input><p>Write to us, we answer quickly.</p></form></div>"
        "<div class=advert>Buy now, while it lasts.</div>", "Words\nA long sentence stands here, and it has a second part as well.\none thing\nanother"),
    (3, None, ""), (4, "", ""), (5, "<nav><a>Only</a> a menu</nav><!-- open <p>comment", ""), (6, "<article><p>Cut off in a ta<b", "Cut off in a ta"),
    (7, "<article><p><b>Bold line.<br><p>Next</b> one.<p hidden>not shown</p>&amp;&am</article>", "Bold line.\nNext one.\n&&am"),
    (8, "<form id=f><article><header class=entry-header><h1>In a form</h1></header><p>Text.</p></article><button>Go</button></form>", "In a form\nText."),
    (9, "<article>" + "<p>Line of a very long page.</p>" * 5000 + "</article>", "\n".join(["Line of a very long page."] * 5000)),
    (9, "<article><p>a b   c<br>d<table><tr><td>x<td>y</table></article>", "a b c d\nx\ny"),
    (None, "<article><p>No key.</p></article>", "No key."), (None, "<article><p>No key.</p></article>", "No key.")]


def test_main_text_of_odd_pages(spark):
    real = [(r["page_id"], r["html"], None) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows = [(k, h, 1, "t", "x", 2) for k, h, _ in PAGES + [(100 + k, h, t) for k, h, t in real]]
    pages = spark.createDataFrame(rows, "page_id long, html string, `a.b` int, __t string, text string, n_chars int").repartition(3)
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in page_text.extract(pages, ["page_id"]).collect() if r["page_id"] is None or r["page_id"] < 100)
    assert got == Counter((k, t, len(t)) for k, _, t in PAGES)
    assert page_text.extract(pages.limit(0), ["page_id"]).count() == 0
    assert page_text.extract(pages, ["a.b"]).columns == ["a.b", "text", "n_chars"]


def test_main_text_of_the_pages_table(spark):
    """Its pages hold their text in one article of titles and paragraphs."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op12_html_extraction(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_unnamed_blocks_follow_the_classifier():
    """Without names, prose is content and rows of links are not; a short line between paragraphs goes with them."""
    x, y = [], []
    for n in range(200):
        for b in page_text.blocks_of(f"<article><h1>Title {n}</h1><p>Sentence {n} is here, and it goes on for a while. It ends.</p></article><nav><ul><li><a>Item {n}</a><li><a>More</a></ul></nav>"):
            x.append(page_text.features([b])[0])
            y.append(b.at.says > 0)
    weights = page_text.fit(np.array(x), np.array(y, float))
    prose = "This sentence is long enough to be read, and it goes on for a while. It ends."
    page = f"<div><ul><li><a>Home</a><li><a>News</a><li><a>About</a></ul></div><div><p>{prose}</p><p>Short</p><p>{prose}</p></div><div><ul><li><a>Terms</a><li><a>Help</a></ul></div>"
    assert page_text.main_text(page, weights) == f"{prose}\nShort\n{prose}"


def brute_resample(rows, target, longest, least, percent, buckets):
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(grams(x)[1])
    for x in target:
        t.update(grams(x)[1])
    total, goal = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (goal + buckets)))) for b in s}
    out = []
    for k, x in rows:
        n, f = grams(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    for i, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = i
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("longest, percent, buckets", [(1, 10, 10_000), (3, 55, 97), (2, 0, 500), (1, 100, 10_000)])
def test_resampling_equals_brute_force(spark, docs, empty, longest, percent, buckets):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = importance.resample(docs, target, longest=longest, percent=percent, buckets=buckets)
    want = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], longest, 20, percent, buckets)
    assert Counter(map(tuple, got.collect())) == want and got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    if longest == 2:
        assert importance.resample(empty, target).count() == 0 and importance.resample(docs, empty).count() == docs.count()


def test_words_of_slices_are_those_of_their_texts():
    """A slice of a batch begins inside the batch's buffers."""
    texts = [f"Ä{'ö' * (i % 7)}{i} Two, three\n ÉTÉ{i % 5} x" * (i % 4) for i in range(300)]
    whole = pa.array(texts)
    for a, n in ((0, 300), (7, 100), (150, 150), (299, 1)):
        part = whole.slice(a, n)
        split, ids, begin = periodic.split_words(part)
        assert [WORD.findall(t) for t in texts[a:a + n]] == [[w for w in x if w] for x in split.to_pylist()] and len(ids) == begin[-1]
        words, begin = importance.split_words(part)
        flat = words.cast(pa.string()).to_pylist()
        low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        assert [flat[i:j] for i, j in zip(begin, begin[1:])] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) for t in texts[a:a + n]]
