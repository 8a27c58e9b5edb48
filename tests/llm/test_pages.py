"""The page, archive and vector operators against plain versions."""

import hashlib
import uuid
from collections import defaultdict

import numpy as np

from seatwise.llm import multi_index, queries, warc, wrappers
from seatwise.llm.common import shared_folder, table
from tests.llm.conftest import SF

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><header><h1>Title %d</h1><p>by me</p></header>
<p>First&nbsp;<b>bold</b> &amp;\n text %d<p>Second<br>line &lt;%d&gt;<div class="ad">Buy</div><ul><li>one<li>two</ul><section class="comments"><p>Nice!</p></section>
</article><aside>Other</aside><form><p>Mail</p></form><footer>(c)</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://a.org/{i}", PAGE % (i, i, i), 1) for i in range(12)] + [(90, None, None, 1), (91, "x", "", 1), (None, "http://b.org", "<p>Hi", 1)]
    rows += [(95 + i, "http://c.org/", f"<body><div id=menu>Go</div><div><p>Long words of text {i}</p><p>More {i}</p></div><div>Same</div>", 1) for i in range(10)]
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    for i in range(12):
        text = f"Title {i}\n\nFirst bold & text {i}\n\nSecond line <{i}>\n\none\n\ntwo"
        assert got[i] == (text, len(text))
    assert got[90] == got[91] == ("", 0) and got[None] == ("Hi", 2)
    assert got[97][0] == "Long words of text 2\n\nMore 2"


def test_main_text_outside_an_article_is_kept_whole(spark):
    long = "many words of the text " * 20
    split = f"<body><h1>Title</h1><div><p>{long}</p></div><section>More of it</section><table><tr><td>A cell</table></body>"
    copied = "<body><div id=menu>Go</div><div><p>Copied text</p></div><blockquote>Only here</blockquote></body>"
    rows = [(1, "http://one.org/", split)] + [(10 + i, f"http://copies.org/{i}", copied) for i in range(12)]
    rows += [(30 + i, f"http://copies.org/x{i}", f"<body><div id=menu>Go</div><div><p>Other text {i}</p></div></body>") for i in range(9)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "\n\n".join(["Title", long.strip(), "More of it", "A cell"])
    assert all(got[10 + i] == "Copied text\n\nOnly here" for i in range(12))
    assert all(got[30 + i] == f"Other text {i}" for i in range(9))


def test_wrappers_have_optional_and_repeated_groups():
    made = [wrappers.wrapper_of(list(wrappers.blocks(p))) for p in ("<div><p>a<p>b<p>c</div>", "<div><h2>t</h2><p>a</div>")]
    (item,) = wrappers.align(*made)
    inside = {x[wrappers.KIND]: (x[wrappers.OPTIONAL], x[wrappers.REPEATED]) for x in item[wrappers.INSIDE]}
    assert inside == {"h2": (True, False), "p": (False, True)}


def test_no_pages(spark):
    assert wrappers.extract(table(spark, SF, "pages").limit(0)).count() == 0
    path = f"{shared_folder(spark)}/no-pages-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, SF, "pages").limit(0), path)
    assert warc.resolve(warc.read_headers(spark, path)).count() == 0


def test_archives_are_an_exact_round_trip(spark):
    big, odd = "é" * 700, "a\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "u", big), (2, "u\r\nX: y", big), (3, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", odd), (8, "u", odd),
            (None, "u", big), (9, "u", odd[:-1])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(warc.read_headers(spark, path)).collect()}
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    for page, _, html in rows:
        value = (html or "").encode()
        first = max((p for p in groups[html or ""] if p is not None), default=None)
        revisit = len(value) >= 1000 and page != first
        assert got[page] == (len(value), hashlib.sha1(value).hexdigest(), "revisit" if revisit else "response", first if revisit else None)


def test_every_page_comes_back(spark):
    rows = queries.op6_warc(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in table(spark, SF, "pages").collect())


def test_recall_and_exact_scores(spark):
    rows = table(spark, SF, "embeddings").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    found = defaultdict(list)
    for r in queries.op3_multi_index(spark, SF).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        best = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        own = found[ids[q]]
        assert [r for r, _, _ in own] == list(range(1, 21)) and own == sorted(own, key=lambda r: (-r[2], r[1]))
        place = {i: n for n, i in enumerate(ids)}
        assert all(abs(s - scores[place[v]]) < 1e-12 for _, v, s in own)
        hits += len({v for _, v, _ in own} & {ids[i] for i in best})
    assert hits / (20 * len(found)) >= 0.9


def test_nearest_of_vectors_of_varied_norms(spark):
    draw = np.random.default_rng(4)
    for sigma in (0.3, 1.0):
        x = draw.normal(size=(6000, 16))
        x *= (draw.lognormal(sigma=sigma, size=6000) / np.linalg.norm(x, axis=1))[:, None]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        found = defaultdict(list)
        for r in multi_index.search(df, every=100, ahead=200).orderBy("query_id", "rank").collect():
            found[r.query_id].append(r.vec_id)
        assert sorted(found) == list(range(0, 6000, 100))
        for q, own in found.items():
            assert own == [i for i in np.argsort(-(x @ x[q]), kind="stable")[:21].tolist() if i != q][:20]


def test_vectors_that_take_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.0, 1.0]), (101, None), (102, [0.0, 0.0]), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [1.0]),
                                                   (None, [1.0, 1.0]), (106, [None, 1.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS key", "2 AS cell")
    found = defaultdict(list)
    for r in multi_index.search(df).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert set(found) == {0, 20, 40, 100}
    assert found[0] == list(range(1, 21)) and found[20] == list(range(20)) and found[40] == list(range(20)) and found[100] == list(range(20))
    few = multi_index.search(df.where("vec_id in (0, 100)")).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in sorted(few)] == [(0, 100, 0.0), (100, 0, 0.0)]
    assert multi_index.search(df.limit(0)).count() == 0


def texts_of(spark, pages):
    rows = [(i, f"http://h{i}.org/", page) for i, page in enumerate(pages)]
    return [r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_names_around_and_in_articles_count_as_a_whole(spark):
    body = "<article><h1>Title</h1><div class='{}'><p>First part</p></div><p>Second</p></article>"
    kept = ["search-and-rescue", "share-price", "side", "no-menu", "shared adventure"]
    dropped = ["share-buttons", "relatedPosts", "ad", "newsletter_signup box", "post-meta"]
    around = ["has-sidebar", "no-sidebar wide", "sidebar", "site with-nav"]
    pages = [body.format(name) for name in kept + dropped] + [f"<div class='{name}'>{body.format('x')}</div>" for name in around]
    whole, part = "Title\n\nFirst part\n\nSecond", "Title\n\nSecond"
    assert texts_of(spark, pages) == [whole] * len(kept) + [part] * len(dropped) + [whole] * len(around)


def test_deep_and_broken_pages(spark):
    deep = "<article>" + "".join(f"<div>w{i}" for i in range(5000)) + "</div>" * 5000 + "<p>end</p></article>"
    stray = "<article><p>It's <a title=\"x>y\">said</a> <b don't>so</b></p><p class=\"open>Lost</p><p>Kept</p></article>"
    got = texts_of(spark, [deep, stray, "<article><p>One</p><a b"])
    assert got[0] == "\n\n".join([f"w{i}" for i in range(5000)] + ["end"])
    assert got[1] == "It's said so\n\nLost\n\nKept" and got[2] == "One\n\n<a b"


def test_broken_markup_is_read_in_one_go():
    import time
    for piece in ("<a b", "<a b=\"", "<a b=\"x> <b>\" ", "<a 'x\"y ", "</p <!", "<p class='a", "<!-- ", "< < <", "<svg>", "a=\"'"):
        start = time.process_time()
        list(wrappers.blocks(piece * (1_000_000 // len(piece))))
        assert time.process_time() - start < 4, piece
