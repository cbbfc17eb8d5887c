"""Runs of pages by hand-written cases; repeats, places and texts against plain forms; and odd input."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor.llm import html_extraction, html_runs
from corridor.llm.html_runs import ARTICLE, MAIN, NONE, OUT, runs

SCHEMA = "page_id long, url string, html string"


def text(page):
    found = runs(page)
    own = html_runs.level(found)
    return " ".join(r.text for r in found if r.state == own)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""), ("plain <  text &amp; more", "plain < text & more"), ("<p>a<p>b<br>c <b>d</b>e", "a b c de"), ("<p>x<!-- no --->y</p>z", "xy z"), ("a<!-->b<!--c", "ab"),
        ("<script>var t='</p>';if(a<b){}</script>x<style>p{}</style>y<title>t</title>", "xy"), ("<p title='>'>x</p><p title=it's>y</p><p cla", "x y"),
        ("<nav>n</nav><article><h1>T</h1><p>a&nbsp;\n b&#65;&copy</p></article><footer>f", "T a bA©"), ("<main>m<article>a</article>o</main>", "a"), ("<div id=content>c</div><div>d</div>", "c"),
        ("<body class='has-sidebar home'><div class=sidebar>s</div><div class=c1>k</div>", "k"), ("<article>a<section class=comments><article>c</article></section></article>", "a"),
        ("<article>a<div class='cookie-notice'>n</div><aside>s</aside><form>f<input value=x></form>b</article>", "a b"), ("<article><header><h1>T</h1><span>by me</span></header>a<footer>f</footer></article>", "T a"),
        ("<header>h</header><div role=main>m</div><div role=complementary>c</div>", "m"), ("<article class=comment>c</article><p>p", "p"), ("<article>a<p hidden>h</p><p style='display: none'>n</p></article>", "a"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"), ("<table><tr><td>a<td>b<tr><td>c</table>d", "a b c d"), ("x</article></p>y</div>z", "x yz"), ("<script>never closed", ""), ("<div class='post-content'>p</div><div class=post-footer>f</div>", "p"),
        ("<div class='content-sidebar-wrap'><div class=content>c</div><div class=sidebar>s</div></div>", "c"), ("<div class=widget-content>w</div><div class=forum-message>m</div>", "w m"), ("<div class=featured-post>f</div><div class='blog-post single'>p</div>", "p"),
        ("<article>a<span class=ad>buy</span>b</article>", "a b"), ("<article>uneven<b>bold<p>next</b></article><nav>n", "unevenbold next"),
    ],
)
def test_runs(page, want):
    assert text(page).replace("  ", " ") == want


def test_long_and_deep_pages():
    assert text("<article>" + "<p>x y" * 50_000 + "</article>").count("x y") == 50_000
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(text("<article>" + "a" * 3_000_000)) == 3_000_000
    assert text("<p a='" * 2000 + "x") == ""


def test_states():
    assert [r.state for r in runs("<nav>a</nav>b<main>c<article>d</article></main>")] == [OUT, NONE, MAIN, ARTICLE]
    assert [r.place for r in runs("<div class='b a7'><p>x<i>y</i></p></div>")] == ["/div.a0.b/p"]


def site(hosts=4, pages=30, seed=0):
    """Pages without names that say anything: lines that repeat on a host, unique ones, an article that is copied, and short runs."""
    rng = np.random.default_rng(seed)
    words = lambda n, of=5000: " ".join(f"w{k}" for k in rng.integers(0, of, n))
    rows = []
    for h in range(hosts):
        top, bottom, copy = [words(3) for _ in range(4)], [words(6) for _ in range(2)], [words(30) for _ in range(3)]
        for k in range(pages if h else 1):
            body = copy if k % 3 == 0 else [words(30) for _ in range(3)]
            rows.append((len(rows), f"http://h{h}.net/{k}", "<div>" + "".join(f"<span>{t}</span><br>" for t in top) + "</div><div class=x>" + "".join(f"<p>{p}" for p in body) + "</div><div class=z>" + bottom[k % 2] + "</div>" + (f"<i>{words(2)}</i>" if k % 4 else "")))
    return rows


def plain_repeats(rows):
    """Pages of every window of runs, by host, as far as four words or the page's end."""
    on = defaultdict(set)
    for _, url, page in rows:
        host, found = url.split("/")[2], runs(page)
        for k in range(len(found)):
            own, n = [], 0
            for r in found[k:]:
                own.append((r.place, r.text))
                n += len(r.text.split())
                if n >= 4:
                    break
            else:
                own.append("end")
            on[host, tuple(own)].add((url, page))
    return {w: len(p) for w, p in on.items() if len(p) > 1}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("host", "page", "text", "tokens", "gone")})


@pytest.mark.parametrize("ranges", [1, 13])
def test_repeats(spark, ranges, monkeypatch):
    rows = site()
    units = html_extraction.parsed(html_extraction.pages_of(frame(spark, rows))).cache()
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))  # a common beginning fills many ranges
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Counter(r.pages for r in html_extraction.repeats(units).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == Counter(plain_repeats(rows).values())


@pytest.mark.parametrize("few", [500_000, 0])
def test_unnamed_pages(spark, few, monkeypatch):
    monkeypatch.setattr(html_extraction, "FEW", few)
    rows = site(seed=1)
    got = {r.page_id: r for r in html_extraction.main_texts(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for page_id, url, page in rows:
        body = [r.text for r in runs(page) if r.place == "/div.x/p"]
        mine = got[page_id]
        if url.startswith("http://h0."):
            assert mine.n_repeated == 0 and mine.text.startswith("w")  # a host of one page keeps all
        else:
            assert mine.text.split()[: 90] == " ".join(body).split() and len(mine.text.split()) in (90, 92)  # copied articles stay, unique runs too
            assert mine.n_repeated == 5 and mine.n_chars == len(mine.text)


def test_lines_that_repeat_between_unique_ones(spark):
    """On pages without any structure, too: what repeats among differing neighbours goes, what is copied with them stays."""
    rows = [(k, f"http://h.net/{k}", f"<p>start of page {k // 2 if k < 10 else k}<p>sign up for our news today<p>rest of page {k // 2 if k < 10 else k}") for k in range(40)]
    got = {r.page_id: r.text for r in html_extraction.main_texts(frame(spark, rows)).collect()}
    assert got == {k: f"start of page {n} rest of page {n}" for k in range(40) for n in [k // 2 if k < 10 else k]}


def test_named_pages_and_odd_rows(spark):
    page = "<nav><a>Home page of all</a></nav><article><p>One text that is copied again and again.</p></article><footer>Imprint</footer>"
    rows = [(k, f"https://A.org/{k}", page) for k in range(6)] + [(6, None, page), (7, "no address", None), (None, "https://a.org/x", "<p>unique &lt;b&gt;"), (8, "https://a.org/x", ""), (0, "https://A.org/0", page), (9, "https://a.org/y", "<p>" + "long " * 100_000)]
    got = html_extraction.main_texts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    assert [r.text for r in by[0]] == ["One text that is copied again and again."] * 2 and len(by[0]) == 2
    assert by[3][0].n_repeated >= 2 and by[6][0].n_repeated == 0 and by[7][0].text == "" and by[7][0].n_chars == 0 and by[8][0].text == ""
    assert by[None][0].text == "unique <b>" and by[9][0].n_chars == 499_999
    assert html_extraction.main_texts(frame(spark, rows).limit(0)).count() == 0
