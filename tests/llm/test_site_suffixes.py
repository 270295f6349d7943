"""Blocks of pages, and repeated runs against a dictionary of all windows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from ridgeline.llm import html_blocks, site_suffixes

RANDOM = random.Random(12)
SCHEMA = "page_id bigint, url string, html string, host int, main string"


def prose(n):
    return " ".join(f"u{RANDOM.randrange(10**6)}" for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], SCHEMA)


def texts(frame):
    return {r.page_id: r.text for r in frame.collect()}


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("<article><h1>A &amp; B</h1><p>one<br>two <b>th</b>ree<p>four</article><footer>f</footer>", "A & B one two three four"),
        ('<nav>n</nav><div class="ad">x</div><main>m<aside>s</aside><form>f</form> n</main>', "m n"),
        ("<article>a<script>var t='</article>';</script><style>p{}</style><!-- <p>no</p> -->b</article>", "ab"),
        ('<main><article>a</article><section id="comments"><article>c</article></section></main>', "a"),
        ('<article>a<div class="reader-comments"><p>c</div><header>h</header>b</article>', "a b"),
        ('<div class="page no-sidebar has-menu"><article class="post with-comments">a</article></div>', "a"),
        ("<article>1 < 2 &lt;b&gt; &#x41;&copy &nbsp; x</article>", "1 < 2 <b> A© x"),
        ("<article>never <i>closed<p>end", "never closed end"),
        ("<article></article><p>out</p>", ""),
        ("<article>x</b></div> y</article>", "x y"),
        ('<article>a<img alt="x > y">b<td title=\'>\'>c</article>', "a b c"),
        ("", ""),
        ("<", "<"),
        ("plain text only", "plain text only"),
    ],
)
def test_blocks(spark, html, wanted):
    found = html_blocks.split(html)
    main = found[0] if found[0] is not None else [t for a, t in found[1] if not a]
    if html.startswith("<article></article>"):
        main = main if found[0] else []
    assert " ".join(main) == wanted


def test_classes_of_windows_equal_a_dictionary():
    for words in (1, 2, 3, 5, 8, 11):
        ids = np.array([RANDOM.randrange(3) for _ in range(400)], np.int64)
        rank = site_suffixes._same_windows(ids, words)
        by_window = defaultdict(set)
        for i in range(len(ids) - words + 1):
            by_window[tuple(ids[i : i + words])].add(rank[i])
        assert all(len(r) == 1 for r in by_window.values())
        order = sorted(by_window)
        assert [min(by_window[w]) for w in order] == sorted(min(by_window[w]) for w in order)


def test_repeated_runs_go_from_unmarked_pages(spark, monkeypatch):
    """Against a dictionary of windows: hosts without articles, copies of pages, null and empty pages, several tasks."""
    monkeypatch.setattr(site_suffixes, "STREAM", 500)
    words, share = 8, 10
    notices = [prose(RANDOM.randrange(5, 20)) for _ in range(4)]
    rows = []
    for i in range(120):
        host = RANDOM.choice(["a.example", "a.example", "b.example", "c.example"])
        body = [prose(RANDOM.randrange(0, 40)) for _ in range(RANDOM.randrange(4))] + RANDOM.sample(notices, RANDOM.randrange(3))
        RANDOM.shuffle(body)
        rows.append((i, f"https://{host}/p/{i}", "".join(f"<div>{t}</div>" for t in body) + "<nav>menu of the page</nav>"))
    rows += [(200 + k, rows[3][1], rows[3][2]) for k in range(30)]  # one page many times is one page
    rows += [(300, None, rows[4][2]), (301, "nowhere", None), (302, "http://z.example", ""), (303, "http://long.example/", "<p>" + prose(30_000))]
    pages, by_host = {}, defaultdict(set)
    for i, url, html in rows:
        host = url.split("/")[2].split(":")[0] if url and "//" in url else ""
        blocks = html_blocks.blocks(html or "")
        pages[i] = (host, [(w, z == html_blocks.ASIDE) for z, t in blocks for w in t.split()])
        by_host[host].add(tuple(t for _, t in blocks))
    on = defaultdict(set)
    for host, distinct in by_host.items():
        for page in distinct:
            flat = " ".join(page).split()
            for k in range(len(flat) - words + 1):
                on[host, tuple(flat[k : k + words])].add(page)
    wanted = {}
    for i, (host, flat) in pages.items():
        covered = set()
        for k in range(len(flat) - words + 1):
            n = len(on[host, tuple(w for w, _ in flat[k : k + words])])
            if n >= 2 and 100 * n >= share * len(by_host[host]):
                covered |= set(range(k, k + words))
        wanted[i] = " ".join(w for k, (w, aside) in enumerate(flat) if k not in covered and not aside)
    assert sum(len(w) < sum(len(x) + 1 for x, a in pages[i][1] if not a) - 1 for i, w in wanted.items()) > 50
    assert texts(site_suffixes.extract(table(spark, rows).repartition(4), words=words, share=share)) == wanted


def test_articles_lose_only_what_stands_outside_of_others(spark):
    """A notice inside an article goes when other pages have it outside; text that articles share stays."""
    notice, shared = prose(12), prose(60)
    rows = []
    for i in range(20):
        inside = f"<p>{notice}</p>" if i < 3 else ""
        outside = f"<div>{notice}</div>" if i >= 3 else ""
        rows.append((i, f"https://h.example/{i}", f"<article><p>{shared}</p>{inside}<p>own {i} {notice}</p></article>{outside}"))
    found = texts(site_suffixes.extract(table(spark, rows)))
    assert found == {i: f"{shared} own {i} {notice}" for i in range(20)}


def test_empty_table_and_ids(spark):
    none = site_suffixes.extract(table(spark, [(1, "u", "x")]).limit(0))
    assert none.columns == ["page_id", "url", "text", "n_chars"] and none.collect() == []
    rows = [(None, "http://a.example/", "<main>Größe</main>"), (None, None, "<main>b</main>"), (7, "x", "<main>c</main>"), (7, "x", "<main>c</main>")]
    found = sorted((r.page_id or 0, r.text, r.n_chars) for r in site_suffixes.extract(table(spark, rows)).collect())
    assert found == [(0, "Größe", 5), (0, "b", 1), (7, "c", 1), (7, "c", 1)]
