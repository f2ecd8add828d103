import random

import pytest

from chunkloom.llm import op1_pages
from chunkloom.llm.op1_pages import ARTICLE, BOILERPLATE, UNKNOWN, common_lines, parse_lines
from oracle import connect, differences


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def is_subsequence(part, whole):
    left = iter(whole)
    return all(x in left for x in part)


@pytest.mark.parametrize("divide", [False, True])
def test_common_lines_are_a_longest_common_subsequence(divide, monkeypatch):
    if divide:
        monkeypatch.setattr(op1_pages, "LCS_CELLS", 8)
    rng = random.Random(2)
    for _ in range(600):
        k = rng.choice([2, 6, 20])
        a, b = ([rng.randint(0, k) for _ in range(rng.randint(0, 25))] for _ in "ab")
        at = common_lines(a, b)
        assert at == sorted(set(at)) and is_subsequence([a[i] for i in at], b) and len(at) == lcs(a, b)


@pytest.mark.parametrize(("page", "text"), [
    ("<p>a &amp; b &#8212; &copy;<br>c\n d</p>", "a & b — ©\nc d"),
    ("<nav>x</nav><div class='ad'>y</div><p>z<footer>f</footer>", "z"),
    ("<main><h1>T</h1><div id=sidebar>no</div><script>if(a<b)'</p>'</script><p>a<img alt='y > z'>b</main><p>out", "T\nab\nout"),
    ("<article><p>Q</p><section class=comment-list><article class=comment>c</article></section><p>R</article>", "Q\nR"),
    ("<body class='has-sidebar'><p title=it's>one</p><p>two</p>", "one\ntwo"),
    ("<form>f<input value=x></form><aside>s</aside><p hidden>h</p>t<!-- c -->u", "tu"),
    ("1 < 2 <b>bold", "1 < 2 bold"), (None, ""), ("", ""), ("<p>open <i", "open"),
    ("<article><h2 id='related-work'>Related work</h2><p id='search'>On search</p><blockquote class='promo'>Said</blockquote><div class=share>Share</div></article>", "Related work\nOn search\nSaid"),
    ("<article class=promo>teaser</article><article class='related'>teaser</article><div id=story><h1 id=menu>Story</h1><p>of the day</div>", "Story\nof the day"),
    ("<article>teaser</article><div><p>The story in plain blocks</p></div>", "teaser\nThe story in plain blocks"),
])
def test_parse(page, text):
    """Without neighbours markup decides alone."""
    lines = parse_lines(page)
    assert "\n".join(t for t, state, _ in lines if state != BOILERPLATE) == text


def test_states_and_places():
    assert parse_lines("<p>a</p><article>b</article><nav>c<ul><li>d</nav>") == [("a", UNKNOWN, "p"), ("b", ARTICLE, "article"), ("c", BOILERPLATE, "nav"), ("d", BOILERPLATE, "nav/ul/li")]


def test_stray_tags_take_linear_time():
    import time

    began = time.perf_counter()
    assert [t for t, _, _ in parse_lines("<div>" * 40_000 + "</table>" * 40_000 + "x" + "</div>" * 40_000)] == ["x"]
    assert time.perf_counter() - began < 5


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_differencing_deletes_shared_lines_of_neighbours(spark):
    """Lines shared with the pages before or after by path go, in whatever plain blocks; others stay, beside an article too."""
    body = lambda i: f"<div>Top line</div><p>Story {i}</p><p>Only {i}</p><div>Bottom line</div>"
    rows = [(i, f"http://h.org/s/{i:03d}", body(i)) for i in range(40)] + [(100, "http://other.org/s/001", "<div>Top line</div><p>Alone</p>"), (101, "http://h.org/zzz", "<div>Top line</div><article><p>Top line</p></article><p>Beside</p>")]
    rows += [(200 + i, f"http://k.org/{i}", f"<div>Shared menu</div><article>Teaser {i}</article><div>Story {i} in a plain block</div>") for i in range(3)]
    pages = pages_of(spark, rows)
    got = texts(op1_pages.main_text(pages))
    assert all(got[i] == f"Story {i}\nOnly {i}" for i in range(40))
    assert got[100] == "Top line\nAlone" and got[101] == "Top line\nBeside"
    assert all(got[200 + i] == f"Teaser {i}\nStory {i} in a plain block" for i in range(3))
    assert texts(op1_pages.main_text(pages, broadcast_bytes=0)) == got


def test_copies_are_no_neighbours(spark):
    """Copies of a page, next to each other by path, lose their menu to other pages and keep their story."""
    page = lambda k: f"<div>Menu</div><p>Story {k}</p>"
    rows = [(i, f"http://h.org/{i:03d}", page("copied")) for i in range(30)] + [(100, "http://h.org/500", page("other"))] + [(200 + i, f"http://only.org/{i}", page("alone")) for i in range(5)]
    got = texts(op1_pages.main_text(pages_of(spark, rows)))
    assert {got[i] for i in range(30)} == {"Story copied"} and got[100] == "Story other"
    assert {got[200 + i] for i in range(5)} == {"Menu\nStory alone"}


def test_passages_shared_by_articles_stay(spark):
    rows = [(i, f"http://h.org/{i}", f"<nav>Home</nav><article><p>Story {i}</p><p>A licence that many articles end with</p></article><footer>Foot</footer>") for i in range(6)]
    assert texts(op1_pages.main_text(pages_of(spark, rows))) == {i: f"Story {i}\nA licence that many articles end with" for i in range(6)}
    decided = [x for r in op1_pages.decided_lines(pages_of(spark, rows)).collect() for x in r.lines if not x.stays]
    assert len(decided) == 12 and all(x.shared for x in decided)  # menu and footer go by differencing already


def test_lines_of_pages_without_an_article(spark):
    """Precision and recall of lines, where nothing but differencing tells menus from stories; the end of a longer menu than both neighbours have stays."""
    rng = random.Random(5)
    menu = [f"Menu {k}" for k in range(6)]
    rows, truth = [], {}
    for i in range(120):
        story = [f"Sentence {i} {k} {rng.random()}" for k in range(rng.randint(1, 6))]
        if rng.random() < 0.2:
            story.append("A passage that two or three stories repeat")
        truth[i] = story
        shown = "".join(f"<div>{m}</div>" for m in menu[: rng.randint(3, 6)])
        rows.append((i, f"http://h{i % 4}.org/{rng.randint(0, 50):02d}/{i}", f"{shown}<div>Story</div>{''.join(f'<p>{t}</p>' for t in story)}<div>Imprint</div>"))
    got = {i: t.split("\n") for i, t in texts(op1_pages.main_text(pages_of(spark, rows))).items()}
    right = sum(len(set(got[i]) & set(truth[i])) for i in truth)
    precision, recall = right / sum(map(len, got.values())), right / sum(map(len, truth.values()))
    print("lines without an article:", precision, recall)
    assert precision >= 0.9 and recall >= 0.9


def test_share_decided_by_differencing(spark):
    """What README says: on the test tables few menus and footers are shared, so markup decides nearly all lines."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    row = op1_pages.decided_lines(pages).selectExpr("inline(lines)").selectExpr("count_if(NOT stays) AS gone", "count_if(NOT stays AND shared) AS differenced", "count_if(stays) AS staying", "count_if(stays AND shared) AS spared", "count_if(state = 1) AS unknown").first()
    print("lines:", row.asDict())
    assert row.unknown == 0 and 0 < row.differenced < row.gone


def test_query_equals_sql(spark, sf, tmp_path):
    only_sql, only_spark, expected, got = differences(spark, connect(sf), op1_pages.op1_pages, op1_pages.ORACLE, sf, tmp_path / "out")
    assert (only_sql, only_spark) == (0, 0) and expected == got
