import time

import pytest

from plumeledger.llm import html_extract as H

WORDS = "the quiet harbour town wakes early and its boats leave before the sun has cleared the long grey wall of the northern pier".split()


def prose(i, n=3):
    return [" ".join(WORDS[(i * 7 + j * 3 + k) % len(WORDS)] for k in range(18)).capitalize() + "." for j in range(n)]


def page(i, main="article", cls=""):
    p = "".join(f"<p>{t}</p>" for t in prose(i))
    return f"<html><body><nav><ul><li><a href=/>Home</a><li><a href=/x>News {i}</a></ul></nav><{main}{cls}><h1>Title {i} of the day</h1>{p}</{main}><footer><p>© {i} Somebody</p></footer></body></html>"


def extract(spark, rows, schema="page_id long, url string, html string", **k):
    df = spark.createDataFrame(rows, schema)
    return {r.page_id: r.text for r in H.extract(df, H.train(df, **k)).collect()}


def test_a_page_beyond_the_bytes_is_passed_over(spark):
    rows = [(i, "u", page(i)) for i in range(24)] + [(99, "u", page(99) + "<!--" + "x" * 60_000 + "-->")]
    got = extract(spark, rows, max_bytes=40_000)
    assert all(prose(i)[0] in got[i] and "News" not in got[i] for i in range(24)) and prose(99)[0] in got[99]


def test_pages_without_an_article_element(spark):
    got = extract(spark, [(i, "u", page(i, "div", " class=content")) for i in range(24)])
    assert all(all(t in got[i] for t in prose(i)) and "News" not in got[i] and "Somebody" not in got[i] for i in range(24))


def test_odd_rows(spark):
    rows = [(1, None, page(1), 5), (1, "u", page(1), 5), (2, "u", None, 5), (3, "u", "", 5), (None, "u", page(4), None)] + [(i, "u", page(i), i) for i in range(5, 20)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text int")
    got = H.extract(df, H.train(df)).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got}[2] == "" and {r.page_id: r.n_chars for r in got}[3] == 0
    assert [r.text for r in got if r.page_id == 1][0] == [r.text for r in got if r.page_id == 1][1] != ""
    empty = df.limit(0)
    assert H.extract(empty, H.train(empty)).count() == 0
    assert prose(1)[0] in next(r.text for r in H.extract(df, H.train(empty)).collect() if r.page_id == 1)


def test_densest_blocks():
    assert H.densest([]) == []
    b = H.leaf_blocks(page(1, "div"))
    assert [t for (t, _, _), y in zip(b, H.densest(b)) if y] == ["Title 1 of the day", *prose(1)] or [t for (t, _, _), y in zip(b, H.densest(b)) if y] == prose(1)
    assert H.densest(H.leaf_blocks("<nav>a b</nav><div>short text</div>")) == [0, 1]


def test_nesting_takes_linear_time():
    def seconds(n):
        t = time.perf_counter()
        blocks = H.leaf_blocks("<div class=a>x" * n + "</div>" * n)
        assert len(blocks) == n and blocks[-1][1] == ("div", ".a")
        return time.perf_counter() - t

    seconds(500)
    assert seconds(8000) < 30 * max(seconds(1000), 1e-3)


@pytest.mark.parametrize("text", ["<p>a</b></i></u>b</p>", "<b><div>a</b>b</div>c"])
def test_stray_end_tags(text):
    assert " ".join(t for t, _, _ in H.leaf_blocks(text)).replace(" ", "") in ("ab", "abc")
