from conftest import rows

from postscope.operators.crawl import crawl_prefix, crawl_shelf
from postscope.sources.html import (ElementSpec, count_review_rows, extract_elements, extract_links, extract_shelf,
                                   page_row_counts, parse_pages, parse_shelf_page)

ROW = ('<tr id="review_{i}"><td class="field title"><div class="value"><a href="/book/show/{i}">{title}</a></div></td>'
       '<td class="field author"><div class="value"><a href="/a/{i}">{author}</a></div></td>'
       '<td class="field rating"><div class="stars" data-rating="{rating}"></div></td>'
       '<td class="field review"><div class="value">{review}</div></td></tr>')


def page(*rows_html):
    return '<html><body><table id="books">' + "".join(rows_html) + "</table></body></html>"


def test_shelf_goldens():
    html = page(
        ROW.format(i=1, title="Plain", author="Ann", rating="4", review=" Nice "),
        ROW.format(i=2, title="A <i>Nested</i>\n Title", author="Bo", rating="x", review=""),
        ROW.format(i=3, title="No Author", author="", rating="3", review="r"),
        '<tr id="other"><td class="field title"><div class="value"><a href="/z">Skip</a></div></td></tr>',
        # unclosed cells and paragraphs
        '<tr id="review_4"><td class="field title"><div class="value"><a href="/book/show/4">Open<p>Ended</a></div>'
        '<td class="field author"><div class="value"><a href="/a/4">Cy</a></div><td class="field review">'
        '<div class="value"><p><b>ok<br><p>fine</div>',
    )
    got = parse_shelf_page(html, "https://s")
    assert got[0] == (1, "Plain", "Ann", "https://s/book/show/1", 4, "Nice")
    assert got[1] == (2, "ANestedTitle", "Bo", "https://s/book/show/2", None, None)
    assert [g[0] for g in got] == [1, 2, 4]                 # row 3 lacks an author
    assert got[2][1:3] == ("OpenEnded", "Cy") and got[2][5] == "okfine"
    assert parse_shelf_page("<html><p>no table</p></html>") == []
    assert count_review_rows("<html><p>no table</p></html>") is None
    assert count_review_rows(html) == 4


def crawl_model(counts, per_page):
    keep = []
    for i, n in enumerate(counts, start=1):
        keep.append(i)
        if n is None or n < per_page:
            break
    return keep


def test_crawl_prefix(spark):
    cases = {"a": [100, 100, 40, 100], "b": [0, 100], "c": [100, None, 100], "d": [100, 100]}
    data = [(u, p, n) for u, cs in cases.items() for p, n in enumerate(cs, start=1)]
    df = spark.createDataFrame(data, "user_id string, page long, n_rows int")
    got = rows(crawl_prefix(df, 100), "user_id", "page")
    want = sorted(((u, p) for u, cs in cases.items() for p in crawl_model(cs, 100)), key=repr)
    assert got == want
    assert [p for u, p in got if u == "a"] == [1, 2, 3] and [p for u, p in got if u == "c"] == [1, 2]


def test_links(spark):
    df = spark.createDataFrame([(1, '<ul><li><a href="/x">X</a></li><li><a href="/y">Y y</a></li></ul>'), (2, "<p>none</p>")],
                               "page_id long, html string")
    assert rows(extract_links(df), "page_id", "pos", "href", "text") == [(1, 1, "/x", "X"), (1, 2, "/y", "Y y")]


def test_bad_pages_do_not_fail_the_job(spark, monkeypatch):
    deep = page(ROW.format(i=1, title="Deep", author="Ann", rating="99999999999", review="<p>" * 5000 + "x"))
    nested = "<div>" * 20000 + page(ROW.format(i=2, title="In", author="Bo", rating="3", review=""))
    data = [("u", 1, deep), ("u", 2, nested), ("u", 3, None), ("u", None, page(ROW.format(i=3, title="N", author="C", rating="1", review="")))]
    df = spark.createDataFrame(data, "user_id string, page long, html string")
    got = {r["title"]: (r["page"], r["position"], r["rating"], r["review"]) for r in extract_shelf(df).collect()}
    assert got == {"Deep": (1, 1, None, "x"), "In": (2, 101, 3, None), "N": (None, None, 1, None)}
    assert {(r["page"], r["n_rows"]) for r in page_row_counts(df).collect()} == {(1, 1), (2, 1), (3, None), (None, 1)}
    assert parse_pages(df).filter("error is not null").count() == 0


def test_crawl_shelf(spark):
    rows_of = lambda n: page(*[ROW.format(i=i, title=f"t{i}", author="a", rating="1", review="") for i in range(n)])
    data = [("u", 1, rows_of(3)), ("u", 2, rows_of(2)), ("u", 3, rows_of(3)), ("v", 1, "<p>busy"), ("v", 2, rows_of(3))]
    df = spark.createDataFrame(data, "user_id string, page long, html string")
    assert rows(crawl_shelf(df, per_page=3), "user_id", "page", "position") == [
        ("u", 1, 1), ("u", 1, 2), ("u", 1, 3), ("u", 2, 4), ("u", 2, 5)]


def test_elements_by_spec(spark):
    html = """<ul class="nav x"><li><a class=k href='/x'>X <b>y</b></a><li><a href=/z>Z</a></ul><div><a title="t">no link</a></div>"""
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = rows(extract_elements(df, ElementSpec("a", ("href",))), "page_id", "pos", "href", "text")
    assert got == [(1, 1, "/x", "Xy"), (1, 2, "/z", "Z"), (1, 3, None, "no link")]
    assert extract_elements(df, ElementSpec("a", ("href",), "ul", "nav")).count() == 2


def test_pages_behind_the_stop_are_not_parsed(spark, tmp_path):
    """A page behind its shelf's stop would fail the parser's test on its text; none does."""
    from postscope.operators.crawl import crawl_waves
    full = '<table id="books">' + "".join(f'<tr id="review_{i}"></tr>' for i in range(3)) + "</table>"
    short, late = '<table id="books"><tr id="review_1"></tr></table>', full.replace("review_", "review_late")
    rows = []
    for user, stop, n in (("a", 1, 40), ("b", 6, 30), ("c", 13, 90), ("d", 99, 20)):
        rows += [(user, p, short if p == stop else full if p < stop else late) for p in range(1, n + 1)]
    rows += [(None, 1, short), (None, 2, full), ("a", None, full), ("d", None, full), ("e", 1, None), ("e", 2, late)]
    parsed = spark.createDataFrame(rows, "user_id string, page long, html string")
    seen = spark.sparkContext.accumulator(0)
    from postscope.sources import html as H
    real = H.shelf_page

    def counted(text, site=H.SITE):
        if text and "review_late" in text:
            seen.add(1)
        return real(text, site)
    H.shelf_page, old = counted, H.shelf_page
    try:
        got = crawl_waves(parsed, per_page=3)
        kept = sorted((r["user_id"] or "", r["page"] or 0, r["n_rows"]) for r in got.collect())
        missed, _ = seen.value, H.parse_pages(parsed).collect()
    finally:
        H.shelf_page = old
    want = [("", 1, 1), ("", 2, 3), ("a", 1, 1), ("d", 0, 3), ("e", 1, None)]
    want += [("b", p, 3) for p in range(1, 6)] + [("b", 6, 1)] + [("c", p, 3) for p in range(1, 13)] + [("c", 13, 1)]
    want += [("d", p, 3) for p in range(1, 21)]
    assert kept == sorted(want) and missed == 0 and seen.value > 0       # the count does see a full parse
    # the stored waves hold no page behind a stop
    assert got.filter("n_rows is not null").count() == len(want) - 1


def test_a_page_is_parsed_once(monkeypatch):
    from postscope.sources import html as H
    built = []
    real = H._TreeBuilder
    monkeypatch.setattr(H, "_TreeBuilder", lambda: built.append(1) or real())
    assert H.shelf_page('<table id="books"><tr id="review_1"></tr></table>') == (1, []) and len(built) == 1


def test_pages_reach_a_worker_in_small_batches(spark):
    import pyarrow as pa

    from helpers import plan_text
    from postscope.sources import html as H
    html = '<table id="books">' + "".join(f'<tr id="review_{i}"></tr>' for i in range(3)) + "</table>"
    pages = spark.createDataFrame([("a", 1, html), (None, None, None)], "user_id string, page long, html string")
    parsed = H.parse_pages(pages)
    assert sorted(map(repr, parsed.collect())) == ["Row(user_id='a', page=1, n_rows=3, rows=[], error=None)",
                                                   "Row(user_id=None, page=None, n_rows=None, rows=[], error=None)"]
    # a plain UDF: Arrow would send 10,000 pages at once
    plan = plan_text(parsed)
    assert "BatchEvalPython" in plan and "MapIn" not in plan
    many = pa.RecordBatch.from_pylist([{"user_id": "a", "page": i, "html": html} for i in range(200)])
    sizes = [b.num_rows for b in H._parser(H.SITE, 3)(iter([many]))]
    assert sum(sizes) == 200 and max(sizes) <= H.PARSED_AT_ONCE
