"""Template text inside articles, and articles that are no more than a hint."""

import re

from pyspark.sql import functions as F

from lumenfold.llm import common, htmltext


def texts(spark, pages):
    rows = [(i, f"http://in.example/{i}", p) for i, p in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def body(i):
    return " ".join(f"word{i}x{k}" for k in range(12))


def test_boilerplate_goes_from_articles(spark):
    page = "<body><article><p>Follow <b>us</b> everywhere</p><p>{0}</p><p>By <i>{1}</i> for the paper</p></article></body>"
    got = texts(spark, [page.format(body(i), f"writer{i}") for i in range(6)])
    assert got == {i: f"{body(i)}\nBy writer{i} for the paper" for i in range(6)}


def test_copies_and_few_pages_keep_it(spark):
    page = "<body><article><p>Follow us</p><p>{0}</p></article></body>"
    assert set(texts(spark, [page.format(body(i % 2)) for i in range(8)]).values()) == {f"Follow us\n{body(i)}" for i in range(2)}


def test_a_small_article_does_not_hide_the_page(spark):
    page = "<body><article><p>see {0}</p></article><div><p>{1}</p></div></body>"
    got = texts(spark, [page.format(i, body(i)) for i in range(6)])
    assert got == {i: f"see {i}\n{body(i)}" for i in range(6)}


def _stripped(page):
    """The page without ``article`` tags, its classes renamed."""
    return re.sub(r'class="(\w+)"', lambda m: f'class="x{len(m[1])}{m[1][::-1]}"', re.sub(r"</?article\b[^>]*>", "", page))


def test_template_finds_the_text_without_articles_and_class_names(spark):
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    host = F.regexp_extract("url", "//([^/]+)", 1)
    big = [r[0] for r in pages.groupBy(host.alias("h")).count().filter("count >= 5").collect()]
    rows = [tuple(r) for r in pages.filter(host.isin(big)).select("page_id", "url", "html").collect()]
    assert len(rows) > 60
    shape = "page_id long, url string, html string"
    text = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, shape)).collect()}
    bare = [(i, u, _stripped(p)) for i, u, p in rows]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(bare, shape)).collect()}
    assert got == text
    alone = {i: htmltext.extract(p, None)[0] for i, _, p in bare}  # no template: adverts stay
    assert sum(alone[i] != text[i] for i in text) > 0.9 * len(text)
