"""Passes of plain Python over pages: results in order, and few pages held at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from sitelens.functions import contents, dom, passes
from sitelens.operators import assets, blocks, pages
from sitelens.plans import queries

PAGE = "<html><body><div class='a'><h1>Page {0}</h1>" + "<p class='x'>word &amp; word" * 20 + "</div></body></html>"


def held(values, make, size=None):
    """The length of each piece, and how many values had been read when it came."""
    read = []

    def counted(value):
        read.append(value)
        return make(value)

    return [(len(piece), len(read)) for piece in passes.pieces(iter([pa.array(values)]), counted, size)]


def test_pieces_are_small_however_large_a_batch():
    short, long = ["<p>a</p>"] * 1000, ["<p>" + "a" * passes.SIZE] * 3
    assert held(short, dom.parse) == [(min(passes.ROWS, 1000 - k), min(k + passes.ROWS, 1000)) for k in range(0, 1000, passes.ROWS)]
    assert held(long, dom.parse) == [(1, 1), (1, 2), (1, 3)]
    deep = ["<p>" * 600] * 4  # the nodes hold 600 * 599 / 2 names
    assert held(deep, dom.parse)[0][0] == 4 and held(deep * 4, dom.parse, dom._around)[0] == (2, 2)
    assert held([None, "", None], dom.parse) == [(3, 3)]


def test_one_batch_of_many_pages(spark):
    n = 3 * passes.ROWS + 5
    rows = [(k, f"http://a.example.com/{k}", None if k % 50 == 7 else PAGE.format(k)) for k in range(n)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").coalesce(1)
    pages = df.withColumn("dom", dom.parse_dom(F.col("html")))
    got = {r.page_id: (r.n, r.h1) for r in pages.select("page_id", F.size("dom.nodes").alias("n"), dom.first_text(F.col("dom.nodes"), "h1").alias("h1")).collect()}
    assert got == {k: (None if h is None else 24, None if h is None else f"Page {k}") for k, _, h in rows}
    said = {r.page_id: r.title for r in df.select("page_id", contents.text_contents(F.col("html")).alias("c")).select("page_id", "c.title").collect()}
    assert said == {k: None if h is None else f"Page {k}" for k, _, h in rows}
    assert blocks.product_lists(df).count() == n


def test_page_passes_take_batches_by_iterator(spark):
    df = spark.createDataFrame([(1, "http://a.example.com/", "<p>a</p>")], "page_id int, url string, html string")
    for made in (df.select(dom.parse_dom(F.col("html"))), df.select(contents.text_contents(F.col("html"))), blocks.product_lists(df)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        line = next(x for x in plan.split("\n") if "ArrowEvalPython" in x)
        assert line.endswith(f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}")


def test_frequent_terms_are_counted_in_pieces(spark):
    rows = [(1, "one two one two one, three"), (2, "the and of"), (3, None), (4, "ab_cd naïve abc𝒳 xyz9 xyz9 İx"), (5, "Long LONG words Words long")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(tuple(r) for r in pages.top_terms(df, 2, 2).collect())
    assert got == [(1, "one two", 2, 1), (1, "two one", 2, 2), (4, "xyz9 xyz9", 1, 1), (5, "long long", 1, 1), (5, "long words", 1, 2)]
    top = df.select(F.col("doc_id"), assets.related_terms(F.col("text"), ["words"]).alias("t"))
    assert {r.doc_id: r.t for r in top.collect()} == {1: ["three"], 2: [], 3: [], 4: ["xyz9"], 5: ["long"]}
    assert "ArrowEvalPython" in pages.top_terms(df, 3)._jdf.queryExecution().executedPlan().toString()


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


def few_pages(spark):
    rows = [(1, "<p>one<p>two"), (1, "<p>one"), (2, ""), (3, None), (4, "no element"), (5, "<br>")]
    df = spark.createDataFrame(rows, "page_id int, html string")
    return df.withColumn("dom", dom.parse_dom(F.col("html"))).select("page_id", "dom.*")


def test_tags_are_counted_over_one_parse(spark):
    df = pages.tag_counts(few_pages(spark))
    assert python_steps(df) == 1
    assert sorted(tuple(r) for r in df.collect()) == [(1, "p", 3), (5, "br", 1)]


def test_equal_pages_are_told_over_one_parse(spark):
    docs = few_pages(spark).select(F.col("page_id").alias("doc_id"), F.col("visible").alias("text"))
    df = pages.duplicate_content(docs.unionByName(spark.createDataFrame([(7, None), (8, None)], "doc_id int, text string")))
    assert [tuple(r)[1:] for r in df.collect()] == [(2, 2)]  # both without text; nulls are no group
    assert python_steps(pages.duplicate_content(docs)) == 1


def test_references_are_decoded_also_where_they_are_cut_off():
    page = dom.parse("<title>token = &quot;77</title><h1>a &amp; b&amp</h1>")
    assert [n["text"] for n in page["nodes"]] == ['token = "77', "a & b&"] and page["full"] == 'token = "77 a & b&'


@pytest.mark.parametrize("name", ["content_structure", "page_scores", "page_jobs", "page_types"])
def test_queries_parse_once_and_by_iterator(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    steps = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "EvalPython [" in x]
    assert [x.rpartition(", ")[2] for x in steps] == [str(PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)]
