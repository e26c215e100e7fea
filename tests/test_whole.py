"""Queries do their whole job: what a cut would leave out is in these small tables."""

from corpusgrid.queries import QUERIES

MARKDOWN = {
    "plain *bold* _it_ ~x~ `code`": "plain bold it x code",
    "# Title\n###### six\n####### seven\n#no\nmid # sign": "Title\nsix\n####### seven\n#no\nmid # sign",
    "a [label](x.md) and ![img](y.png)!": "a label and img!",
    "open [label and [x] (y) and ![z]": "open [label and [x] (y) and ![z]",
    "see <https://a.b/c_d> or <http://e> or <b> or <https://open": "see  or  or <b> or https://open",
    "before\n```py\nkept *as is* [l](t)\n```\nafter *x*": "before\nkept *as is* [l](t)\nafter x",
    "x```\nnever closed *y*": "xnever closed *y*",
    "one line ```": "one line ",
    "": "",
}


def test_markdown_is_stripped_not_emptied(spark, tmp_path):
    texts = [*MARKDOWN, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.id: r.text for r in QUERIES["strip_markdown_text"](spark, str(tmp_path)).collect()}
    assert found == {i: None if t is None else MARKDOWN[t] for i, t in enumerate(texts)}
