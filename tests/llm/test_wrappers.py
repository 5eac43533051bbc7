"""Wrapper induction: tree matching against the plain recursion, pages without telling names, and independence of partitions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import html


def article(page: str) -> str:
    inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S)[1]
    blocks = (" ".join(re.sub(r"<[^>]*>", " ", b).replace("&amp;", "&").replace("&quot;", '"').split()) for b in re.split(r"</?p>|</?h1>", inner))
    return "\n\n".join(b for b in blocks if b)


def bare(page: str) -> str:
    """A page whose elements tell nothing: no article, nav, footer or class."""
    return re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', "")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").cache()


def random_tree(rng, depth=0):
    node = html.Node(str(rng.choice(["div", "p", "ul"])))
    for _ in range(int(rng.integers(0, 4)) if depth < 4 else 0):
        node.children.append("text" if rng.random() < 0.3 else random_tree(rng, depth + 1))
    return node


def matched(a, b) -> int:
    """Simple tree matching as it is defined."""
    if isinstance(a, str) or isinstance(b, str):
        return int(isinstance(a, str) and isinstance(b, str))
    if a.tag != b.tag:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + matched(x, y))
    return 1 + m[-1][-1]


def test_tree_matching_is_the_plain_one():
    rng = np.random.default_rng(3)
    for _ in range(150):
        a, b = random_tree(rng), random_tree(rng)
        b.tag = a.tag
        want = matched(a, b)
        assert html._weight(html._number(a), html._number(b)) == want
        texts, nodes = html.aligned(a, b)
        assert len(texts) + len(nodes) == want


def test_pages_without_telling_names(spark, pages):
    rows = pages.collect()
    host = lambda r: re.search("://([^/?#]*)", r["url"])[1].lower()
    many = [h for h in {host(r) for r in rows} if sum(host(r) == h for r in rows) >= 5]
    asked = {r["page_id"]: article(r["html"]) for r in rows if host(r) in many}
    given = spark.createDataFrame([(r["page_id"], r["url"], bare(r["html"])) for r in rows], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html.op9(given).collect()}
    alone = {r["page_id"]: html.plain(bare(r["html"])) for r in rows}
    right = sum(found[k] == want for k, want in asked.items())
    assert len(asked) > 100 and right >= 0.95 * len(asked)
    assert sum(alone[k] == want for k, want in asked.items()) == 0


def test_partitions_do_not_matter(spark, pages):
    same = pages.withColumn("url", F.lit("http://one.example.com/")).withColumn("html", F.concat(F.lit("<p>This line stands on every page.</p>"), "html"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    done = []
    try:
        for n in (1, 4, 12):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            done.append({r["page_id"]: r["text"] for r in html.op9(same.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert done[0] == done[1] == done[2] and not any("stands on every page" in t for t in done[0].values())


def test_two_layouts_of_a_host():
    one = "<html><body><div><a>Home</a></div><main><h2>Head {0}</h2><p>Text {0} of the first kind.</p><p>Same words.</p></main></body></html>"
    two = "<html><body><table><tr><td><ul><li><a>x</a></ul></td><td><section><h3>Top {0}</h3><blockquote>Other text {0}.</blockquote></section></td></tr></table></body></html>"
    found = html.extract([(one if k % 2 else two).format(k) for k in range(12)])
    assert found == [f"Head {k}\n\nText {k} of the first kind." if k % 2 else f"Top {k}\n\nOther text {k}." for k in range(12)]


def test_copies_keep_their_text():
    page = "<html><body><div>Site</div><div><h1>Title</h1><p>One text for all.</p></div></body></html>"
    assert all("One text for all." in t for t in html.extract([page] * 6))
    some = [page.replace("Site", f"Site {k}").replace("One text for all.", "One text for all." if k % 2 else f"Text {k}.") for k in range(12)]
    assert all(("One text for all." if k % 2 else f"Text {k}.") in t for k, t in enumerate(html.extract(some)))
