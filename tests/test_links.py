"""Golden pages: class selection, prefixes, two hops."""

from pyspark.sql import functions as F

from linecraft.operators import links as LK

PAGES = [
    (1, "https://fonts.example/browse",
     '<ul class="list-group"><li><a href="https://fonts.example/cat/a">A</a></li>'
     "<li><a href='/cat/b'>B</a></li></ul><!-- <a href=\"/hidden\"> --><script>var s='<a href=\"/no\">';</script>"),
    (2, "https://fonts.example/cat/a",
     '<a class="btn btn-success" href="https://fonts.example/item/1">get</a>'
     '<a class="btn" href="https://fonts.example/item/2">no</a>'
     '<a class="btn-success x" href="/item/3">yes</a>'),
    (3, "https://fonts.example/cat/b", '<a href="/item/1">plain</a>'),
    (4, "https://fonts.example/item/1",
     '<a href="https://cdn.example/x.zip">mirror</a><a href="https://fonts.example/dl/Font1.ttf">dl</a>'
     '<a href="https://fonts.example/dl/Font1b.ttf">dl2</a>'),
    (5, "https://fonts.example/item/3", '<a href="https://fonts.example/dl/Three.ttf">dl</a>'),
    (6, "https://fonts.example/item/2", "<p>no links</p>"),
]


def _pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_anchors_skip_comments_and_scripts(spark):
    a = LK.anchors(_pages(spark).where("page_id = 1"))
    assert [r.href for r in a.orderBy("anchor_no").collect()] == ["https://fonts.example/cat/a", "/cat/b"]


def test_visible_links_by_class_and_prefix(spark):
    by_class = LK.visible_links(_pages(spark), css_class="btn-success")
    assert sorted((r.page_id, r.href) for r in by_class.collect()) == [
        (2, "/item/3"), (2, "https://fonts.example/item/1")]
    dl = LK.visible_links(_pages(spark), prefix="https://fonts.example/dl/")
    assert sorted(r.file_name for r in dl.collect()) == ["Font1.ttf", "Font1b.ttf", "Three.ttf"]
    assert LK.visible_links(_pages(spark), css_class="nothing").count() == 0


def test_follow_links_two_hops(spark):
    pages = _pages(spark)
    start = pages.where("page_id = 1")
    got = sorted(tuple(r) for r in LK.follow_links(pages, start, download_prefix="https://fonts.example/dl/").collect())
    assert got == [(1, 2, 4, "https://fonts.example/dl/Font1.ttf", "Font1.ttf"),
                   (1, 2, 5, "https://fonts.example/dl/Three.ttf", "Three.ttf")]


def test_attribute_names_entities_and_relative_links(spark):
    html = ('<a data-href="/wrong" data-class="no" href="/right?a=1&amp;b=2" class="yes">x</a>'
            '<a href="../up">u</a><a href="./same/.">s</a><a href="#part">p</a><a href="?q=1">q</a><a href="//h.example/z">z</a>')
    pages = spark.createDataFrame([(1, "https://e.example/a/b/c?x=1", html)], "page_id long, url string, html string")
    rows = LK.anchors(pages).withColumn("to", LK.resolve(F.col("href"), F.col("url"))).orderBy("anchor_no").collect()
    assert (rows[0].href, rows[0].classes) == ("/right?a=1&b=2", ["yes"])
    assert [r.to for r in rows] == [
        "https://e.example/right?a=1&b=2", "https://e.example/a/up", "https://e.example/a/b/same/",
        "https://e.example/a/b/c?x=1", "https://e.example/a/b/c?q=1", "https://h.example/z"]


def test_only_links_inside_the_first_container(spark):
    html = ('<a href="/a">no</a><ul class="menu"><a href="/b">no</a></ul><UL id=x class="big list-group"><li><a href="/c">yes</a>'
            '<ul><a href="/d">yes</a></ul><ul class="list-group"><a href="/e">yes</a></ul><!-- </ul> --></li><a href="/f">yes</a></UL>'
            '<a href="/g">no</a><ul class="list-group"><a href="/h">no</a></ul>')
    rows = [(1, "https://x.example/", html), (2, "https://x.example/2#top", '<ul class="list-group"><a href="/c">open'),
            (3, "https://x.example/3", '<ul class="list-groups"><a href="/c">other class</a></ul></ul>'),
            (4, "https://x.example/4", ""), (5, "https://x.example/5", None), (6, "https://x.example/6", '<ul class=list-group></ul><a href="/z">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in LK.anchors(pages, container=("ul", "list-group")).orderBy("page_id", "anchor_no").collect():
        got.setdefault(r.page_id, []).append((r.anchor_no, r.href))
    assert got == {1: list(enumerate(["/c", "/d", "/e", "/f"])), 2: [(0, "/c")]}


def test_pages_are_met_without_their_fragment(spark):
    rows = [(1, "https://x.example/1#a", '<ul class="list-group"><a href="/2#b">i</a></ul><a href="/4">no</a>'),
            (2, "https://x.example/2#top", '<a class="btn-success" href="3">t</a>'),
            (3, "https://x.example/3", '<a href="https://dl.example/f.ttf">d</a>'),
            (4, "https://x.example/4", '<a class="btn-success" href="3">t</a>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = LK.follow_links(pages, pages.where("page_id = 1"), container=("ul", "list-group")).collect()
    assert [tuple(r) for r in got] == [(1, 2, 3, "https://dl.example/f.ttf", "f.ttf")]
