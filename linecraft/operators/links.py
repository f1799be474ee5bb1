"""Links in stored HTML pages.

Anchors are found with built-in regular expressions after script, style and comment
blocks are removed (their content is not markup). Following links is a fixed number of
equi-joins of the link table with the page table on the resolved URL; a URL linked from
a third of all pages is a hot join key, which adaptive skew-join splitting absorbs, and
each hop first reduces its links to distinct (source, target) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WS = r"[ \t\n\r\f]"
NON_MARKUP_RE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
ANCHOR_RE = r"(?is)<a" + _WS + r"[^>]*>"
HREF_RE = r"(?is)" + _WS + r"href" + _WS + r"*=" + _WS + r"*(?:\"([^\"]*)\"|'([^']*)'|([^\"'> \t\n\r\f]+))"
CLASS_RE = r"(?is)" + _WS + r"class" + _WS + r"*=" + _WS + r"*(?:\"([^\"]*)\"|'([^']*)'|([^\"'> \t\n\r\f]+))"

# Character references of attribute values; the ampersand comes last.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _attr(tag: Column, pattern: str) -> Column:
    vals = [F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]
    found = F.regexp_extract(tag, pattern, 0) != ""
    text = F.concat(*vals)
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.when(found, text)


def _classes(tag: Column) -> Column:
    found = _attr(tag, CLASS_RE)
    return F.when(found.isNull(), F.array().cast("array<string>")) \
        .otherwise(F.filter(F.split(F.trim(found), _WS + "+"), lambda x: x != ""))


def inside_first(tags: Column, element: str, css: str) -> Column:
    """Of the tags of a page, those between the first ``element`` of class ``css`` and its end.

    The tags are folded with the number of open elements of that name: nested ones are passed over,
    and the end tag that brings the number back is the container's. Only places are kept in the
    fold, so it takes one step a tag. A container that isn't closed ends with the page.
    """
    opens, closes = rf"(?is)^<{element}\b", rf"(?is)^</{element}\b"

    def step(a, tag):
        begins = (a["begin"] == 0) & tag.rlike(opens) & F.array_contains(_classes(tag), css)
        within = (a["begin"] > 0) & (a["end"] == 0)
        depth = (F.when(begins, F.lit(1)).when(within & tag.rlike(opens), a["depth"] + 1)
                 .when(within & tag.rlike(closes), a["depth"] - 1).otherwise(a["depth"]))
        ends = within & tag.rlike(closes) & (a["depth"] == 1)
        return F.struct((a["at"] + 1).alias("at"), depth.alias("depth"),
                        F.when(begins, a["at"]).otherwise(a["begin"]).alias("begin"),
                        F.when(ends, a["at"]).otherwise(a["end"]).alias("end"))

    zero = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("begin"), F.lit(0).alias("end"))

    def cut(a):
        last = F.when(a["end"] > 0, a["end"]).otherwise(a["at"])
        return F.struct(a["begin"].alias("begin"), F.greatest(last - a["begin"] - 1, F.lit(0)).alias("n"))
    place = F.aggregate(tags, zero, step, cut)
    return F.when(place["begin"] > 0, F.slice(tags, place["begin"] + 1, place["n"])).otherwise(F.array().cast("array<string>"))


def anchors(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url",
            container: tuple[str, str] | None = None) -> DataFrame:
    """Every anchor of every page: (key, url, anchor_no, href, classes array<string>).

    ``container`` (element, class) keeps the anchors inside the first such element of a page; they are
    numbered within it.
    """
    body = F.regexp_replace(F.col(html), NON_MARKUP_RE, "")
    if container is None:
        tags = F.regexp_extract_all(body, F.lit(ANCHOR_RE), 0)
    else:
        some = rf"(?is)<a{_WS}[^>]*>|</?{container[0]}\b[^>]*>"
        pages = pages.withColumn("_tags", F.regexp_extract_all(body, F.lit(some), 0))
        tags = F.filter(inside_first(F.col("_tags"), *container), lambda t: t.rlike(rf"(?is)^<a{_WS}"))
    a = pages.select(key, url, F.posexplode(tags).alias("anchor_no", "tag"))
    return a.select(key, url, "anchor_no", _attr(F.col("tag"), HREF_RE).alias("href"),
                    _classes(F.col("tag")).alias("classes"))


def file_name_of(href) -> Column:
    """Last path segment of a link."""
    h = F.col(href) if isinstance(href, str) else href
    return F.element_at(F.split(h, "/"), -1)


def visible_links(pages: DataFrame, css_class: str | None = None, prefix: str | None = None,
                  key: str = "page_id") -> DataFrame:
    """Anchors with a class (e.g. ``btn-success``) and/or an href prefix, with file names."""
    a = anchors(pages, key).where(F.col("href").isNotNull())
    if css_class is not None:
        a = a.where(F.array_contains("classes", css_class))
    if prefix is not None:
        a = a.where(F.col("href").startswith(prefix))
    return a.withColumn("file_name", file_name_of("href"))


def resolve(href: Column, base: Column) -> Column:
    """Absolute URL of a link, without its fragment: absolute as is, '//x' with the base's scheme,
    '/x' against the origin, '?x' and '#x' against the page, else the base's folder; '.' and '..'
    segments are folded."""
    link = F.regexp_replace(href, r"#.*$", "")
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^?#]*/)", 1)
    full = (F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), link))
            .when(link.startswith("/"), F.concat(origin, link))
            .when(link == "", F.regexp_replace(base, r"#.*$", ""))
            .when(link.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), link))
            .otherwise(F.concat(folder, link)))
    return F.when(full.rlike(r"^[^?]*/\.{1,2}([/?]|$)"), _fold_dots(full)).otherwise(full)


def _fold_dots(url: Column) -> Column:
    """``url`` with the '.' and '..' segments of its path folded."""
    head = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(url, r"(\?.*)$", 1)
    steps = F.split(F.regexp_replace(path, r"/(\.{1,2})$", "/$1/"), "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: (
        F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s)))))
    return F.concat(head, F.array_join(kept, "/"), query)


def follow_links(pages: DataFrame, start: DataFrame | None = None, item_class: str = "btn-success",
                 download_prefix: str = "https://", key: str = "page_id",
                 container: tuple[str, str] | None = None) -> DataFrame:
    """Listing page -> linked pages -> anchors of a class -> first download link.

    ``container``: only links inside the first such element of a listing page are followed. Returns (start_id, item_id, target_id, download_url, file_name).
    """
    start = pages if start is None else start
    # a request carries no fragment, so a page is known by its address without one
    pg = pages.select(F.col(key).alias("_pid"), F.regexp_replace("url", r"#.*$", "").alias("_purl"))

    def hop(src: DataFrame, src_key: str, css: str | None, within=None) -> DataFrame:
        a = anchors(src.select(F.col(src_key).alias(key), "url", "html"), key, container=within) \
            .where(F.col("href").isNotNull())
        if css is not None:
            a = a.where(F.array_contains("classes", css))
        links = a.select(F.col(key).alias("_src"), resolve(F.col("href"), F.col("url")).alias("_dst")).distinct()
        return links.join(pg, links["_dst"] == pg["_purl"]).select("_src", "_pid")

    h1 = hop(start, key, None, container).select(F.col("_src").alias("start_id"), F.col("_pid").alias("item_id"))
    items = pages.join(h1.select(F.col("item_id").alias(key)).distinct(), key, "left_semi")
    h2 = hop(items, key, item_class).select(F.col("_src").alias("item_id"), F.col("_pid").alias("target_id"))
    targets = pages.join(h2.select(F.col("target_id").alias(key)).distinct(), key, "left_semi")
    dl = (anchors(targets, key).where(F.col("href").startswith(download_prefix))
          .groupBy(key).agg(F.min_by("href", "anchor_no").alias("download_url"))
          .select(F.col(key).alias("target_id"), "download_url"))
    return (h1.join(h2, "item_id").join(dl, "target_id")
            .select("start_id", "item_id", "target_id", "download_url",
                    file_name_of("download_url").alias("file_name")))
