"""Page-corpus operators on HTML tables: titles, links, metadata, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as S

from pagewright.functions import html as H
from pagewright.functions.sql import Expr as Column, fn as F
from pagewright.functions.text import decode_entities, let, percent_decode, trim_white
from pagewright.functions.urls import (
    base_parts,
    decoded_host,
    is_crawl_asset,
    is_web_scheme,
    passes_patterns,
    resolve_url,
    resolved_parts,
    url_parts,
    written_url,
)
from pagewright.operators.rows import explode_array

# Subtrees that are dropped as boilerplate.
BOILERPLATE_TAGS = ("script", "style", "nav", "footer", "aside", "noscript", "svg")
FORMATS = ("markdown", "html", "text")


def tokens(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """H1: token table (page_id, pos, kind, tag, attrs, text).

    Raw elements come as one ``raw`` token. The array is built inside the page's row, so exploding it
    moves nothing between executors; hash-partition ``pages`` by the id first if windows follow.
    """
    exploded = explode_array(pages, [page_id], H.token_array(F.col(html)).col, "pos", "token")
    t = F.col("token")
    name = H.tag_name(t)
    kind = (
        F.when(t.startswith("<!--"), "comment")
        .when(t.rlike("^<[!?]|^</[^A-Za-z]"), "other")
        .when(name == "", F.when(t.rlike("(?s)^</?[A-Za-z]"), "cut").otherwise("text"))
        .when(t.startswith("</"), "end")
        .when(name.isin(*H.RAW_TEXT), "raw")
        .when(t.rlike(r"/>\z"), "selfclosing")
        .otherwise("start")
    )
    named = exploded.select(page_id, "pos", "token", kind.alias("kind").col, F.nullif(name, "").alias("tag").col)
    kind, tag, inner = F.col("kind"), F.col("tag"), H.raw_inner(t)
    escapable = (kind == "raw") & tag.isin(*H.ESCAPABLE_RAW)
    text = F.when((kind == "text") | escapable, decode_entities(F.when(kind == "text", t).otherwise(inner))).when(kind == "raw", inner)
    attrs = F.when(kind.isin("start", "selfclosing", "raw"), H.attributes(t))
    return named.select(page_id, "pos", "kind", "tag", attrs.alias("attrs").col, text.alias("text").col)


def crawl_title(tags: Column) -> Column:
    """H2 over a tag array: text of the first non-empty title, trimmed; "" if there is none."""
    texts = F.filter(F.transform(F.filter(tags, lambda t: H.is_tag(t, "title")), H.raw_inner), lambda x: x != "")
    return F.coalesce(trim_white(decode_entities(F.get(texts, F.lit(0)))), F.lit(""))


def anchor_hrefs(tags: Column) -> Column:
    """Raw link targets of every anchor in document order: trimmed, in-page and non-web targets dropped."""
    per_anchor = F.transform(
        F.filter(tags, lambda t: H.is_tag(t, "a")),
        lambda t: F.transform(F.filter(H.attributes(t), lambda a: a["name"] == "href"), lambda a: trim_white(a["value"])),
    )
    return F.filter(F.flatten(per_anchor), lambda h: (h != "") & ~h.rlike("^(?:#|javascript:|mailto:|tel:)"))


def resolved_links(base: Column, hrefs: Column) -> Column:
    """H3: absolute links in first-seen order, without duplicates."""

    def resolve(p: Column) -> Column:
        links = F.transform(hrefs, lambda h: resolve_url(p, h))
        return F.when(p["ok"], F.array_distinct(F.filter(links, lambda l: l.isNotNull())))

    return let(base_parts(base), resolve)


def page_links(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """H3: (page_id, keep, pos, link). De-duplication stays inside the page's row, so there is no shuffle."""
    hrefs = anchor_hrefs(H.tag_array(F.col(html)))
    targets = pages.select(page_id, *{url: 0, **dict.fromkeys(keep)}, hrefs.alias("_hrefs").col)
    return explode_array(targets, [page_id, *keep], resolved_links(F.col(url), F.col("_hrefs")).col, "pos", "link")


def keep_link(link: Column, seed_host: Column, include: Column, exclude: Column) -> Column:
    """H4: web scheme, seed host, no asset, include and exclude patterns; in that order."""

    def test(p: Column) -> Column:
        return p["ok"] & _keep(link, p["scheme"], p["host"], p["path"], seed_host, include, exclude)

    return let(url_parts(link), test)


def _keep(link, scheme, host, path, seed_host, include, exclude) -> Column:
    return is_web_scheme(scheme) & (host == seed_host) & ~is_crawl_asset(path) & passes_patterns(link, include, exclude)


def followed_links(base: Column, hrefs: Column, seed_host: Column, include: Column, exclude: Column) -> Column:
    """H3 and H4 in one walk: the kept links of a page in first-seen order. Each target is parsed once."""

    def walk(b: Column) -> Column:
        parts = F.filter(F.transform(hrefs, lambda h: resolved_parts(b, h)), lambda w: w.isNotNull())

        def described(w: Column) -> Column:
            return F.struct(
                written_url(w).alias("link"),
                w["scheme"].alias("scheme"),
                decoded_host(w["raw_host"]).alias("host"),
                percent_decode(w["path"]).alias("path"),
            )

        kept = F.filter(
            F.transform(parts, described),
            lambda d: _keep(d["link"], d["scheme"], d["host"], d["path"], seed_host, include, exclude),
        )
        return F.when(b["ok"], F.array_distinct(F.transform(kept, lambda d: d["link"])))

    return let(base_parts(base), walk)


def metadata_fields(parsed: Column) -> Column:
    """H5: seven nullable fields from the title, meta and html tags of a page in order, as structs of (tag, attrs, text); the
    first match decides and an empty value is NULL (but ``lang=""`` stays)."""

    def value(found: Column, name: str) -> Column:
        return F.get(F.filter(found["attrs"], lambda a: a["name"] == name), 0)["value"]

    def fields(parsed: Column) -> Column:
        def first(tag: str) -> Column:
            return F.get(F.filter(parsed, lambda t: t["tag"] == tag), 0)

        def meta(key: str, wanted: str) -> Column:
            same = F.filter(parsed, lambda t: (t["tag"] == "meta") & F.coalesce(value(t, key) == wanted, False))
            return let(F.get(same, 0), lambda m: F.nullif(value(m, "content"), ""))

        return F.struct(
            F.nullif(trim_white(first("title")["text"]), "").alias("title"),
            meta("name", "description").alias("description"),
            value(first("html"), "lang").alias("language"),
            meta("property", "og:title").alias("og_title"),
            meta("property", "og:description").alias("og_description"),
            meta("property", "og:image").alias("og_image"),
            meta("property", "og:url").alias("og_url"),
        )

    return let(parsed, fields)


def head_metadata(tags: Column) -> Column:
    """H5 over the title, meta and html tags of a tag array."""

    def parse(t: Column) -> Column:
        text = F.when(H.is_tag(t, "title"), decode_entities(H.raw_inner(t)))
        return F.struct(H.tag_name(t).alias("tag"), H.attributes(t).alias("attrs"), text.alias("text"))

    return metadata_fields(F.transform(tags, parse))


def page_metadata(pages: DataFrame, page_id: str = "page_id", html: str = "html", dialect: str = "fast", keep: tuple[str, ...] = ()) -> DataFrame:
    """H5-H7: one row per page, with the columns ``keep`` of the page.

    ``fast`` falls back to the og fields for title and description; ``browser`` gives "" for what is missing.
    """
    # Only the tags that can carry metadata are kept before anything is parsed.
    wanted = F.filter(H.tag_array(F.col(html)), lambda t: t.rlike(r"(?i)^<(?:title|meta|html)[\s/>]"))
    m = pages.select(page_id, *keep, wanted.alias("_tags").col).select(page_id, *keep, head_metadata(F.col("_tags")).alias("m").col)
    return metadata_columns(m, page_id, keep, dialect)


def metadata_columns(m: DataFrame, page_id: str, keep: tuple[str, ...], dialect: str) -> DataFrame:
    """H6, H7: the fields ``m`` of each page as columns."""
    if dialect == "browser":
        return m.select(page_id, *keep, *[S.coalesce(f"m.{c}", S.lit("")).alias(c) for c in ("title", "description", "language")])
    return m.select(
        page_id,
        *keep,
        S.coalesce("m.title", "m.og_title").alias("title"),
        S.coalesce("m.description", "m.og_description").alias("description"),
        *[f"m.{c}" for c in ("language", "og_title", "og_description", "og_image", "og_url")],
    )


def page_titles(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """H2: (page_id, title) in the crawl reading."""
    titles = F.filter(H.tag_array(F.col(html)), lambda t: H.is_tag(t, "title"))
    return pages.select(page_id, crawl_title(titles).alias("title").col)


def visible_words(html: Column) -> Column:
    """H8 over one page: text outside the boilerplate subtrees, white space collapsed.

    The depth of open boilerplate elements is folded over the token array. An end tag without its start
    never takes it below zero.
    """
    nested = "|".join(x for x in BOILERPLATE_TAGS if x not in H.RAW_TEXT)
    starts, ends = rf"(?i)^<(?:{nested})[\s/>]", rf"(?i)^</(?:{nested})[\s/>]"
    # Only text and the tags that open or close boilerplate matter; other tags still separate words.
    shown_raw = "(?i)^<(?:textarea|xmp)[\\s/>]"
    kept = F.filter(
        H.token_array(html), lambda t: ~t.startswith("<") | t.rlike(starts) | t.rlike(ends) | (t == "<") | t.rlike(shown_raw)
    )
    kind = "struct<depth:int,out:array<string>,done:array<array<string>>>"
    none = F.array().cast("array<string>")
    empty = F.struct(F.lit(0).alias("depth"), none.alias("out"), F.array().cast("array<array<string>>").alias("done"))

    def state(depth, out, done) -> Column:
        return F.struct(depth.alias("depth"), out.alias("out"), done.alias("done")).cast(kind)

    def step(s: Column, t: Column) -> Column:
        # Full buffers move aside so that appending stays cheap on long pages.
        full = F.size(s["out"]) >= 255
        text = decode_entities(F.when(t.rlike(shown_raw), H.raw_inner(t)).otherwise(t))
        return (
            F.when(t.rlike(starts), state(s["depth"] + 1, s["out"], s["done"]))
            .when(t.rlike(ends), state(F.greatest(s["depth"] - 1, 0), s["out"], s["done"]))
            .when(s["depth"] > 0, s.cast(kind))
            .otherwise(
                state(
                    s["depth"],
                    F.when(full, F.array(text)).otherwise(F.array_append(s["out"], text)),
                    F.when(full, F.array_append(s["done"], s["out"])).otherwise(s["done"]),
                )
            )
        )

    words = F.aggregate(kept, empty.cast(kind), step, lambda s: F.array_join(F.flatten(F.array_append(s["done"], s["out"])), " "))
    return trim_white(F.regexp_replace(words, "[ \\t\\n\\f\\r]+", " "))


def page_text(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """H8: (page_id, text). Stays inside the page's row; no shuffle."""
    return pages.select(page_id, visible_words(F.col(html)).alias("text").col)


def output_columns(fmt: Column, html: Column, markdown: Column) -> Column:
    """``html`` gives the content only, any other format the Markdown only."""
    want_html = F.coalesce(fmt, F.lit("")) == "html"
    return F.struct(
        F.when(want_html, html).otherwise(F.lit("")).alias("content"),
        F.when(want_html, F.lit("")).otherwise(markdown).alias("markdown"),
    )


def is_valid_format(fmt: Column) -> Column:
    """H13."""
    return fmt.isin(*FORMATS)
