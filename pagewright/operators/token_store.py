"""The token table of a corpus, stored once and read by titles, links, metadata and text (H1-H8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as S

from pagewright.functions import html as H
from pagewright.functions.sql import fn as F
from pagewright.functions.text import decode_entities, trim_white
from pagewright.operators.pages import BOILERPLATE_TAGS, metadata_columns, metadata_fields, resolved_links, tokens
from pagewright.operators.rows import explode_array
from pagewright.session import read_folder, shared_folder, write_bucketed

# Elements without content, which no end tag closes.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
PAGE = "page"


def _open_count(events, by: list[str]):
    """Elements open after each of a page's tokens, from +1, -1 and 0: the running sum, never below zero.

    An end tag without its start counts for nothing: the sum is lifted by its least value so far.
    """
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return S.sum(events).over(w), w


def with_depths(rows: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Tokens with ``level``, ``close`` and ``hidden``, by bracket matching on running sums inside each page.

    ``level`` of a start tag counts the open elements of its name, itself included, and of an end tag those that it ends, 0 if it ends
    none. ``close`` is the place of the end tag that closes a start tag; NULL for void, self-closed and unclosed
    elements and for other tokens. ``hidden`` counts the boilerplate elements open at the token. A page's tokens
    are one group, which the cap on bodies bounds.
    """
    kind, tag = S.col("kind"), S.col("tag")
    step = S.when((kind == "start") & ~tag.isin(*VOID_TAGS), 1).when((kind == "end") & ~tag.isin(*VOID_TAGS), -1).otherwise(0)
    own = [page_id, "tag"]
    total, inside = _open_count(S.col("_step"), own)
    rows = rows.withColumn("_step", step).withColumn("_total", total)
    rows = rows.withColumn("_floor", S.least(S.min("_total").over(inside), S.lit(0)))
    # An end tag that takes the sum to a new least one had nothing to end.
    stray = (S.col("_step") < 0) & (S.col("_floor") < S.coalesce(S.lag("_floor").over(Window.partitionBy(*own).orderBy("pos")), S.lit(0)))
    open_ = S.col("_total") - S.col("_floor")
    level = S.when(S.col("_step") > 0, open_).when((S.col("_step") < 0) & ~stray, open_ + 1).otherwise(0)
    rows = rows.withColumn("level", level.cast("int"))
    # Of one name and level, starts and ends take turns.
    following = Window.partitionBy(*own, "level").orderBy("pos")
    close = S.when((S.col("_step") > 0) & (S.lead("_step").over(following) < 0), S.lead("pos").over(following))
    nested = [t for t in BOILERPLATE_TAGS if t not in H.RAW_TEXT]
    # Boilerplate elements count together, self-closed ones as open, whatever their names.
    hides = S.when(kind.isin("start", "selfclosing") & tag.isin(*nested), 1).when((kind == "end") & tag.isin(*nested), -1).otherwise(0)
    hidden, page = _open_count(S.col("_hides"), [page_id])
    rows = rows.withColumn("close", close).withColumn("_hides", hides).withColumn("_sum", hidden)
    rows = rows.withColumn("hidden", (S.col("_sum") - S.least(S.min("_sum").over(page), S.lit(0))).cast("int"))
    return rows.drop("_step", "_total", "_floor", "_hides", "_sum")


class TokenStore:
    """A stored token table: (page_id, url, pos, kind, tag, attrs, text, level, close, hidden), dealt out by page.

    Each page also has a row of kind ``page`` at place -1, so pages without tokens are known. All readers work page by
    page where the rows lie: none parses HTML again, and none shuffles.
    """

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def make(cls, pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", buckets: int | None = None) -> TokenStore:
        """Parse every page once and store its tokens; an empty or NULL body has none. Page ids are unique."""
        spark: SparkSession = pages.sparkSession
        own = pages.select(S.col(page_id).alias("page_id"), S.col(url).alias("url"), S.coalesce(S.col(html), S.lit("")).alias("html"))
        parsed = tokens(own.withColumn("page_id", S.struct("page_id", "url"))).select("page_id.*", "pos", "kind", "tag", "attrs", "text")
        none = {c: S.lit(None).cast(parsed.schema[c].dataType) for c in ("tag", "attrs", "text")}
        marks = own.select("page_id", "url", S.lit(-1).alias("pos"), S.lit(PAGE).alias("kind")).withColumns(none)
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        return cls(write_bucketed(with_depths(parsed.unionByName(marks)), ["page_id"], path or shared_folder(spark), n))

    def _per_page(self, rows, wanted, *columns: str) -> DataFrame:
        """(page_id, url, rows): for every page its wanted tokens in order, as structs of ``columns``."""
        some = self.table.filter(wanted | (S.col("kind") == PAGE))
        kept = S.when(S.col("kind") != PAGE, S.struct("pos", *columns))
        return some.groupBy("page_id").agg(S.first("url").alias("url"), S.array_sort(S.collect_list(kept)).alias(rows))

    def titles(self) -> DataFrame:
        """H2: (page_id, title) in the crawl reading."""
        title = (S.col("kind") == "raw") & (S.col("tag") == "title") & (S.col("text") != "")
        first = trim_white(F.get(F.col("_t"), 0)["text"])
        return self._per_page("_t", title, "text").select("page_id", F.coalesce(first, "").alias("title").col)

    def links(self) -> DataFrame:
        """H3: (page_id, pos, link)."""
        anchors = self._per_page("_a", (S.col("tag") == "a") & S.col("kind").isin("start", "selfclosing"), "attrs")
        values = F.flatten(F.transform(F.col("_a"), lambda a: F.transform(F.filter(a["attrs"], lambda x: x["name"] == "href"), lambda x: trim_white(x["value"]))))
        hrefs = F.filter(values, lambda h: (h != "") & ~h.rlike("^(?:#|javascript:|mailto:|tel:)"))
        return explode_array(anchors.select("page_id", "url", hrefs.alias("_hrefs").col), ["page_id"], resolved_links(F.col("url"), F.col("_hrefs")).col, "pos", "link")

    def metadata(self, dialect: str = "fast") -> DataFrame:
        """H5-H7: one row per page."""
        heads = self._per_page("_h", S.col("tag").isin("title", "meta", "html") & S.col("kind").isin("start", "selfclosing", "raw"), "tag", "attrs", "text")
        return metadata_columns(heads.select("page_id", metadata_fields(F.col("_h")).alias("m").col), "page_id", (), dialect)

    def text(self) -> DataFrame:
        """H8: (page_id, text): the text that no boilerplate element holds."""
        shown = (S.col("kind") == "text") | ((S.col("kind") == "raw") & S.col("tag").isin("textarea", "xmp"))
        words = self._per_page("_w", shown & (S.col("hidden") == 0), "tag", "text")
        # Raw text of xmp elements is stored as it stands.
        said = F.array_join(F.transform(F.col("_w"), lambda w: F.when(w["tag"] == "xmp", decode_entities(w["text"])).otherwise(w["text"])), " ")
        return words.select("page_id", trim_white(F.regexp_replace(said, "[ \\t\\n\\f\\r]+", " ")).alias("text").col)

    def elements(self, *names: str) -> DataFrame:
        """(page_id, tag, open, close, level): the closed elements of some names as intervals of places."""
        closed = self.table.filter(S.col("tag").isin(*names) & S.col("close").isNotNull())
        return closed.select("page_id", "tag", S.col("pos").alias("open"), "close", "level")
