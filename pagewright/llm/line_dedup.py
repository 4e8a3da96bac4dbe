"""Line deduplication with range-partitioned hashes and per-document keep bitmaps. Native columns only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as S

from pagewright.functions.sql import Expr, fn as F
from pagewright.llm.common import SPACE, ascii_lower, let
from pagewright.session import write_through

MIN_CHARS = 1
MIN_DOCS = 10


def text_lines(text) -> Expr:
    """The text split at line feeds; NULL and empty text are one empty line."""
    return F.split(F.coalesce(text, ""), "\n")


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, body, pos, h1, h2): 96 hash bits of the key of every line whose key has ``min_chars`` code points.

    A line's key is the line without white space at its ends and with A-Z lower-cased. ``body`` tells rows
    apart that share an id but not their text.
    """
    text = F.col("_text")
    own = docs.select(S.col(id_col).alias("doc"), S.col(text_col).alias("_text"))
    lines = own.select("doc", F.hash(text).alias("body").col, S.posexplode(text_lines(text).col).alias("pos", "line"))
    bare = F.btrim(F.col("line"), SPACE)
    lines = lines.filter((F.char_length(bare) >= min_chars).col).withColumn("key", ascii_lower(bare).col)
    return lines.select("doc", "body", "pos", S.xxhash64("key").alias("h1"), S.hash("key").alias("h2"))


def first_lines(rows: DataFrame) -> DataFrame:
    """The first occurrence of every key in every document, streamed from sorted hash ranges.

    The ranges are cut on (hash, document), so a key that a third of all documents hold fills several
    ranges; the window needs no further exchange or sort.
    """
    by = ["h1", "h2", "doc", "body"]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by, "pos")
    return ranged.withColumn("_n", S.row_number().over(Window.partitionBy(*by).orderBy("pos"))).filter("_n = 1").drop("_n")


def line_drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, body, dropped): which lines go because ``min_docs`` documents or more hold their key.

    ``dropped`` is a run-length bitmap, sorted runs (first, last) of line numbers from 0; every other line is
    kept, and a document without a row here keeps all. Rows of one id and text count as one document, a NULL
    id is an id like any other, rows with one id and different texts are different documents. NULL and empty
    text have one empty line, which no key covers. An empty table gives no rows; further columns of ``docs``
    are not read.
    """
    rows = write_through(line_rows(docs, id_col, text_col, min_chars))
    frequent = first_lines(rows).groupBy("h1", "h2").agg(S.count(S.lit(1)).alias("_docs")).filter(S.col("_docs") >= min_docs).drop("_docs")
    # Read back as a table, both sides of the join are plain exchanges, which adaptive execution can split.
    hit = rows.join(write_through(frequent), ["h1", "h2"]).groupBy("doc", "body").agg(S.sort_array(S.collect_set("pos")).alias("p"))
    p = F.col("p")
    first = F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1) + 1))
    last = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (x != F.get(p, i + 1) - 1))
    return hit.select("doc", "body", F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last"))).alias("dropped").col)


def kept_text(text: Expr, dropped: Expr) -> Expr:
    """The lines that a bitmap keeps, joined by line feeds; no bitmap keeps the text as it is."""

    def join(lines: Expr) -> Expr:
        gone = F.flatten(F.transform(dropped, lambda r: F.sequence(r["first"], r["last"])))
        kept = F.array_except(F.sequence(0, F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: lines[i]), "\n")

    return F.when(dropped.isNull(), text).otherwise(let(text_lines(text), join))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, dropped): every row of ``docs`` as a struct, its text, and its bitmap or NULL; the text moves once, by document."""
    text = S.col(f"`{text_col}`")
    rows = docs.select(S.struct("*").alias("row"), S.col(f"`{id_col}`").alias("id"), S.hash(text).alias("own"), text.alias("text"))
    same = rows["id"].eqNullSafe(bitmaps["doc"]) & (rows["own"] == bitmaps["body"])
    return rows.join(bitmaps, same, "left").select("row", "text", "dropped")


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """``docs`` with every frequent line taken out of its text; NULL text stays NULL, no row is dropped."""
    marked = with_bitmaps(docs, line_drop_bitmaps(docs, id_col, text_col, **rule), id_col, text_col)
    text = kept_text(F.col("text"), F.col("dropped")).col
    return marked.select(*[text.alias(c) if c == text_col else S.col(f"row.`{c}`").alias(c) for c in docs.columns])
