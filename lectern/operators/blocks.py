"""Block-level operators: classification of page blocks, running headers, column order, document assembly.

A block row has doc_id, page, ord, text, font, size, flags, x0, y0, x1. Everything is a column
expression or a window within a page; documents are the widest groups that are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

# Tags, patterns and monospace font names.
NOISE = ["PAGE-NUMBER", "RUNNING-HEADER", "FIGURE-CAPTION", "FOOTNOTE"]
PAGE_NUMBER = r"^\d{1,4}$|(?i)^(page|p\.?)\s*\d+$"
CAPTION = r"(?i)^(figure|fig\.?|exhibit|diagram|chart)\s+\d+"
FOOTNOTE = r"^\s*[\d*†‡§]\s*"
SHORT_FOOTNOTE = r"^\s*\d+\s+"
MONOSPACE = "(?i)courier|mono|code|consolas|monaco"
CODE = [
    r"^\s*(def |function |class |import |public |private |protected )",
    r"^\s*(if |for |while |switch |case |return )",
    r"^\s*(//|#|/\*|\*)",
    r"[{}();,]\s*$",
    r"^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*",
]
ALGORITHM = r"(?i)^(algorithm\s+\d+|procedure\s+\w+|function\s+\w+\s*\(|input:|output:|\d+:\s+)"


def like(x: Column, pattern: str) -> Column:
    return F.rlike(x, F.lit(pattern))


def is_page_number(text: Column, page: Column | None = None) -> Column:
    return _is_page_number(T.strip(text), page)


def _is_page_number(bare: Column, page: Column | None) -> Column:
    plain = like(bare, PAGE_NUMBER)
    return plain if page is None else plain | (bare == page.cast("string"))


def is_caption(text: Column) -> Column:
    return like(text, CAPTION)


def is_footnote(text: Column) -> Column:
    return like(text, FOOTNOTE) | ((F.length(text) < 100) & like(text, SHORT_FOOTNOTE))


def is_code(text: Column, font: Column) -> Column:
    found = like(F.coalesce(font, F.lit("")), MONOSPACE)
    for pattern in CODE:
        found = found | like(text, pattern)
    return found


def is_algorithm(text: Column) -> Column:
    return like(text, ALGORITHM)


def is_table(text: Column) -> Column:
    lines = F.split(text, "\n")
    wide = F.exists(lines, lambda s: like(s, r"\t|  ") & (F.size(F.split(T.strip(s), r"\t|  +")) >= 3))
    return (F.size(lines) >= 2) & wide


def classify(text: Column, page: Column, font: Column, size: Column, flags: Column, running: Column) -> Column:
    """The tag of a block; the first rule that holds decides. ``running``: it matches a running header."""
    return classify_bare(T.strip(text), page, font, size, flags, running)


def tagged(blocks: DataFrame) -> DataFrame:
    """``blocks`` (with running) with ``bare``, the stripped text, and ``tag``.

    The text is stripped once: each column stands for itself, as what is used many times is not put back into its uses.
    """
    rows = blocks.withColumn("bare", T.strip(F.col("text")))
    return rows.withColumn("tag", classify_bare(*map(F.col, ("bare", "page", "font", "size", "flags", "running"))))


def keeps_bare(tag: Column, bare: Column) -> Column:
    """``keeps`` for a text that is stripped already."""
    above = {"CODE": -1, "ALGORITHM": -1, "TABLE": 10, "HEADER": 0, "SUBHEADER": 0, "BODY": 0}
    least = F.try_element_at(F.create_map(*[F.lit(x) for kv in above.items() for x in kv]), tag)
    return F.coalesce(F.length(bare) > least, F.lit(False))


def classify_bare(bare: Column, page: Column, font: Column, size: Column, flags: Column, running: Column) -> Column:
    """``classify`` for a text that is stripped already."""
    bold = flags.bitwiseAND(16) != 0
    return (
        F.when(bare == "", "BODY")
        .when(_is_page_number(bare, page), "PAGE-NUMBER")
        .when(running, "RUNNING-HEADER")
        .when(is_caption(bare), "FIGURE-CAPTION")
        .when(is_footnote(bare), "FOOTNOTE")
        .when(is_code(bare, font), "CODE")
        .when(is_algorithm(bare), "ALGORITHM")
        .when(is_table(bare), "TABLE")
        .when((size > 16) & bold, "HEADER")
        .when((size > 13) & bold, "SUBHEADER")
        .otherwise("BODY")
    )


def keeps(tag: Column, text: Column) -> Column:
    """Whether a block stays: never noise, always code and algorithms, tables above 10 characters, the rest unless blank.

    The tag stands here once, so that a filter pushed below its projection evaluates it once.
    """
    return keeps_bare(tag, T.strip(text))


def cleaned(tag: Column, text: Column, normalize: bool = True) -> Column:
    return F.when(tag.isin("CODE", "ALGORITHM"), text).when(tag == "TABLE", T.table_to_prose(text)).otherwise(T.clean_text(text, normalize))


def from_spans(blocks: DataFrame) -> DataFrame:
    """Rows with ``lines`` (array of spans with text, font, size, flags, origin): spans joined by a space, lines by a
    line feed; font, size and flags are the first span's. Blocks without lines are left out."""
    first = F.try_element_at(F.try_element_at("lines", F.lit(1))["spans"], F.lit(1))
    text = F.array_join(F.transform("lines", lambda line: F.array_join(F.transform(line["spans"], lambda s: s["text"]), " ")), "\n")
    return blocks.filter(F.size("lines") > 0).withColumns(
        {
            "text": text,
            "font": F.coalesce(first["font"], F.lit("")),
            "size": F.coalesce(first["size"], F.lit(12.0)),
            "flags": F.coalesce(first["flags"], F.lit(0)),
            "x": first["origin"]["x"],
            "y": first["origin"]["y"],
        }
    )


def running_headers(spans: DataFrame, pages: int = 10, least: int = 3, longest: int = 50) -> DataFrame:
    """(doc_id, x, y, text): places at which text occurs three times or more on the first pages, with its first text there."""
    near = spans.filter((F.col("page") <= pages) & (F.length(T.strip(F.col("text"))) > 0) & (F.length(T.strip(F.col("text"))) < longest))
    place = near.groupBy("doc_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    found = place.agg(F.min_by(T.strip(F.col("text")), F.struct("page", "ord")).alias("text"), F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") >= least).select("doc_id", "x", "y", "text")


def mark_running(blocks: DataFrame, headers: DataFrame, near: float = 20) -> DataFrame:
    """``blocks`` with ``running``: equal text as a header of its document, within 20 points of its place."""
    known = headers.select(F.col("doc_id").alias("h_doc"), F.col("x").alias("h_x"), F.col("y").alias("h_y"), T.comparable(F.col("text")).alias("h_text"))
    own = blocks.withColumn("own_text", T.comparable(F.col("text")))
    met = (F.col("doc_id") == F.col("h_doc")) & (F.col("own_text") == F.col("h_text")) & (F.abs(F.col("x0") - F.col("h_x")) < near) & (F.abs(F.col("y0") - F.col("h_y")) < near)
    hit = own.join(known, met, "left_semi").select("doc_id", "page", "ord").withColumn("running", F.lit(True))
    return blocks.join(hit, ["doc_id", "page", "ord"], "left").withColumn("running", F.coalesce("running", F.lit(False)))


def multi_column(blocks: DataFrame, share: float = 0.4, least: int = 3) -> DataFrame:
    """(doc_id, page, multi): whether a page's blocks start across more than 40 % of its width."""
    return blocks.groupBy("doc_id", "page").agg(((F.count(F.lit(1)) >= least) & (F.max("x0") - F.min("x0") > share * F.max("page_width"))).alias("multi"))


def _side() -> Column:
    return F.when((F.col("x0") + F.col("x1")) / 2 < F.col("page_width") / 2, 0).otherwise(1)


def column_order(blocks: DataFrame, column_major: bool = False) -> DataFrame:
    """``blocks`` with ``position`` on the page: left and right columns by height, taken in turn (or one after the other)."""
    rank = F.row_number().over(W.partitionBy("doc_id", "page", "side").orderBy("y0", "ord"))
    order = ["side", "rank"] if column_major else ["rank", "side"]
    out = blocks.withColumn("side", _side()).withColumn("rank", rank)
    return out.withColumn("position", F.row_number().over(W.partitionBy("doc_id", "page").orderBy(*order))).drop("side", "rank")


def reading_order(blocks: DataFrame, share: float = 0.4, least: int = 3) -> DataFrame:
    """``blocks`` with ``place``, a struct by which the blocks of a page are read.

    On a page of several columns (see ``multi_column``) left and right blocks are taken in turn, each by height; on others, and
    where positions are not known, blocks keep their order. The rows are dealt by document once; the windows over pages and
    columns, and what is gathered by document after them, need no other shuffle.
    """
    if not {"x0", "x1", "y0", "page_width"} <= set(blocks.columns):
        return blocks.withColumn("place", F.struct(F.col("ord").alias("first"), F.lit(0).alias("second")))
    page = W.partitionBy("doc_id", "page")
    multi = (F.count(F.lit(1)).over(page) >= least) & (F.max("x0").over(page) - F.min("x0").over(page) > share * F.max("page_width").over(page))
    dealt = blocks.repartition("doc_id").withColumns({"multi_": F.coalesce(multi, F.lit(False)), "side_": _side()})
    rank = F.row_number().over(W.partitionBy("doc_id", "page", "side_").orderBy("y0", "ord"))
    place = F.struct(F.when(F.col("multi_"), rank).otherwise(F.col("ord")).alias("first"), F.when(F.col("multi_"), F.col("side_")).otherwise(0).alias("second"))
    return dealt.withColumn("place", place).drop("multi_", "side_")


def assemble(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): the lines "TAG: content" of each document in order of page and place (see ``reading_order``), or ord without places."""
    line = F.concat_ws(": ", "tag", "content")
    own = ["place", "ord"] if "place" in blocks.columns else ["ord"]
    rows = F.array_sort(F.collect_list(F.struct("page", *own, line.alias("line"))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def ingest(blocks: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """The clean document of each doc_id: headers marked, blocks classified, put in reading order, filtered, cleaned, joined and tidied."""
    headers = running_headers(blocks if spans is None else spans)
    placed = reading_order(tagged(mark_running(blocks, headers)))  # of all blocks, as noise tells columns too
    kept = placed.filter(keeps_bare(F.col("tag"), F.col("bare"))).withColumn("content", cleaned(F.col("tag"), F.col("bare")))
    return assemble(kept).withColumn("text", T.tidy_document(F.col("text")))
