"""Boxes and line blocks of recognised pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyr.functions.text import trim_all

#: Height in pixels of the line that a block without a box gets; confidences of 100 that stand for none or zero (fixed values).
LINE_HEIGHT, LINE_CONFIDENCE, PAGE_CONFIDENCE = 30, 75, 80
#: Confidence of a block that comes without one (fixed value).
BLOCK_CONFIDENCE = 0.95


def _rounded(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def standard_box(box_2d: Column, bbox: Column, index: Column, width: Column, height: Column) -> Column:
    """A block's box in whole pixels, [x1, y1, x2, y2], from what a model gave; numbers decide what they mean.

    Four numbers of ``box_2d`` are y, x, y, x of 0 to 1000, in either order, and are clamped to the page. Four of
    ``bbox`` are parts of the page where the last two are 1 at most, thousandths where all are 1000 at most and a side of
    the page is longer, and else pixels. Anything else is a line of 30 pixels at the block's index.
    """
    def scaled(unit: float) -> Column:
        return F.array(*(_rounded(bbox[i] / unit * side) for i, side in enumerate((width, height, width, height))))

    def side(i: int, j: int, length: Column, pick) -> Column:
        return F.greatest(F.lit(0), F.least(length.cast("long"), _rounded(pick(box_2d[i], box_2d[j]) / 1000 * length)))

    grounded = F.array(side(1, 3, width, F.least), side(0, 2, height, F.least), side(1, 3, width, F.greatest), side(0, 2, height, F.greatest))
    line = F.array(F.lit(0).cast("long"), (index * LINE_HEIGHT).cast("long"), width.cast("long"), ((index + 1) * LINE_HEIGHT).cast("long"))
    large = (F.array_max(bbox) <= 1000) & ((width > 1000) | (height > 1000))
    given = F.when((bbox[2] <= 1) & (bbox[3] <= 1), scaled(1)).when(large, scaled(1000)).otherwise(F.array(*(_rounded(bbox[i]) for i in range(4))))
    return F.when(F.size(box_2d) == 4, grounded).when(F.size(bbox) == 4, given).otherwise(line)


def standard_blocks(blocks: DataFrame) -> DataFrame:
    """(version_id, page_number, block_index, block_text, box_2d, bbox, confidence, width, height) -> blocks of pages.

    Blank texts make no block; the others are counted from 0 in their order, which places those without a box. NUL
    characters go. No confidence counts as 0.95; the others are clamped to 0.1 to 1.
    """
    rows = blocks.withColumn("block_text", trim_all(F.col("block_text"))).where("block_text <> ''")
    rows = rows.withColumn("block_order", F.row_number().over(Window.partitionBy("version_id", "page_number").orderBy("block_index")) - 1)
    box = standard_box(*(F.col(c) for c in ("box_2d", "bbox", "block_order", "width", "height")))
    conf = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(BLOCK_CONFIDENCE))))
    rows = rows.select("version_id", "page_number", "block_order", F.regexp_replace("block_text", "\\x00", "").alias("block_text"), box.alias("box"), conf.alias("confidence"))
    return rows.select("version_id", "page_number", "block_order", "block_text", *(F.col("box")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), "confidence")


def line_blocks(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of pages from recognised lines, or from the page's text where it has no line with text.

    lines: version_id, page_number, line_index, text, confidence (of 100). pages: version_id, page_number, raw_text,
    confidence. Blank lines make no block; a line without a confidence, or with 0, counts 75, a page 80; all are
    clamped to 0.1 to 1. block_order counts from 0; reading_order, as the platform keeps it, from 1 for recognised
    lines and from 0 for lines of the page's text. Pages meet their lines by one aggregate; no page is looked up alone.
    """
    share = lambda c, none: F.least(F.greatest(F.coalesce(F.nullif(c, F.lit(0)), F.lit(none)) / 100, F.lit(0.1)), F.lit(1.0))
    own = lines.withColumn("text", trim_all(F.col("text"))).where("text <> ''")
    line = F.struct(F.col("line_index"), F.col("text"), share(F.col("confidence").cast("double"), LINE_CONFIDENCE).alias("share"))
    found = own.groupBy("version_id", "page_number").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rows = pages.join(found, ["version_id", "page_number"], "full")
    texts = F.filter(F.transform(F.split(trim_all(F.col("raw_text")), "\n"), trim_all), lambda t: t != "")
    fallback = F.transform(texts, lambda t: F.struct(t.alias("text"), share(F.col("confidence").cast("double"), PAGE_CONFIDENCE).alias("share"), F.lit(0).alias("first")))
    recognised = F.transform("lines", lambda x: F.struct(x["text"].alias("text"), x["share"].alias("share"), F.lit(1).alias("first")))
    rows = rows.select("version_id", "page_number", F.posexplode(F.coalesce(recognised, fallback)).alias("block_order", "b"))
    return rows.select("version_id", "page_number", "block_order", (F.col("block_order") + F.col("b.first")).alias("reading_order"), F.col("b.text").alias("block_text"), F.col("b.share").alias("confidence"))
