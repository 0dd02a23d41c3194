"""Reading order rebuilt from word boxes, and the choice among several texts of one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.binding import let
from parcelforge.functions.text import LINE_ENDS, count_of, stripped, word_sign_count

# Confidence floors, gaps that count as wide, and the least height tolerance.
PAGE_CONFIDENCE, TABLE_CONFIDENCE = 25, 20
PAGE_GAP, TABLE_GAP = 50, 40
LEAST_TOLERANCE = 10
LAYOUT_LEAST = 20

# Words that speak for a reading of a deed, and weights of its score.
KEYWORDS = ("SECTION", "PARCELLE", "COMMUNE", "ARTICLE", "PROPRIETAIRE", "REFERENCES CADASTRALES")
WEIGHTS = {"rows": 30, "pairs": 12, "keywords": 3, "surfaces": 2}


def sure_words(words: DataFrame, floor: int) -> DataFrame:
    return words.where((F.trim("text") != "") & (F.col("conf").cast("int") >= floor))


def _joined(ws: Column, gap: int) -> Column:
    """Text of words ordered from the left: four spaces after a gap wider than `gap`, else one; none while nothing stands left."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("right"))

    def step(acc: Column, w: Column) -> Column:
        sep = F.when(acc["right"] <= 0, "").when(w["lft"] - acc["right"] > gap, "    ").otherwise(" ")
        return F.struct(F.concat(acc["s"], sep, w["text"]).alias("s"), (w["lft"] + w["width"]).alias("right"))

    return F.aggregate(ws, start, step, lambda acc: acc["s"])


def layout_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, block_num, par_num, line_num, line): words of each recognised line from left to right, ties as read."""
    ws = F.array_sort(F.collect_list(F.struct("lft", "word_idx", "width", F.trim("text").alias("text"))))
    lines = sure_words(words, PAGE_CONFIDENCE).groupBy("doc_id", "page_no", "block_num", "par_num", "line_num").agg(ws.alias("ws"))
    return lines.select("doc_id", "page_no", "block_num", "par_num", "line_num", _joined(F.col("ws"), PAGE_GAP).alias("line"))


def table_rows(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, line): words of a table clustered into rows. In the order of their centres a word opens a row when
    it lies further than the tolerance from the row's first word; the tolerance is half the upper median height, at least 10.

    The fold runs over one page's words, a page being one image."""
    w = sure_words(words, TABLE_CONFIDENCE).select("doc_id", "page_no", F.struct((F.col("top") + F.floor(F.col("height") / 2)).cast("int").alias("cy"), "lft", "word_idx", "width", "height", F.trim("text").alias("text")).alias("w"))
    pages = w.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    heights = F.array_sort(F.transform("ws", lambda x: x["height"]))
    middle = F.element_at(heights, (F.floor(F.size("ws") / 2) + 1).cast("int"))
    pages = pages.withColumn("tol", F.greatest(F.floor(middle / 2).cast("int"), F.lit(LEAST_TOLERANCE)))
    start = F.struct(F.array().cast("array<int>").alias("rows"), F.lit(None).cast("int").alias("anchor"), F.lit(-1).alias("row"))

    def step(acc: Column, x: Column) -> Column:
        opens = acc["anchor"].isNull() | (F.abs(x["cy"] - acc["anchor"]) > F.col("tol"))
        row = F.when(opens, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(F.concat(acc["rows"], F.array(row)).alias("rows"), F.when(opens, x["cy"]).otherwise(acc["anchor"]).alias("anchor"), row.alias("row"))

    pages = pages.withColumn("rows", F.aggregate("ws", start, step, lambda acc: acc["rows"]))
    each = pages.select("doc_id", "page_no", F.explode(F.arrays_zip("ws", "rows")).alias("z"))
    cells = each.select("doc_id", "page_no", F.col("z.rows").alias("row_no"), F.struct(F.col("z.ws.lft").alias("lft"), F.col("z.ws.cy").alias("cy"), F.col("z.ws.word_idx").alias("word_idx"), F.col("z.ws.width").alias("width"), F.col("z.ws.text").alias("text")).alias("c"))
    rows = cells.groupBy("doc_id", "page_no", "row_no").agg(F.array_sort(F.collect_list("c")).alias("ws"))
    return rows.select("doc_id", "page_no", "row_no", _joined(F.col("ws"), TABLE_GAP).alias("line"))


def text_score(text: Column) -> Column:
    """struct(score, rows, pairs, alnum, filled_lines, size): the greatest is the best reading of a page."""

    def score(s: Column) -> Column:
        up = F.upper(s)
        keywords = sum((count_of(up, k) for k in KEYWORDS[1:]), count_of(up, KEYWORDS[0]))
        pairs = F.regexp_count(up, F.lit(r"\b[A-Z]{1,4}\s+[0-9]{1,4}[A-Z]?\b"))
        surfaces = F.regexp_count(up, F.lit(r"\b[0-9O]+\s*HA\b"))
        lines = F.split(up, LINE_ENDS)
        rows = F.size(F.filter(lines, lambda x: x.rlike(r"\b[0-9]{2,4}[A-Z]?\b") & x.rlike(r"\bHA\b")))
        filled = F.size(F.filter(lines, lambda x: stripped(x) != ""))
        total = rows * WEIGHTS["rows"] + pairs * WEIGHTS["pairs"] + keywords * WEIGHTS["keywords"] + surfaces * WEIGHTS["surfaces"]
        return F.struct(total.alias("score"), rows.alias("rows"), pairs.alias("pairs"), word_sign_count(s).alias("alnum"), filled.alias("filled_lines"), F.length(s).alias("size"))

    return let(text, score)


def best_text(candidates: DataFrame) -> DataFrame:
    """(doc_id, page_no, pos, text): the best of each page's candidates; equal texts count once, ties to the first."""
    once = candidates.groupBy("doc_id", "page_no", "text").agg(F.min("pos").alias("pos"))
    best = once.groupBy("doc_id", "page_no").agg(F.max(F.struct(text_score(F.col("text")).alias("score"), (-F.col("pos")).alias("early"), "text")).alias("b"))
    return best.select("doc_id", "page_no", (-F.col("b.early")).alias("pos"), "b.text")


def table_text_choice(layout: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): a table's layout if it is longer than 20 characters, else the best of the other readings."""
    other = best_text(candidates).select("doc_id", "page_no", F.col("text").alias("other"))
    both = layout.join(other, ["doc_id", "page_no"], "full")
    return both.select("doc_id", "page_no", F.when(F.length(F.trim("layout")) > LAYOUT_LEAST, F.col("layout")).otherwise(F.col("other")).alias("text"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Boxes of a page numbered from top to bottom and left to right."""
    return boxes.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("y", "x", "box_idx")) - 1)
