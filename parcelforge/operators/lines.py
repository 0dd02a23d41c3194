"""Sequence logic over the lines of a document, as windows: blocks, contexts, bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.binding import let
from parcelforge.functions.text import LINE_ENDS, alnum_count, normalize_match, stripped

# Wording of events in a deed's table of parcels.
BLOCK_START, BLOCK_END = "TABLEAU DETECTE", "FIN TABLEAU"
TOTALS = ("TOTAL DE LA SURFACE", "CONTENANCE TOTALE", "SURFACE TOTALE")
BLOCK_REACH, BLOCK_MEAN = 199, 8


def by_line() -> Window:
    """Lines of a document in their order; a document's text is one row of the input, so its lines fit a task."""
    return Window.partitionBy("doc_id").orderBy("line_no")



def text_lines(df: DataFrame) -> DataFrame:
    """(doc_id, line_no, raw, norm): the lines of `text`, numbered from 0. A line end at the very end opens no line."""
    body = F.regexp_replace("text", rf"(?:{LINE_ENDS})\z", "")
    lines = F.when(F.length("text") > 0, F.split(body, LINE_ENDS))
    rows = df.select("doc_id", F.posexplode(lines).alias("line_no", "raw"))
    return rows.withColumn("norm", normalize_match(F.col("raw")))


def with_blocks(lines: DataFrame) -> DataFrame:
    """`lines` with in_block and mean_alnum: the mean letters and digits of the non-blank lines after a line, up to the block's end and
    at most BLOCK_REACH lines on. The end of a block opens a new section, so that the mean runs over a frame of rows of the section; both
    windows need one exchange by document."""
    edge = F.when(F.col("norm") == BLOCK_START, True).when(F.col("norm") == BLOCK_END, False)
    rows = lines.withColumn("in_block", F.coalesce(F.last(edge, ignorenulls=True).over(by_line()), F.lit(False)))
    before = by_line().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_section", F.coalesce(F.sum((F.col("norm") == BLOCK_END).cast("int")).over(before), F.lit(0)))
    inside = F.when(F.col("in_block") & (F.trim("norm") != ""), alnum_count(F.col("norm")))
    reach = Window.partitionBy("doc_id", "_section").orderBy("line_no").rowsBetween(1, BLOCK_REACH)
    return rows.withColumn("mean_alnum", F.avg(inside).over(reach)).drop("_section")


def _valid() -> Column:
    return F.coalesce(F.col("mean_alnum") >= BLOCK_MEAN, F.lit(False))


def block_quality(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, mean_alnum, valid) of every block start; no lines make it invalid."""
    return with_blocks(lines).where(F.col("norm") == BLOCK_START).select("doc_id", "line_no", "mean_alnum", _valid().alias("valid"))


def _has(*parts: str) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.col("norm").contains(p)
    return out


def line_context(lines: DataFrame) -> DataFrame:
    """`lines` with event, in_block and ctx. The context at a line is that of the last event before it: a block's start (on if the
    block is valid), its end, a wording that opens a table, a total, the second blank line in a row, an article. Lines that are
    events are never scanned: `scanned` marks the others in context."""
    rows = with_blocks(lines).withColumn("valid", _valid())
    rows = rows.withColumn("before_blank", F.coalesce(F.trim(F.lag("norm").over(by_line())) == "", F.lit(False)))
    opens = _has("REFERENCE CADASTRALE") | _has("REFERENCES CADASTRALES") | (_has("SECTION") & (_has("PARCELLE") | _has("NUMERO"))) | _has("N°", "PARCELLE") | _has("FIGURANT AU CADASTRE")
    total = _has(TOTALS[0]) | _has(TOTALS[1]) | _has(TOTALS[2])
    blank = F.trim("norm") == ""
    event = (
        F.when(F.col("norm") == BLOCK_START, F.when(F.col("valid"), "on").otherwise("off"))
        .when(F.col("norm") == BLOCK_END, "off")
        .when(~F.col("in_block") & opens, "on")
        .when(total, "off")
        .when(~F.col("in_block") & blank & F.col("before_blank"), "off")
        .when(~F.col("in_block") & F.col("norm").startswith("ARTICLE "), "off")
    )
    rows = rows.withColumn("event", event).withColumn("ctx", F.coalesce(F.last("event", ignorenulls=True).over(by_line()), F.lit("off")))
    scanned = (F.col("ctx") == "on") & F.col("event").isNull() & (F.col("in_block") | ~blank)
    return rows.withColumn("scanned", scanned).drop("valid", "mean_alnum", "before_blank")


def clean_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, raw) that survive cleaning: runs of three or more lines of 1 to 3 characters go, then non-blank lines
    without letter or digit, then blanks after blanks. Spaces of any kind at the ends don't count; a blank line comes out empty."""
    size = F.length(stripped(F.col("raw")))
    rows = lines.select("doc_id", "line_no", "raw", ((size >= 1) & (size <= 3)).alias("short"), (size == 0).alias("blank"))
    at = lambda k: F.coalesce((F.lag("short", -k) if k < 0 else F.lead("short", k)).over(by_line()), F.lit(False))
    two, one, next_one, next_two = at(-2), at(-1), at(1), at(2)
    rows = rows.withColumn("burst", F.col("short") & ((two & one) | (one & next_one) | (next_one & next_two)))
    rows = rows.where(~F.col("burst") & (F.col("blank") | F.col("raw").rlike(r"[\p{L}\p{N}]")))
    rows = rows.withColumn("after_blank", F.coalesce(F.lag("blank").over(by_line()), F.lit(False)))
    return rows.where(~(F.col("blank") & F.col("after_blank"))).select("doc_id", "line_no", F.when(F.col("blank"), "").otherwise(F.col("raw")).alias("raw"))


def clean_text(text: Column) -> Column:
    """The same for a whole text in one row, its lines ending in `\\n`."""

    def marked(ls: Column) -> Column:
        size = lambda x: F.length(stripped(x))
        return F.transform(ls, lambda x: F.struct(x.alias("raw"), size(x).between(1, 3).alias("short"), (size(x) == 0).alias("blank")))

    def calm(ls: Column) -> Column:
        short = lambda i: F.coalesce(F.when(i >= 0, F.try_element_at(ls, F.greatest(i, F.lit(0)) + 1)["short"]), F.lit(False))
        burst = lambda x, i: x["short"] & ((short(i - 2) & short(i - 1)) | (short(i - 1) & short(i + 1)) | (short(i + 1) & short(i + 2)))
        return F.filter(ls, lambda x, i: ~burst(x, i) & (x["blank"] | x["raw"].rlike(r"[\p{L}\p{N}]")))

    def reduced(ls: Column) -> Column:
        before = lambda i: F.coalesce(F.when(i > 0, F.try_element_at(ls, F.greatest(i, F.lit(1)))["blank"]), F.lit(False))
        kept = F.filter(ls, lambda x, i: ~(x["blank"] & before(i)))
        return F.array_join(F.transform(kept, lambda x: F.when(x["blank"], "").otherwise(x["raw"])), "\n")

    return let(let(let(F.split(text, "\n"), marked), calm), reduced)
