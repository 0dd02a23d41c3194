"""Pages put together to documents, pages to skip, and where a document's text comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.binding import once
from parcelforge.functions.text import alnum_count, stripped
from parcelforge.operators.lines import clean_text

# Fixed value: a page with more letters and digits is never skipped.
RICH_PAGE = 300
# Texts of the kinds of page that are skipped, in their order.
SKIP_PATTERNS = (
    "carte de localisation du site", "plan de localisation cadastral", "plan de localisation du parcellaire", "plan de situation",
    "annexe 1", "annexe 2", "annexe 3", "annexe 4", "annexe 5", "legende", "limites du site",
)

def ordered_join(parts: Column, order: Column, sep: str) -> Column:
    """Aggregate: strings joined in an explicit order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), parts.alias("s")))), lambda x: x["s"]), sep)


def page_header(page_no: Column) -> Column:
    return F.concat(F.lit("--- Page "), page_no.cast("string"), F.lit(" ---"))


def assembled(pages: DataFrame) -> DataFrame:
    """(doc_id, text): non-empty pages under their headers, blank lines between; a page keeps its number when others are empty.
    A page delivered twice counts once."""
    rows = pages.select("doc_id", "page_no", stripped(F.col("text")).alias("text")).where("text <> ''").distinct()
    part = F.concat(page_header(F.col("page_no")), F.lit("\n"), F.col("text"))
    return rows.groupBy("doc_id").agg(ordered_join(part, F.struct("page_no", "text"), "\n\n").alias("text"))


def digital_usable(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_image_pages, usable): at most half of the pages, rounded down, hold images."""
    once = pages.groupBy("doc_id", "page_no").agg(F.max(F.coalesce("n_images", F.lit(0))).alias("n"))
    docs = once.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("n") > 0).alias("n_image_pages"))
    return docs.withColumn("usable", F.col("n_image_pages") <= F.floor(F.col("n_pages") / 2))


def load_skip_patterns(lines: list[str]) -> list[tuple[int, str]]:
    """Patterns of a configuration: trimmed, without blank lines and comments, numbered."""
    kept = [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]
    return list(enumerate(kept))


def skip_reason(text: Column, patterns: tuple[str, ...] = SKIP_PATTERNS) -> Column:
    """The first pattern a poor page holds, whatever its case; null keeps the page."""
    low = F.lower(text)
    found = F.lit(None).cast("string")
    for p in reversed(patterns):
        found = F.when(low.contains(p.lower()), p).otherwise(found)
    return F.when(alnum_count(text) <= RICH_PAGE, found)


def first_readings(candidates: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, page_no, readings): a page's first readings by pos, blank lines between."""
    one = F.struct("pos", "text")
    got = candidates.where("text <> ''").groupBy("doc_id", "page_no").agg(F.slice(F.array_sort(F.collect_set(one)), 1, most).alias("c"))
    return got.select("doc_id", "page_no", F.array_join(F.transform("c", lambda x: x["text"]), "\n\n").alias("readings"))


def dual_texts(pages: DataFrame, tables: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(doc_id, display_text, analysis_text). For display, a page's cleaned text, then each table between markers, or a note on a skipped
    page; for analysis, its text as read, or where there is none the first two of its other readings (candidates: doc_id, page_no,
    pos, text), then the bare tables. Analysis falls back to display when it is empty."""
    t = tables.groupBy("doc_id", "page_no").agg(
        ordered_join(F.concat(F.lit("[TABLEAU DETECTE]\n"), F.col("text"), F.lit("\n[FIN TABLEAU]")), F.col("table_no"), "\n\n").alias("marked"),
        ordered_join(F.col("text"), F.col("table_no"), "\n\n").alias("bare"),
    )
    rows = pages.select("doc_id", "page_no", stripped(F.col("text")).alias("raw"), skip_reason(F.col("text")).alias("skip")).distinct().join(t, ["doc_id", "page_no"], "left")
    if candidates is None:
        rows = rows.withColumn("readings", F.lit(None).cast("string"))
    else:
        rows = rows.join(first_readings(candidates), ["doc_id", "page_no"], "left")
    note = F.concat(page_header(F.col("page_no")), F.lit(" [PAGE IGNORÉE : « "), F.col("skip"), F.lit(" » détecté]"))
    body = lambda text, tab: F.concat_ws("\n\n", F.nullif(text, F.lit("")), tab)
    headed = lambda b: F.when(b != "", F.concat(page_header(F.col("page_no")), F.lit("\n"), b))
    rows = once(rows, text=clean_text(F.col("raw")))
    shown = F.when(F.col("skip").isNotNull(), note).otherwise(headed(body(F.col("text"), F.col("marked"))))
    read = F.when(F.col("skip").isNull(), headed(body(F.coalesce(F.nullif("raw", F.lit("")), F.col("readings")), F.col("bare"))))
    rows = rows.select("doc_id", "page_no", shown.alias("shown"), read.alias("read"))
    order = F.struct("page_no", "shown", "read")
    docs = rows.groupBy("doc_id").agg(ordered_join(F.col("shown"), order, "\n\n").alias("display_text"), ordered_join(F.col("read"), order, "\n\n").alias("a"))
    display, analysis = stripped(F.col("display_text")), stripped(F.col("a"))
    return docs.select("doc_id", display.alias("display_text"), F.when(analysis != "", analysis).otherwise(display).alias("analysis_text"))


def routed(digital: DataFrame, usable: DataFrame, scanned: DataFrame) -> DataFrame:
    """(doc_id, route, text): digital text where it is usable and not empty, else the scanned text."""
    d = digital.select("doc_id", F.col("text").alias("d"))
    rows = usable.select("doc_id", "usable").join(d, "doc_id", "left").join(scanned.select("doc_id", F.col("text").alias("o")), "doc_id", "left")
    good = F.col("usable") & (F.coalesce("d", F.lit("")) != "")
    return rows.select("doc_id", F.when(good, "digital").otherwise("scan").alias("route"), F.when(good, F.col("d")).otherwise(F.col("o")).alias("text"))
