"""Cadastral parcels named in a deed: eight rules, one guard, first occurrence wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.text import collapse_spaces, normalize_label
from parcelforge.operators import lines as L

# Words that are no sections; after a trusted wording only the units of area are none.
NO_SECTIONS = ("A", "HA", "CA", "DE", "DU", "LE", "LA", "LES", "ET", "N", "NO", "PAGE", "SUR", "OHA", "HAO", "TOTAL", "ART", "ANNEXE", "OS", "SE", "SI", "BAS", "JZS", "PETE", "DES", "PAR", "EST")
NO_TRUSTED_SECTIONS = ("HA", "CA")

# Fixed patterns of the rules, by rule number.
SECTION_NUMBER = r"SECTION\s+([A-Z]+)\s*[NO°º.\-\s]*([0-9]{1,4}[A-Z]?)"
RULES = {
    1: r"(?iuU)CADASTR[ÉE]E?\s+" + SECTION_NUMBER,
    2: r"(?iuU)" + SECTION_NUMBER,
    3: r"(?iuU)PARCELL\w*\s+CADASTR\w*\s+([A-Z]{1,3})\s+([0-9]{1,4})\b",
    4: r"^\s*([A-Z]{1,3})\s+([0-9]{1,4})\s+[A-Z]",
    5: r"\b[0-9]{2,3}\s+([A-Z]{2,3})\s+([0-9]{1,4})(?![,.][0-9])",
}
GENERAL = r"\b([A-Z]{%d,3})\s+([0-9]{1,4}[A-Z]?)\b(?![,.][0-9])"
ITEM = r"([A-Z]{1,3})([0-9]{1,4})"
LISTS = {7: "/", 8: ","}
TRUSTED = {1: False, 2: False, 3: True, 4: True, 5: True, 6: False, 7: False, 8: True}


def _matches(rule: int, text: Column, pattern: str, line_no: Column) -> Column:
    """Array of (rule_no, line_no, pos, section, number, trusted) of every match."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("s"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("n"))
    return F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(rule).alias("rule_no"), line_no.cast("int").alias("line_no"), i.alias("pos"), m["s"].alias("section"), m["n"].alias("number"), F.lit(TRUSTED[rule]).alias("trusted")
        ),
    )


def _text_matches(rule: int) -> Column:
    """Rules 1 to 3 over a whole text, 7 and 8 over its lists of references with one separator and at most one last item after
    `et`; a list stands for a line."""
    if rule in RULES:
        return _matches(rule, F.col("text"), RULES[rule], F.lit(0))
    item, sep = ITEM.replace("(", "").replace(")", ""), LISTS[rule]
    whole = rf"(?i){item}(?:\s*{sep}\s*{item})+(?:\s+et\s+{item})?"
    lists = F.regexp_extract_all(collapse_spaces(F.col("text")), F.lit(whole), 0)
    return F.flatten(F.transform(lists, lambda x, i: _matches(rule, F.upper(x), ITEM, i)))


def _line_matches(rule: int) -> Column:
    """Rules 4 to 6 over a line; 4 and 5 take its first match, 6 all, with longer sections inside blocks."""
    at = F.col("line_no")
    if rule == 6:
        return F.when(F.col("in_block"), _matches(6, F.col("norm"), GENERAL % 2, at)).otherwise(_matches(6, F.col("norm"), GENERAL % 1, at))
    return F.slice(_matches(rule, F.col("norm"), RULES[rule], at), 1, 1)


def _exploded(df: DataFrame, matches: list[Column]) -> DataFrame:
    return df.select("doc_id", F.explode(F.concat(*matches)).alias("m")).select("doc_id", "m.*")


def text_rule(df: DataFrame, rule: int) -> DataFrame:
    return _exploded(df, [_text_matches(rule)])


def row_rule(context: DataFrame, rule: int) -> DataFrame:
    """One of the rules over the lines in context."""
    return _exploded(context.where("scanned"), [_line_matches(rule)])


def guard(pairs: DataFrame) -> DataFrame:
    """Pairs whose section may be one under the rule's trust and whose number is digits other than 0."""
    rows = pairs.withColumn("section", normalize_label(F.col("section"))).withColumn("number", normalize_label(F.col("number")))
    banned = F.when(F.col("trusted"), F.col("section").isin(*NO_TRUSTED_SECTIONS)).otherwise(F.col("section").isin(*NO_SECTIONS))
    return rows.where(~banned & F.col("number").rlike("^[0-9]+$") & (F.col("number") != "0"))


def first_occurrences(pairs: DataFrame) -> DataFrame:
    """(doc_id, ord, section, number): each parcel of a document once, in the order of its first rule, line and position."""
    place = F.struct("rule_no", "line_no", "pos")
    once = pairs.groupBy("doc_id", "section", "number").agg(F.min(place).alias("place"))
    order = Window.partitionBy("doc_id").orderBy("place", "section", "number")
    return once.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), "section", "number")


def all_pairs(df: DataFrame) -> DataFrame:
    """Every rule's pairs, guarded: texts and lines are each gone through once for all their rules. Null texts give none."""
    df = df.where("text is not null").select("doc_id", "text")
    texts = _exploded(df, [_text_matches(k) for k in (1, 2, 3, 7, 8)])
    rows = _exploded(L.line_context(L.text_lines(df)).where("scanned"), [_line_matches(k) for k in (4, 5, 6)])
    return guard(texts.unionByName(rows))


def document_parcels(df: DataFrame) -> DataFrame:
    return first_occurrences(all_pairs(df))
