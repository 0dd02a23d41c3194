"""Communes named in a deed: candidates, their rank, and their entry in the official list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.binding import let
from parcelforge.functions.text import normalize_commune, normalize_label, null_if_empty, stripped
from parcelforge.operators.joins import bounded

# Wordings that end a name, in the order they are tried, and words that speak against a candidate.
STOP_MARKERS = (" AU CONSERVATOIRE", " DU PATRIMOINE", " ASSOCIATION", " NOTAIRE", " BAIL EMPHYTEOTIQUE")
PENALTY_WORDS = ("CONSERVATOIRE", "PATRIMOINE", "NOTAIRE", "ASSOCIATION")
DEPARTMENTS = ("08", "10", "51", "52")

# Fixed patterns: a name on the line of the word commune, and a line that ends in it.
SAME_LINE = r"(?iuU)COMMUNE\s+D(?:E|')?\s+(.*)$"
LINE_END = r"(?iuU)COMMUNE\s+D(?:E|')?\s*$"
_LETTER = "A-Za-zÀ-Ÿ"


def clean_candidate(c: Column) -> Column:
    """A raw candidate cut down to the name."""
    head = F.element_at(F.split(c, r"(?U)\s+[-—]\s+", 2), 1)
    s = normalize_label(head)
    s = F.trim(F.element_at(F.split(s, r"[(,;.]", 2), 1), F.lit(" -"))
    s = F.regexp_replace(s, rf"^[^{_LETTER}]+", "")
    s = F.regexp_replace(s, rf"(?U)^[{_LETTER}]{{1,2}}\s+[^{_LETTER}\s].*?\s+", "")
    for marker in STOP_MARKERS:
        s = let(s, lambda x, m=marker: F.when(x.contains(m), F.trim(F.substring_index(x, m, 1), F.lit(" -"))).otherwise(x))
    return s


def candidate_score(c: Column) -> Column:
    """struct(points, has_hyphen, shortness); the greatest is best."""
    words = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    bad = F.lit(False)
    for w in PENALTY_WORDS:
        bad = bad | c.contains(w)
    one = lambda cond, n: F.when(cond, n).otherwise(0)
    points = one(words > 5, -5) + one(bad, -10) + one(c.contains("-"), 5) + one((F.length(c) >= 4) & (F.length(c) <= 40), 3)
    return F.struct(points.alias("points"), one(c.contains("-"), 1).alias("has_hyphen"), (-F.length(c)).alias("shortness"))


def same_line_candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, candidate) of names on the line of the word commune."""
    rows = lines.select("doc_id", (F.col("line_no") * 2).alias("pos"), stripped(F.col("raw")).alias("raw")).where(F.upper("raw").contains("COMMUNE"))
    rows = rows.select("doc_id", "pos", null_if_empty(stripped(F.regexp_extract("raw", SAME_LINE, 1))).alias("found")).where("found is not null")
    return rows.select("doc_id", "pos", clean_candidate(F.col("found")).alias("candidate")).where(F.length("candidate") >= 4)


def next_line_candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, candidate) of names on the first non-blank of the two lines after one that ends in `commune de`."""
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    filled = lambda k: null_if_empty(stripped(F.lead("raw", k).over(by_line)))
    rows = lines.select("doc_id", "line_no", stripped(F.col("raw")).alias("raw"), F.coalesce(filled(1), filled(2)).alias("next"))
    rows = rows.where(F.upper("raw").contains("COMMUNE") & F.col("raw").rlike(LINE_END) & F.col("next").isNotNull())
    return rows.select("doc_id", (F.col("line_no") * 2 + 1).alias("pos"), clean_candidate(F.col("next")).alias("candidate")).where(F.length("candidate") >= 4)


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """(doc_id, candidate): the best of each document by score, then frequency, then first seen."""
    counted = candidates.groupBy("doc_id", "candidate").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = F.struct(candidate_score(F.col("candidate")).alias("score"), F.col("n"), (-F.col("first")).alias("early"))
    return counted.groupBy("doc_id").agg(F.max(F.struct(order.alias("o"), "candidate")).alias("b")).select("doc_id", F.col("b.candidate").alias("candidate"))


def document_communes(lines: DataFrame) -> DataFrame:
    return rank_candidates(same_line_candidates(lines).unionByName(next_line_candidates(lines)))


def _substrings(df: DataFrame, column: str, least: int, most: int) -> DataFrame:
    """`df` with `part`: the distinct substrings of a column of `least` to `most` characters."""
    rows = df.where(F.length(column) >= least).select("*", F.explode(F.sequence(F.lit(1), F.length(column) - least + 1)).alias("_at"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.length(column) - F.col("_at") + 1))).alias("_n"))
    return rows.withColumn("part", F.substring(column, F.col("_at"), F.col("_n"))).drop("_at", "_n").distinct()


def match_names(names: DataFrame, communes: DataFrame, column: str = "candidate") -> DataFrame:
    """(candidate, nom, code) of distinct names: an entry of the same normalised name, first in the list; else the longest entry
    that contains the name or is contained in it, ties to the first in the list. Empty names and entries match nothing.

    Containment is two equality joins, of the entries with the name's substrings of their lengths and of the name with the
    entries' substrings; the list is broadcast only behind a count, and each name's matches are reduced at once."""
    want = names.select(F.col(column).alias("candidate")).distinct().withColumn("key", normalize_commune(F.col("candidate"))).where("key <> ''")
    entry = communes.select("nom", "code", "list_pos", normalize_commune(F.col("nom")).alias("e_key")).where("e_key <> ''")
    first = entry.groupBy("e_key").agg(F.min(F.struct("list_pos", "nom", "code")).alias("e"))
    exact = want.join(first, want.key == first.e_key).select("candidate", F.col("e.nom").alias("nom"), F.col("e.code").alias("code"))
    rest = want.join(exact, "candidate", "left_anti")
    size = entry.agg(F.coalesce(F.min(F.length("e_key")), F.lit(1)).alias("a"), F.coalesce(F.max(F.length("e_key")), F.lit(1)).alias("b")).first()
    within = _substrings(rest, "key", size["a"], size["b"]).join(bounded(entry, 50_000), F.col("part") == F.col("e_key"))
    around = rest.join(_substrings(entry, "e_key", 1, size["b"]), F.col("key") == F.col("part"))
    cols = ["candidate", "nom", "code", "list_pos", "e_key"]
    near = within.select(cols).unionByName(around.select(cols))
    best = near.groupBy("candidate").agg(F.max(F.struct(F.length("e_key").alias("size"), (-F.col("list_pos")).alias("early"), "nom", "code")).alias("e"))
    return exact.unionByName(best.select("candidate", F.col("e.nom").alias("nom"), F.col("e.code").alias("code")))


def commune_list(communes: DataFrame, departments: tuple[str, ...] = DEPARTMENTS) -> DataFrame:
    """Entries of the departments with their place in code-point order of the name, then of the department list."""
    dep_pos = F.array_position(F.array(*map(F.lit, departments)), F.col("dep"))
    order = Window.orderBy(F.coalesce("nom", F.lit("")), dep_pos, "list_pos")
    return communes.where(F.col("dep").isin(*departments)).select("nom", "code", "dep", (F.row_number().over(order) - 1).alias("ord"))


def commune_list_collated(communes: DataFrame, departments: tuple[str, ...] = DEPARTMENTS) -> DataFrame:
    """The same in French order: case and accents make no difference."""
    order = Window.orderBy(F.collate(F.coalesce("nom", F.lit("")), "fr_CI_AI"), "list_pos")
    return communes.where(F.col("dep").isin(*departments)).select("nom", "code", "dep", (F.row_number().over(order) - 1).alias("ord"))


def commune_details(communes: DataFrame, asked: DataFrame, code: str = "code") -> DataFrame:
    """The list's entries, with all their columns, whose code is asked for; codes that the list lacks give none."""
    return communes.join(asked.select(F.col(code).alias("code")), "code", "left_semi")


def commune_label(nom: Column, dep: Column, code: Column) -> Column:
    """`Name (DD)`; without a department the first two characters of the code stand for it."""
    return F.concat(nom, F.lit(" ("), F.coalesce(null_if_empty(dep), F.substring(code, 1, 2)), F.lit(")"))
