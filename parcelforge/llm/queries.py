"""Queries of the text-corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.llm import canon, encode, format_dups, leak, residue, scan
from parcelforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return format_dups.record_copies(table(spark, d, "parcel_records", "rec_id", "parcelles"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Distinct records and their numbers of copies."""
    return format_dups.copy_counts(table(spark, d, "parcel_records", "rec_id", "parcelles"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_noise(table(spark, d, "doc_pages", "doc_id", "page_no", "text"), table(spark, d, "communes", "nom"))


def p3_pages(spark: SparkSession, d: str) -> DataFrame:
    """Readable paragraphs of every page."""
    return scan.repaired_pages(table(spark, d, "doc_pages", "doc_id", "page_no", "text"), table(spark, d, "communes", "nom"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.map_names(table(spark, d, "extract_commune", "cand_id", "candidate", "dep"), table(spark, d, "communes", "nom", "code", "dep", "list_pos"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each leaked item is found in."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_docs(table(spark, d, "documents", "doc_id", "text"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """How many texts are excluded, by what they hold."""
    v = residue.judged_texts(table(spark, d, "documents", "doc_id", "text"))
    kind = F.when(~F.col("residue"), "kept").when(F.col("n_field") >= residue.FIELD_CHARS, "field").when(F.col("n_notice") >= F.col("n_filler"), "notice").otherwise("filler")
    return v.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_docs"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_records": p1_records, "p3_found": p3_found, "p3_pages": p3_pages, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_shares": p9_shares}

# p1: every named field's value, folded, the fields in one order.
_KEYS = "|".join(f.replace("_", "[^a-zà-ÿ0-9]?") for f in format_dups.FIELDS)


def _sql_field(name: str) -> str:
    key = name.replace("_", "[^a-zà-ÿ0-9]?")
    value = f"""regexp_extract(lower(parcelles), '(?:^|[^a-zà-ÿ0-9]){key}["'' ]*[:=]((?s).*?)(?:[^a-zà-ÿ0-9](?:{_KEYS})["'' ]*[:=]|$)', 1)"""
    return f"coalesce(nullif('{name}=' || regexp_replace(regexp_replace({value}, '([0-9])[.,]([0-9])', '\\1~\\2', 'g'), '[^\\pL\\pN~]', '', 'g') || ';', '{name}=;'), '')"


_P1_SQL = f"""
WITH c AS (SELECT rec_id, {" || ".join(map(_sql_field, format_dups.FIELDS))} AS body FROM parcel_records WHERE trim(parcelles) <> ''),
g AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY body) AS keep_id, body FROM c WHERE body <> '')
"""

# p6: the same folding, every span against every entry.
_ABBREVIATED = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in canon.ABBREVIATIONS.items())


def _sql_words(x: str) -> str:
    s = f"regexp_replace(lower(strip_accents({x})), '[''’`]', ' ', 'g')"
    s = f"regexp_replace(replace({s}, '/', ' sur '), '\\bs[\\s.-]*sur\\b', 'sur', 'g')"
    return f"list_transform(list_filter(string_split_regex({s}, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE w {_ABBREVIATED} ELSE w END)"


def _sql_fold(x: str) -> str:
    s = f"CASE WHEN regexp_matches({x}, '[a-z]') THEN translate({x}, '{canon.LOOKALIKES[0]}', '{canon.LOOKALIKES[1]}') ELSE {x} END"
    for a, b in canon.LOOKALIKE_RUNS:
        s = f"replace({s}, '{a}', '{b}')"
    return s


_P6_SQL = f"""
WITH e0 AS (SELECT list_pos, code, dep, array_to_string({_sql_words("nom")}, '') AS ek FROM communes),
e AS (SELECT *, {_sql_fold("ek")} AS ef FROM e0),
ents AS (SELECT *, CASE {" ".join(f"WHEN length(ef) >= {n} THEN {k}" for n, k in canon.EDITS)} END AS k FROM e WHERE ef <> ''),
names AS (SELECT candidate, coalesce(dep, '') AS dep, coalesce(nullif(coalesce(dep, ''), ''), nullif(regexp_extract(candidate, '\\(\\s*([0-9]{{2}}|2[AB])\\s*\\)', 1), ''),
    nullif(regexp_extract(candidate, '(?:^|[^0-9])([0-9]{{2}})[0-9]{{3}}(?:$|[^0-9])', 1), '')) AS hint, nullif(regexp_extract(candidate, '(?:^|[^0-9])([0-9]{{5}})(?:$|[^0-9])', 1), '') AS said, {_sql_words("candidate")} AS ws
  FROM (SELECT DISTINCT candidate, dep FROM extract_commune WHERE trim(candidate) <> '')),
starts AS (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM names),
spans AS (SELECT DISTINCT candidate, dep, hint, said, array_to_string(ws[i:j], '') AS sk,
  len(list_filter(list_concat(CASE WHEN i > 1 THEN ws[1:i - 1] ELSE [] END, ws[j + 1:]), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in canon.SURROUNDINGS)}) AND NOT regexp_full_match(w, '[0-9]+'))) > 0 AS stray FROM (SELECT *, unnest(range(i, least(len(ws), i + 2 * (SELECT max(length(ef)) + 4 FROM ents)) + 1)) AS j FROM starts)),
folded AS (SELECT *, {_sql_fold("sk")} AS sf FROM spans),
met AS (SELECT f.*, ents.code, ents.dep AS dep_1, list_pos, ek, ef, levenshtein(sf, ef) AS lev FROM folded f JOIN ents ON abs(length(sf) - length(ef)) <= k AND levenshtein(sf, ef) <= CASE WHEN NOT stray THEN k {" ".join(f"WHEN length(ef) >= {n} THEN {k}" for n, k in canon.STRAY_EDITS)} END),
best AS (SELECT candidate, dep, code FROM (SELECT m.candidate, m.dep, m.code, row_number() OVER (PARTITION BY m.candidate, m.dep
    ORDER BY length(ef) - 3 * lev DESC, least(levenshtein(sk, ek), 15), coalesce(said = code, false) DESC, coalesce(hint = dep_1, false) DESC, list_pos) AS r FROM met m) WHERE r = 1)
SELECT cand_id, coalesce(b.code, 'unmatched') AS code FROM extract_commune c LEFT JOIN best b ON b.candidate = c.candidate AND b.dep = coalesce(c.dep, '') WHERE trim(c.candidate) <> ''"""



# p8: every run of words as a string. The other engine has no compatibility decomposition; the ligature is the one such sign in words.
def _sql_runs(table_name: str, key: str) -> str:
    ws = "regexp_extract_all(replace(strip_accents(lower(replace(text, 'ﬁ', 'fi'))), 'ß', 'ss'), '[\\pL\\pN]+')"
    return f"SELECT DISTINCT {key}, array_to_string(ws[i:i + {leak.RUN - 1}], ' ') AS run FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {leak.RUN - 2})) AS i FROM (SELECT {key}, {ws} AS ws FROM {table_name} WHERE text IS NOT NULL) x) y"


_P8_SQL = f"WITH d AS ({_sql_runs('documents', 'doc_id')}), t AS ({_sql_runs('eval_items', 'item_id')}), f AS (SELECT DISTINCT doc_id, item_id FROM d JOIN t USING (run)) "

ORACLES: dict[str, str] = {
    "p8_found": _P8_SQL + "SELECT * FROM f",
    "p8_items": _P8_SQL + "SELECT item_id, count(*) AS n_docs FROM f GROUP BY item_id",
    "p1_found": _P1_SQL + "SELECT keep_id, rec_id FROM g WHERE keep_id <> rec_id",
    "p1_records": _P1_SQL + "SELECT keep_id AS rec_id, count(*) AS n_copies FROM g GROUP BY keep_id",
    "p6_found": _P6_SQL,
}
