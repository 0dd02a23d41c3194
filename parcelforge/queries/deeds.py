"""Queries of the operators on deeds, pages and geography, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import files, geometry, keys, text
from parcelforge.operators import boxes as B
from parcelforge.operators import communes as C
from parcelforge.operators import features as N
from parcelforge.operators import layout as Y
from parcelforge.operators import lines as L
from parcelforge.operators import pages as G
from parcelforge.operators import parcels as P
from parcelforge.operators import verify as V
from parcelforge.plans.document import document_records
from parcelforge.queries import derived as D
from parcelforge.sources import sinks
from parcelforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- SQL shared by the twins ---------------------------------------------------------------------------------------------------
DEEDS, WORDS, BOXES, TABLES, READINGS = map(D.duck, (D.DEED_TEXTS, D.WORDS, D.BOXES, D.TABLES, D.READINGS))
PAGE_TABLES, SKIPPABLE, BBOX_TEXTS = map(D.duck, (D.PAGE_TABLES, D.SKIPPABLE, D.BBOX_TEXTS))
# spaces of any kind: as signs of a class, and as characters to strip
SP = r"\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
STRIP = " || ".join(f"chr({c})" for c in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
ENDS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def sql_strip(x: str) -> str:
    return f"trim({x}, {STRIP})"


def sql_word_signs(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\pL\pN_]', '', 'g'))"


EDGES = "' .,:;()[]{}' || chr(9) || chr(10) || chr(13)"


def sql_label(x: str) -> str:
    return rf"upper(regexp_replace(trim(regexp_replace({x}, '[{SP}]+', ' ', 'g'), {EDGES}), '\s*-\s*', '-', 'g'))"


def sql_match(x: str) -> str:
    return sql_label(f"strip_accents({x})")


def sql_commune(x: str) -> str:
    return rf"regexp_replace(regexp_replace(trim(upper(strip_accents({x}))), '[''-]+', ' ', 'g'), '\s+', ' ', 'g')"


def sql_alnum(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\pL\pN]', '', 'g'))"


LINES = f"""lines AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS line_no, raw, {sql_match("raw")} AS norm FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {DEEDS} d WHERE text <> '') s)"""

QUALITY = f"""quality AS (
  SELECT s.doc_id, s.line_no, avg({sql_alnum("l.norm")}) FILTER (WHERE trim(l.norm) <> '') AS mean_alnum
  FROM (SELECT doc_id, line_no, (SELECT min(e.line_no) FROM lines e WHERE e.doc_id = lines.doc_id AND e.norm = 'FIN TABLEAU' AND e.line_no > lines.line_no) AS stop
        FROM lines WHERE norm = 'TABLEAU DETECTE') s
  LEFT JOIN lines l ON l.doc_id = s.doc_id AND l.line_no > s.line_no AND l.line_no <= s.line_no + 199 AND (s.stop IS NULL OR l.line_no < s.stop)
  GROUP BY s.doc_id, s.line_no)"""

CONTEXT = """blocks AS (
  SELECT l.*, coalesce(last_value(CASE norm WHEN 'TABLEAU DETECTE' THEN true WHEN 'FIN TABLEAU' THEN false END IGNORE NULLS) OVER w, false) AS in_block,
    coalesce(trim(lag(norm) OVER w) = '', false) AS before_blank, coalesce(q.mean_alnum >= 8, false) AS valid
  FROM lines l LEFT JOIN quality q USING (doc_id, line_no) WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.line_no)),
events AS (
  SELECT *, CASE WHEN norm = 'TABLEAU DETECTE' THEN CASE WHEN valid THEN 'on' ELSE 'off' END
    WHEN norm = 'FIN TABLEAU' THEN 'off'
    WHEN NOT in_block AND (contains(norm, 'REFERENCE CADASTRALE') OR contains(norm, 'REFERENCES CADASTRALES') OR (contains(norm, 'SECTION') AND (contains(norm, 'PARCELLE') OR contains(norm, 'NUMERO')))
      OR (contains(norm, 'N°') AND contains(norm, 'PARCELLE')) OR contains(norm, 'FIGURANT AU CADASTRE')) THEN 'on'
    WHEN contains(norm, 'TOTAL DE LA SURFACE') OR contains(norm, 'CONTENANCE TOTALE') OR contains(norm, 'SURFACE TOTALE') THEN 'off'
    WHEN NOT in_block AND trim(norm) = '' AND before_blank THEN 'off'
    WHEN NOT in_block AND starts_with(norm, 'ARTICLE ') THEN 'off' END AS event
  FROM blocks),
context AS (
  SELECT *, ctx = 'on' AND event IS NULL AND (in_block OR trim(norm) <> '') AS scanned FROM (
    SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'off') AS ctx FROM events) e)"""

SECNUM = rf"SECTION[{SP}]+([A-Z]+)[{SP}]*[NO°º.\-{SP}]*([0-9]{{1,4}}[A-Z]?)"


def sql_pairs(name: str, rule: int, source: str, expr: str, pattern: str, trusted: bool, flags: str = "", where: str = "true", line: str = "0", first: bool = False) -> str:
    f = f", '{flags}'" if flags else ""
    g = lambda k: f"regexp_extract_all({expr}, '{pattern}', {k}{f})"
    return f"""{name} AS (SELECT doc_id, {rule} AS rule_no, CAST({line} AS INT) AS line_no, CAST(i - 1 AS INT) AS pos, section, number, {str(trusted).lower()} AS trusted FROM (
      SELECT doc_id, {line} AS line_no, unnest({g(1)}) AS section, unnest({g(2)}) AS number, generate_subscripts({g(1)}, 1) AS i FROM {source} WHERE {where}) x{" WHERE i = 1" if first else ""})"""


def sql_list(name: str, rule: int, sep: str, trusted: bool) -> str:
    item = "[A-Z]{1,3}[0-9]{1,4}"
    whole = rf"{item}(?:\s*{sep}\s*{item})+(?:\s+et\s+{item})?"
    flat = rf"regexp_replace(text, '\s+', ' ', 'g')"
    lists = f"""(SELECT doc_id, unnest(regexp_extract_all({flat}, '{whole}', 0, 'i')) AS list, generate_subscripts(regexp_extract_all({flat}, '{whole}', 0, 'i'), 1) - 1 AS line_no FROM {DEEDS} d) q"""
    return sql_pairs(name, rule, lists, "upper(list)", "([A-Z]{1,3})([0-9]{1,4})", trusted, line="line_no")


MARKED = r"regexp_replace(norm, '([,.][0-9])', '~\1', 'g')"
E1 = sql_pairs("e1", 1, f"{DEEDS} d", "text", rf"CADASTR[ÉEée]E?[{SP}]+" + SECNUM, False, "i")
E2 = sql_pairs("e2", 2, f"{DEEDS} d", "text", SECNUM, False, "i")
E3 = sql_pairs("e3", 3, f"{DEEDS} d", "text", r"PARCELL[\pL\pN_]*\s+CADASTR[\pL\pN_]*\s+([A-Z]{1,3})\s+([0-9]{1,4})\b", True, "i")
E4 = sql_pairs("e4", 4, "context", "norm", r"^\s*([A-Z]{1,3})\s+([0-9]{1,4})\s+[A-Z]", True, where="scanned", line="line_no", first=True)
_P5 = r"\b[0-9]{2,3}\s+([A-Z]{2,3})\s+([0-9]{1,4})(~)?"
E5 = rf"""e5 AS (SELECT doc_id, 5 AS rule_no, line_no, 0 AS pos, section, number, true AS trusted FROM (
  SELECT doc_id, line_no, section, CASE WHEN coalesce(mark, '') = '~' THEN left(number, -1) ELSE number END AS number, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) AS r FROM (
    SELECT doc_id, line_no, unnest(regexp_extract_all({MARKED}, '{_P5}', 1)) AS section, unnest(regexp_extract_all({MARKED}, '{_P5}', 2)) AS number,
      unnest(regexp_extract_all({MARKED}, '{_P5}', 3)) AS mark, generate_subscripts(regexp_extract_all({MARKED}, '{_P5}', 1), 1) AS i FROM context WHERE scanned) x
  WHERE NOT (coalesce(mark, '') = '~' AND length(number) = 1)) y WHERE r = 1)"""


def _p6(k: int) -> str:
    return rf"\b([A-Z]{{{k},3}})\s+([0-9]{{1,4}}[A-Z]?)\b(~)?"


def _e6(k: int, where: str) -> str:
    return rf"""SELECT doc_id, 6 AS rule_no, line_no, CAST(row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1 AS INT) AS pos, section, number, false AS trusted FROM (
    SELECT doc_id, line_no, unnest(regexp_extract_all({MARKED}, '{_p6(k)}', 1)) AS section, unnest(regexp_extract_all({MARKED}, '{_p6(k)}', 2)) AS number,
      unnest(regexp_extract_all({MARKED}, '{_p6(k)}', 3)) AS mark, generate_subscripts(regexp_extract_all({MARKED}, '{_p6(k)}', 1), 1) AS i FROM context WHERE scanned AND {where}) x WHERE coalesce(mark, '') = ''"""


E6 = f"e6 AS ({_e6(2, 'in_block')} UNION ALL {_e6(1, 'NOT in_block')})"
E7, E8 = sql_list("e7", 7, "/", False), sql_list("e8", 8, ",", True)
_BANNED = ", ".join(f"'{x}'" for x in P.NO_SECTIONS)
_BANNED_T = ", ".join(f"'{x}'" for x in P.NO_TRUSTED_SECTIONS)
GUARDED = f"""allpairs AS ({" UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(1, 9))}),
guarded AS (SELECT * FROM (SELECT doc_id, rule_no, line_no, pos, {sql_label("section")} AS section, {sql_label("number")} AS number, trusted FROM allpairs) g
  WHERE NOT CASE WHEN trusted THEN section IN ({_BANNED_T}) ELSE section IN ({_BANNED}) END AND regexp_full_match(number, '[0-9]+') AND number <> '0')"""
PARCELS = """parcels AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rule_no, line_no, pos, section, number) - 1 AS INT) AS ord, section, number FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, section, number ORDER BY rule_no, line_no, pos) AS r FROM guarded) g WHERE r = 1)"""
ALL_RULES = ",\n".join([LINES, QUALITY, CONTEXT, E1, E2, E3, E4, E5, E6, E7, E8, GUARDED, PARCELS])

PAIR_COLS = ["doc_id", "rule_no", "line_no", "pos", "section", "number"]


def _deeds(spark: SparkSession, d: str) -> DataFrame:
    return D.derive(spark, d, D.DEED_TEXTS)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return L.text_lines(_deeds(spark, d))


# --- file names, labels, acts --------------------------------------------------------------------------------------------------
_STEM = r"regexp_replace(filename, '\.[^.]*$', '')"
_PAT = "([0-9]{5})_([A-Za-z]{2,})_([0-9]{8})"
_FILE = rf"""SELECT doc_id, CASE WHEN regexp_matches({_STEM}, '{_PAT}') THEN regexp_extract({_STEM}, '{_PAT}', 1) END AS site_code,
  CASE WHEN regexp_matches({_STEM}, '{_PAT}') THEN upper(regexp_extract({_STEM}, '{_PAT}', 2)) END AS document_type,
  CASE WHEN regexp_matches({_STEM}, '{_PAT}') THEN regexp_replace(regexp_extract({_STEM}, '{_PAT}', 3), '(....)(..)(..)', '\1-\2-\3') END AS document_date,
  filename AS source_filename FROM deeds"""


@query(_FILE)
def filename_parse(spark: SparkSession, d: str) -> DataFrame:
    return files.with_filename(table(spark, d, "deeds", "doc_id", "filename")).drop("filename")


@query(f"SELECT cand_id, {sql_label('candidate')} AS label FROM extract_commune")
def normalize_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extract_commune", "cand_id", "candidate").select("cand_id", text.normalize_label(F.col("candidate")).alias("label"))


@query(f"SELECT list_pos, {sql_match('nom')} AS label FROM communes")
def normalize_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "communes", "list_pos", "nom").select("list_pos", text.normalize_match(F.col("nom")).alias("label"))


@query(f"SELECT list_pos, {sql_commune('nom')} AS label FROM communes")
def normalize_commune(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "communes", "list_pos", "nom").select("list_pos", text.normalize_commune(F.col("nom")).alias("label"))


@query(f"SELECT doc_id, CAST({sql_alnum('text')} AS BIGINT) AS n FROM documents")
def alnum_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.alnum_count(F.col("text")).cast("bigint").alias("n"))


_ACT = rf"regexp_matches({sql_match('text')}, '\bBAIL\s+EMPHYTEOTIQUE\b')"


@query(f"SELECT doc_id, CASE WHEN {_ACT} THEN 'BE' END AS document_type, CASE WHEN {_ACT} THEN 'BAIL EMPHYTEOTIQUE' END AS document_type_label FROM {DEEDS} d")
def doctype_detect(spark: SparkSession, d: str) -> DataFrame:
    code, label = files.detected_act(F.col("text"))
    return _deeds(spark, d).select("doc_id", code.alias("document_type"), label.alias("document_type_label"))


# --- parcels --------------------------------------------------------------------------------------------------------------------
def _rule_sql(*ctes: str, name: str) -> str:
    return "WITH " + ",\n".join(ctes) + f" SELECT {', '.join(PAIR_COLS)} FROM {name}"


@query(_rule_sql(E1, name="e1"))
def parcel_section_cadastre(spark: SparkSession, d: str) -> DataFrame:
    return P.text_rule(_deeds(spark, d), 1).select(PAIR_COLS)


@query(_rule_sql(E2, name="e2"))
def parcel_section(spark: SparkSession, d: str) -> DataFrame:
    return P.text_rule(_deeds(spark, d), 2).select(PAIR_COLS)


@query(_rule_sql(E3, name="e3"))
def parcel_notarial(spark: SparkSession, d: str) -> DataFrame:
    return P.text_rule(_deeds(spark, d), 3).select(PAIR_COLS)


@query(_rule_sql(LINES, QUALITY, CONTEXT, E4, name="e4"))
def parcel_row_start(spark: SparkSession, d: str) -> DataFrame:
    return P.row_rule(L.line_context(_lines(spark, d)), 4).select(PAIR_COLS)


@query(_rule_sql(LINES, QUALITY, CONTEXT, E5, name="e5"))
def parcel_row_prefix(spark: SparkSession, d: str) -> DataFrame:
    return P.row_rule(L.line_context(_lines(spark, d)), 5).select(PAIR_COLS)


@query(_rule_sql(LINES, QUALITY, CONTEXT, E6, name="e6"))
def parcel_row_general(spark: SparkSession, d: str) -> DataFrame:
    return P.row_rule(L.line_context(_lines(spark, d)), 6).select(PAIR_COLS)


@query(_rule_sql(E7, name="e7"))
def parcel_list_slash(spark: SparkSession, d: str) -> DataFrame:
    return P.text_rule(_deeds(spark, d), 7).select(PAIR_COLS)


@query(_rule_sql(E8, name="e8"))
def parcel_list_comma(spark: SparkSession, d: str) -> DataFrame:
    return P.text_rule(_deeds(spark, d), 8).select(PAIR_COLS)


@query(f"WITH {ALL_RULES} SELECT {', '.join(PAIR_COLS)}, trusted FROM guarded")
def parcel_guard(spark: SparkSession, d: str) -> DataFrame:
    return P.all_pairs(_deeds(spark, d)).select(*PAIR_COLS, "trusted")


@query(f"WITH {ALL_RULES} SELECT doc_id, section, number, CAST(count(*) AS BIGINT) AS n, min(rule_no) AS first_rule FROM guarded GROUP BY ALL")
def parcel_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return P.all_pairs(_deeds(spark, d)).groupBy("doc_id", "section", "number").agg(F.count("*").alias("n"), F.min("rule_no").alias("first_rule"))


@query(f"WITH {ALL_RULES} SELECT * FROM parcels")
def parcels_all(spark: SparkSession, d: str) -> DataFrame:
    return P.document_parcels(_deeds(spark, d))


@query(f"WITH {LINES}, {QUALITY} SELECT doc_id, line_no, round(mean_alnum, 6) AS mean_alnum, coalesce(mean_alnum >= 8, false) AS valid FROM quality")
def block_quality(spark: SparkSession, d: str) -> DataFrame:
    return L.block_quality(_lines(spark, d)).withColumn("mean_alnum", F.round("mean_alnum", 6))


@query(f"WITH {LINES}, {QUALITY}, {CONTEXT} SELECT doc_id, line_no, norm, in_block, event, ctx, scanned FROM context")
def line_context(spark: SparkSession, d: str) -> DataFrame:
    return L.line_context(_lines(spark, d)).select("doc_id", "line_no", "norm", "in_block", "event", "ctx", "scanned")


_PAGE_LINES = f"""pl AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, raw FROM (
  SELECT doc_id * 1000 + page_no AS doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM (SELECT DISTINCT doc_id, page_no, text FROM {SKIPPABLE} sp WHERE text IS NOT NULL) p) s)"""


@query(
    f"""WITH {_PAGE_LINES},
s AS (SELECT *, length({sql_strip("raw")}) BETWEEN 1 AND 3 AS short, {sql_strip("raw")} = '' AS blank FROM pl),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - row_number() OVER (PARTITION BY doc_id, short ORDER BY line_no) AS island FROM s),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, short, island) AS run FROM g),
k AS (SELECT doc_id, line_no, raw, blank FROM r WHERE NOT (short AND run >= 3) AND (blank OR regexp_matches(raw, '[\\pL\\pN]')))
SELECT doc_id, line_no, CASE WHEN blank THEN '' ELSE raw END AS raw FROM (SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS after_blank FROM k) x WHERE NOT (blank AND after_blank)"""
)
def ocr_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = D.derive(spark, d, D.SKIPPABLE).where("text is not null").select("doc_id", "page_no", "text").distinct()
    rows = pages.select((F.col("doc_id") * 1000 + F.col("page_no")).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return L.clean_lines(rows)


# --- communes -------------------------------------------------------------------------------------------------------------------
def sql_clean(x: str) -> str:
    head = rf"regexp_extract({x}, '^(.*?)(?:\s+[-—]\s+|$)', 1)"
    s = rf"trim(regexp_extract({sql_label(head)}, '^[^(,;.]*', 0), ' -')"
    s = rf"regexp_replace({s}, '^[^A-Za-zÀ-Ÿ]+', '')"
    s = rf"regexp_replace({s}, '^[A-Za-zÀ-Ÿ]{{1,2}}\s+[^A-Za-zÀ-Ÿ\s].*?\s+', '')"
    for m in C.STOP_MARKERS:
        s = f"(SELECT CASE WHEN contains(c, '{m}') THEN trim(string_split(c, '{m}')[1], ' -') ELSE c END FROM (SELECT {s} AS c))"
    return s


SAME = rf"""same AS (SELECT doc_id, CAST(line_no * 2 AS INT) AS pos, candidate FROM (
  SELECT doc_id, line_no, {sql_clean("found")} AS candidate FROM (SELECT doc_id, line_no, trim(regexp_extract({sql_strip("raw")}, 'COMMUNE\s+D(?:E|'')?\s+(.*)$', 1, 'i')) AS found FROM lines WHERE contains(upper(raw), 'COMMUNE')) f
  WHERE found <> '') c WHERE length(candidate) >= 4)"""
NEXT = rf"""nxt AS (SELECT doc_id, CAST(line_no * 2 + 1 AS INT) AS pos, candidate FROM (
  SELECT doc_id, line_no, {sql_clean("follows")} AS candidate FROM (SELECT doc_id, line_no, {sql_strip("raw")} AS raw, coalesce(nullif({sql_strip("lead(raw, 1) OVER w")}, ''), nullif({sql_strip("lead(raw, 2) OVER w")}, '')) AS follows
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) f
  WHERE regexp_matches(raw, 'COMMUNE\s+D(?:E|'')?\s*$', 'i') AND follows IS NOT NULL) c WHERE length(candidate) >= 4)"""


def sql_points(x: str) -> str:
    bad = " OR ".join(f"contains({x}, '{w}')" for w in C.PENALTY_WORDS)
    return rf"(CASE WHEN len(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')) > 5 THEN -5 ELSE 0 END + CASE WHEN {bad} THEN -10 ELSE 0 END + CASE WHEN contains({x}, '-') THEN 5 ELSE 0 END + CASE WHEN length({x}) BETWEEN 4 AND 40 THEN 3 ELSE 0 END)"


RANKED = f"""ranked AS (SELECT doc_id, candidate FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {sql_points("candidate")} DESC, contains(candidate, '-') DESC, length(candidate), n DESC, first) AS r FROM (
    SELECT doc_id, candidate, count(*) AS n, min(pos) AS first FROM (SELECT * FROM same UNION ALL SELECT * FROM nxt) u GROUP BY ALL) c) x WHERE r = 1)"""


@query(f"SELECT cand_id, {sql_clean('candidate')} AS cleaned FROM extract_commune")
def commune_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extract_commune", "cand_id", "candidate").select("cand_id", C.clean_candidate(F.col("candidate")).alias("cleaned"))


@query(f"SELECT cand_id, {sql_points('candidate')} AS points, CASE WHEN contains(candidate, '-') THEN 1 ELSE 0 END AS has_hyphen, -length(candidate) AS shortness FROM extract_commune WHERE candidate IS NOT NULL")
def commune_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extract_commune", "cand_id", "candidate").where("candidate is not null")
    return rows.select("cand_id", C.candidate_score(F.col("candidate")).alias("s")).select("cand_id", "s.*")


@query(f"WITH {LINES}, {SAME} SELECT * FROM same")
def commune_same_line(spark: SparkSession, d: str) -> DataFrame:
    return C.same_line_candidates(_lines(spark, d))


@query(f"WITH {LINES}, {NEXT} SELECT * FROM nxt")
def commune_next_line(spark: SparkSession, d: str) -> DataFrame:
    return C.next_line_candidates(_lines(spark, d))


@query(f"WITH {LINES}, {SAME}, {NEXT}, {RANKED} SELECT * FROM ranked")
def commune_rank(spark: SparkSession, d: str) -> DataFrame:
    return C.document_communes(_lines(spark, d))


def sql_names(source: str, column: str, where: str = "true") -> str:
    k, e = sql_commune(column), sql_commune("nom")
    return f"""names AS (SELECT candidate, nom, code FROM (
  SELECT w.candidate, e.nom, e.code, row_number() OVER (PARTITION BY w.candidate ORDER BY (e.ek = w.k) DESC, CASE WHEN e.ek = w.k THEN 0 ELSE length(e.ek) END DESC, e.list_pos) AS r
  FROM (SELECT DISTINCT {column} AS candidate, {k} AS k FROM {source}) w
  JOIN (SELECT nom, code, list_pos, {e} AS ek FROM communes WHERE {where}) e ON contains(w.k, e.ek) OR contains(e.ek, w.k)
  WHERE w.k <> '' AND e.ek <> '') x WHERE r = 1)"""


@query(f"WITH {sql_names('extract_commune', 'candidate')} SELECT * FROM names")
def commune_match(spark: SparkSession, d: str) -> DataFrame:
    return C.match_names(table(spark, d, "extract_commune", "candidate"), table(spark, d, "communes"))


_DEPS = "dep IN ('08', '10', '51', '52')"


@query(f"SELECT nom, code, dep, CAST(row_number() OVER (ORDER BY coalesce(nom, ''), dep, list_pos) - 1 AS INT) AS ord FROM communes WHERE {_DEPS}")
def commune_list(spark: SparkSession, d: str) -> DataFrame:
    return C.commune_list(table(spark, d, "communes"))


@query(f"SELECT nom, code, dep, CAST(row_number() OVER (ORDER BY lower(strip_accents(nom)), list_pos) - 1 AS INT) AS ord FROM communes WHERE {_DEPS} AND false")
def commune_list_collated(spark: SparkSession, d: str) -> DataFrame:
    return C.commune_list_collated(table(spark, d, "communes"))


del ORACLES["commune_list_collated"]  # the French order has no twin in the other engine; a test checks it on fixtures


@query("SELECT c.code, c.nom, c.dep FROM communes c WHERE c.code IN (SELECT code_insee FROM parcel_ref)")
def commune_details(spark: SparkSession, d: str) -> DataFrame:
    """The entries of the communes that parcels name."""
    asked = table(spark, d, "parcel_ref", "code_insee").select("code_insee").distinct()
    return C.commune_details(table(spark, d, "communes", "code", "nom", "dep"), asked, "code_insee")


@query("SELECT code, nom || ' (' || coalesce(nullif(dep, ''), left(code, 2)) || ')' AS label FROM communes")
def commune_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "communes").select("code", C.commune_label(F.col("nom"), F.col("dep"), F.col("code")).alias("label"))


# --- parcels against the reference ------------------------------------------------------------------------------------------------
def _pad(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) < {n} THEN lpad({x}, {n}, '0') ELSE {x} END)"


RING = """CASE geometry."type" WHEN 'Polygon' THEN CAST(geometry.coordinates::JSON->0 AS DOUBLE[][]) WHEN 'MultiPolygon' THEN CAST(geometry.coordinates::JSON->0->0 AS DOUBLE[][]) END"""
_LO = lambda k: f"list_min(list_transform(ring, lambda p: p[{k}]))"
_HI = lambda k: f"list_max(list_transform(ring, lambda p: p[{k}]))"
_BBOX = f"CASE WHEN len(ring) > 0 THEN concat_ws(',', CAST({_LO(1)} AS VARCHAR), CAST({_LO(2)} AS VARCHAR), CAST({_HI(1)} AS VARCHAR), CAST({_HI(2)} AS VARCHAR)) END"
FEATURES = f"""features AS (SELECT * EXCLUDE (r, until) FROM (
  SELECT *, row_number() OVER (PARTITION BY p_code, p_section, p_numero ORDER BY loaded_at, until, idu, nom_com, contenance NULLS FIRST, bbox NULLS FIRST) AS r FROM (
    SELECT {_pad("upper(trim(code_insee))", 5)} AS p_code, {_pad("upper(trim(section))", 2)} AS p_section, {_pad("trim(numero)", 4)} AS p_numero, loaded_at, coalesce(deleted_at, TIMESTAMP '9999-12-31') AS until,
      coalesce(nullif(idu, ''), code_parcelle) AS idu, coalesce(nullif(nom_com, ''), nom_commune) AS nom_com, contenance, round(contenance / 10000.0, 4) AS contenance_ha, {_BBOX} AS bbox
    FROM (SELECT *, {RING} AS ring FROM parcel_ref) p) f) x WHERE r = 1)"""
_VP = """vp AS (SELECT DISTINCT verif_id, code_insee, section, numero AS number FROM verify_parcelle WHERE section IS NOT NULL AND numero IS NOT NULL)"""
_ON = f"""f.p_code = {_pad("upper(trim(v.code_insee))", 5)} AND f.p_section = {_pad("upper(trim(v.section))", 2)} AND f.p_numero = {_pad("trim(v.number)", 4)}"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    return V.reference_features(table(spark, d, "parcel_ref"))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "verify_parcelle", "verif_id", "code_insee", "section", "numero").where("section is not null and numero is not null").withColumnRenamed("numero", "number").distinct()


@query(f"SELECT verif_id, {_pad('upper(trim(code_insee))', 5)} AS code_insee, {_pad('upper(trim(section))', 2)} AS section, {_pad('trim(numero)', 4)} AS numero FROM verify_parcelle")
def parcel_key_norm(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verify_parcelle", "verif_id", "code_insee", "section", "numero")
    return v.select("verif_id", keys.norm_insee(F.col("code_insee")).alias("code_insee"), keys.norm_section(F.col("section")).alias("section"), keys.norm_numero(F.col("numero")).alias("numero"))


@query("SELECT idu, round(contenance / 10000.0, 4) AS ha FROM parcel_ref")
def area_ha(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parcel_ref", "idu", "contenance").select("idu", V.area_ha(F.col("contenance")).alias("ha"))


_IDU = "^([0-9]{5})([0-9]+)([A-Za-z]{1,2})([0-9]{3,4})$"


def _sql_idu(k: int) -> str:
    return f"nullif(regexp_extract(trim(idu), '{_IDU}', {k}), '')"


@query(f"SELECT req_id, {_sql_idu(1)} AS code_insee, {_pad(_sql_idu(3), 2)} AS section, {_pad(_sql_idu(4), 4)} AS numero FROM idus")
def idu_parse(spark: SparkSession, d: str) -> DataFrame:
    part = lambda k: keys.idu_part(F.col("idu"), k)
    return table(spark, d, "idus", "req_id", "idu").select("req_id", part(1).alias("code_insee"), keys.pad_left(part(3), 2).alias("section"), keys.pad_left(part(4), 4).alias("numero"))


_LOOK = "idu, nom_com, contenance, contenance_ha, bbox"


@query(f"WITH {FEATURES} SELECT p_code, p_section, p_numero, {_LOOK} FROM features")
def parcel_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d)


@query(f"WITH {FEATURES}, {_VP} SELECT v.*, f.p_code IS NOT NULL AS ign_verified, f.idu, f.nom_com, f.contenance_ha, f.bbox FROM vp v LEFT JOIN features f ON {_ON}")
def parcel_verify(spark: SparkSession, d: str) -> DataFrame:
    return V.verify(_checks(spark, d), _features(spark, d))


@query(
    f"""WITH {FEATURES} SELECT list_id, ord, v.asked, f.idu, f.nom_com, f.contenance, f.bbox
FROM (SELECT list_id, ord, idu AS asked, {_sql_idu(1)} AS code_insee, {_sql_idu(3)} AS section, {_sql_idu(4)} AS number FROM idus) v JOIN features f ON {_ON}"""
)
def parcel_info_by_idu(spark: SparkSession, d: str) -> DataFrame:
    return V.info_by_idu(table(spark, d, "idus"), _features(spark, d))


_VDOC = "vd AS (SELECT DISTINCT doc_id, code_insee, section, numero AS number FROM verify_parcelle WHERE section IS NOT NULL AND numero IS NOT NULL)"


def _doc_checks(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verify_parcelle", "doc_id", "code_insee", "section", "numero").where("section is not null and numero is not null")
    return V.verify(v.withColumnRenamed("numero", "number").distinct(), _features(spark, d))


@query(
    f"""WITH {FEATURES}, {_VDOC}, c AS (SELECT v.*, f.p_code IS NOT NULL AS ign_verified, f.idu FROM vd v LEFT JOIN features f ON {_ON})
SELECT doc_id, code_insee, section, number, ign_verified, idu FROM (SELECT *, bool_or(ign_verified) OVER (PARTITION BY doc_id) AS hit FROM c) x WHERE NOT hit OR ign_verified"""
)
def confirm_fallback(spark: SparkSession, d: str) -> DataFrame:
    return V.confirmed_or_all(_doc_checks(spark, d)).select("doc_id", "code_insee", "section", "number", "ign_verified", "idu")


@query(
    f"""WITH {FEATURES}, {_VDOC}, c AS (SELECT v.*, f.p_code IS NOT NULL AS ign_verified, f.idu, f.bbox IS NULL AND f.p_code IS NOT NULL AS failed FROM vd v LEFT JOIN features f ON {_ON}),
g AS (SELECT *, bool_or(failed) OVER (PARTITION BY doc_id) AS any_failed FROM c)
SELECT doc_id, code_insee, section, number, CASE WHEN NOT any_failed THEN ign_verified END AS ign_verified, CASE WHEN NOT any_failed THEN idu END AS idu FROM g"""
)
def verify_degrade(spark: SparkSession, d: str) -> DataFrame:
    rows = V.degrade(_doc_checks(spark, d), F.col("bbox").isNull() & F.col("ign_verified"))
    return rows.select("doc_id", "code_insee", "section", "number", "ign_verified", "idu")


_META = f"""WITH {ALL_RULES}, {SAME}, {NEXT}, {RANKED}, {sql_names("ranked", "candidate", _DEPS)}, {FEATURES}, file AS ({_FILE}),
named AS (SELECT r.doc_id, coalesce(n.nom, r.candidate) AS commune, n.code AS code_insee FROM ranked r LEFT JOIN names n USING (candidate)),
checked AS (SELECT v.doc_id, v.ord, v.section, v.number, CASE WHEN v.code_insee IS NOT NULL THEN f.p_code IS NOT NULL END AS ign_verified FROM (SELECT p.*, n.code_insee FROM parcels p LEFT JOIN named n USING (doc_id)) v LEFT JOIN features f ON {_ON}),
kept AS (SELECT * FROM (SELECT *, bool_or(coalesce(ign_verified, false)) OVER (PARTITION BY doc_id) AS hit FROM checked) x WHERE NOT hit OR ign_verified),
listed AS (SELECT doc_id, string_agg(section || ' ' || number || ' ' || coalesce(CAST(ign_verified AS VARCHAR), '?'), '; ' ORDER BY ord) AS parcels FROM kept GROUP BY doc_id)
SELECT d.doc_id, site_code, coalesce(document_type, CASE WHEN {_ACT} THEN 'BE' END) AS document_type, document_date, source_filename, CASE WHEN {_ACT} THEN 'BAIL EMPHYTEOTIQUE' END AS document_type_label,
  commune, code_insee, coalesce(parcels, '') AS parcels
FROM {DEEDS} d JOIN file USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN listed USING (doc_id)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    return document_records(_deeds(spark, d), table(spark, d, "communes"), table(spark, d, "parcel_ref"))


@query(_META)
def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    one = lambda p: F.concat_ws(" ", p["section"], p["number"], F.coalesce(p["ign_verified"].cast("string"), F.lit("?")))
    return _records(spark, d).withColumn("parcels", F.array_join(F.transform("cadastral_parcels", one), "; ")).drop("cadastral_parcels")


# --- boxes and geography ------------------------------------------------------------------------------------------------------------
_RINGS = f"(SELECT idu, code_parcelle, {RING} AS ring FROM parcel_ref)"


def _rings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parcel_ref").withColumn("ring", geometry.outer_ring(F.col("geometry.type"), F.col("geometry.coordinates")))


@query(f"SELECT idu, code_parcelle, {_LO(1)} AS min_x, {_LO(2)} AS min_y, {_HI(1)} AS max_x, {_HI(2)} AS max_y, {_BBOX} AS bbox FROM {_RINGS} r")
def ring_bbox(spark: SparkSession, d: str) -> DataFrame:
    r = _rings(spark, d).withColumn("e", geometry.envelope(F.col("ring")))
    return r.select("idu", "code_parcelle", "e.min_x", "e.min_y", "e.max_x", "e.max_y", geometry.bbox_text(F.col("ring")).alias("bbox"))


_PART = lambda k: f"CASE WHEN trim(p[{k}]) = '' THEN 0.0 ELSE try_cast(trim(p[{k}]) AS DOUBLE) END"
_PARSED = f"(SELECT bbox_key, {', '.join(f'CASE WHEN good THEN v{k} END AS {c}' for k, c in enumerate(('min_x', 'min_y', 'max_x', 'max_y'), 1))} FROM (SELECT *, len(p) = 4 AND v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL AND v4 IS NOT NULL AS good FROM (SELECT bbox_key, p, {', '.join(f'{_PART(k)} AS v{k}' for k in range(1, 5))} FROM (SELECT bbox_key, string_split(bbox, ',') AS p FROM {BBOX_TEXTS} b) s) t) u)"


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return D.derive(spark, d, D.BBOX_TEXTS).select("bbox_key", geometry.parse_bbox(F.col("bbox")).alias("b")).select("bbox_key", "b.*")


@query(f"SELECT * FROM {_PARSED} z")
def bbox_parse(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d)


@query(
    f"""SELECT bbox_key, round(CASE WHEN ok THEN CASE WHEN a > 0.1 THEN (min_x + max_x) / 2 - (max_x - min_x) * k / 2 ELSE min_x END END, 6) AS min_x,
  round(CASE WHEN ok THEN CASE WHEN a > 0.1 THEN (min_y + max_y) / 2 - (max_y - min_y) * k / 2 ELSE min_y END END, 6) AS min_y,
  round(CASE WHEN ok THEN CASE WHEN a > 0.1 THEN (min_x + max_x) / 2 + (max_x - min_x) * k / 2 ELSE max_x END END, 6) AS max_x,
  round(CASE WHEN ok THEN CASE WHEN a > 0.1 THEN (min_y + max_y) / 2 + (max_y - min_y) * k / 2 ELSE max_y END END, 6) AS max_y
FROM (SELECT *, (max_x - min_x) * (max_y - min_y) AS a, CASE WHEN (max_x - min_x) * (max_y - min_y) > 0.1 THEN sqrt(0.1 / ((max_x - min_x) * (max_y - min_y))) ELSE 1 END AS k, min_x < max_x AND min_y < max_y AS ok FROM {_PARSED} z) y"""
)
def bbox_adjust(spark: SparkSession, d: str) -> DataFrame:
    rows = _parsed(spark, d).select("bbox_key", geometry.adjust_bbox(*map(F.col, ("min_x", "min_y", "max_x", "max_y"))).alias("b"))
    return rows.select("bbox_key", *[F.round(f"b.{c}", 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


_SCAN = (4.3, 48.2, 4.9, 48.9)


@query(f"SELECT idu, code_parcelle, code_insee FROM (SELECT *, {RING} AS ring FROM parcel_ref) r WHERE {_LO(1)} <= {_SCAN[2]} AND {_HI(1)} >= {_SCAN[0]} AND {_LO(2)} <= {_SCAN[3]} AND {_HI(2)} >= {_SCAN[1]}")
def parcel_bbox_scan(spark: SparkSession, d: str) -> DataFrame:
    r = _rings(spark, d).withColumn("e", geometry.envelope(F.col("ring")))
    meets = geometry.boxes_meet(F.col("e.min_x"), F.col("e.min_y"), F.col("e.max_x"), F.col("e.max_y"), *map(F.lit, _SCAN))
    return r.where(meets).select("idu", "code_parcelle", "code_insee")


@query(
    f"""SELECT idu, contenance FROM (SELECT *, {_LO(1)} AS x0, {_LO(2)} AS y0, {_HI(1)} AS x1, {_HI(2)} AS y1 FROM (SELECT *, {RING} AS ring FROM parcel_ref) p) r
WHERE x0 <= {_SCAN[2]} AND x1 >= {_SCAN[0]} AND y0 <= {_SCAN[3]} AND y1 >= {_SCAN[1]} ORDER BY idu NULLS FIRST, code_parcelle NULLS FIRST, contenance NULLS FIRST LIMIT 100"""
)
def parcel_bbox_first(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred parcels that meet a box, two columns of them: the number asked for is the feature."""
    rows = N.with_envelope(table(spark, d, "parcel_ref", "idu", "code_parcelle", "contenance", "geometry"))
    return N.in_box(rows, _SCAN, ("idu", "contenance"), 100, ("idu", "code_parcelle", "contenance"))


# every commune's envelope and the parcels in it that are its own or name none
_COMMUNE = f"""r AS (SELECT *, {_LO(1)} AS x0, {_LO(2)} AS y0, {_HI(1)} AS x1, {_HI(2)} AS y1 FROM (SELECT *, {RING} AS ring FROM parcel_ref) p),
c AS (SELECT min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d FROM r WHERE code_insee = (SELECT max(code_insee) FROM parcel_ref)),
m AS (SELECT idu, code_parcelle, code_insee FROM r, c WHERE x0 <= c.c AND x1 >= c.a AND y0 <= c.d AND y1 >= c.b AND (coalesce(code_insee, '') = '' OR code_insee = (SELECT max(code_insee) FROM parcel_ref)))"""


def _last_commune(spark: SparkSession, d: str) -> str:
    """The greatest commune code, the argument of a caller; read from the table's statistics."""
    return table(spark, d, "parcel_ref", "code_insee").agg(F.max("code_insee")).first()[0]


@query(f"WITH {_COMMUNE} SELECT * FROM m")
def parcels_by_commune(spark: SparkSession, d: str) -> DataFrame:
    """All parcels of one commune."""
    rows = N.with_envelope(table(spark, d, "parcel_ref", "idu", "code_parcelle", "code_insee", "geometry"))
    return N.of_commune(rows, _last_commune(spark, d), ("idu", "code_parcelle", "code_insee"), None)


@query(f"WITH {_COMMUNE} SELECT * FROM m ORDER BY idu NULLS FIRST, code_parcelle NULLS FIRST, code_insee NULLS FIRST LIMIT 3")
def parcels_by_commune_first(spark: SparkSession, d: str) -> DataFrame:
    """The first three parcels of one commune: the number asked for is the feature."""
    rows = N.with_envelope(table(spark, d, "parcel_ref", "idu", "code_parcelle", "code_insee", "geometry"))
    return N.of_commune(rows, _last_commune(spark, d), ("idu", "code_parcelle", "code_insee"), 3, ("idu", "code_parcelle", "code_insee"))


@query("SELECT verif_id, ord, source FROM verify_parcelle WHERE source = 'notaire'")
def layer_filter(spark: SparkSession, d: str) -> DataFrame:
    """A layer filtered by the value of a column, which reaches the scan."""
    return N.layer(table(spark, d, "verify_parcelle"), {"source": "notaire"}, columns=("verif_id", "ord", "source"), most=None)


@query("SELECT verif_id, ord, source FROM verify_parcelle WHERE source = 'notaire' AND ord = 2 ORDER BY verif_id NULLS FIRST LIMIT 1000")
def layer_first(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand rows of a layer: the number asked for is the feature."""
    return N.layer(table(spark, d, "verify_parcelle", "verif_id", "ord", "source"), {"source": "notaire", "ord": 2}, order=("verif_id",))


@query("SELECT doc_id, 'Basic ' || to_base64(encode(filename || ':' || CAST(doc_id AS VARCHAR))) AS header FROM deeds")
def basic_auth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "deeds", "doc_id", "filename").select("doc_id", F.concat(F.lit("Basic "), geometry.basic_auth(F.col("filename"), F.col("doc_id").cast("string"))).alias("header"))


_BOX_KEY = "doc_id, page_no, box_idx"


@query(f"SELECT {_BOX_KEY}, greatest(0, x - 20) AS x0, greatest(0, y - 20) AS y0, least(1000, x + w + 20) AS x1, least(1200, y + h + 20) AS y1 FROM {BOXES} b")
def box_clamp(spark: SparkSession, d: str) -> DataFrame:
    return B.padded(D.derive(spark, d, D.BOXES), 20, 1000, 1200).select("doc_id", "page_no", "box_idx", "x0", "y0", "x1", "y1")


@query(f"SELECT {_BOX_KEY}, CAST(trunc(x * 2.75) AS INT) AS x, CAST(trunc(y * 2.25) AS INT) AS y, CAST(trunc(w * 2.75) AS INT) AS w, CAST(trunc(h * 2.25) AS INT) AS h FROM {BOXES} b")
def box_scale(spark: SparkSession, d: str) -> DataFrame:
    s = lambda c, k: B.scaled(F.col(c), F.lit(k)).alias(c)
    return D.derive(spark, d, D.BOXES).select("doc_id", "page_no", "box_idx", s("x", 2.75), s("y", 2.25), s("w", 2.75), s("h", 2.25))


@query(f"SELECT * FROM {BOXES} b WHERE w * h >= 500 AND w >= 250 AND h >= 60")
def zone_filter(spark: SparkSession, d: str) -> DataFrame:
    return B.zones(D.derive(spark, d, D.BOXES))


@query(f"SELECT * FROM {TABLES} b WHERE w * h >= 36000 AND w >= 200")
def table_region_filter(spark: SparkSession, d: str) -> DataFrame:
    return B.table_regions(D.derive(spark, d, D.TABLES), 1000, 1200)


@query(
    f"""SELECT b.* FROM {BOXES} b WHERE NOT EXISTS (SELECT 1 FROM {TABLES} t WHERE t.doc_id = b.doc_id AND t.page_no = b.page_no
  AND least(b.x + b.w, t.x + t.w) > greatest(b.x, t.x) AND least(b.y + b.h, t.y + t.h) > greatest(b.y, t.y)
  AND (least(b.x + b.w, t.x + t.w) - greatest(b.x, t.x)) * (least(b.y + b.h, t.y + t.h) - greatest(b.y, t.y)) >= 0.5 * b.w * b.h)"""
)
def zone_table_anti(spark: SparkSession, d: str) -> DataFrame:
    return B.uncovered(D.derive(spark, d, D.BOXES), D.derive(spark, d, D.TABLES))


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y, x, box_idx) - 1 AS INT) AS ord FROM {BOXES} b")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return Y.reading_order(D.derive(spark, d, D.BOXES))


# --- layout of words --------------------------------------------------------------------------------------------------------------
def _sql_join(gap: int, group: str, order: str, source: str) -> str:
    """Text of ordered words: the separator looks at the word before."""
    sep = f"CASE WHEN p IS NULL OR p <= 0 THEN '' WHEN lft - p > {gap} THEN '    ' ELSE ' ' END"
    return f"SELECT {group}, string_agg({sep} || text, '' ORDER BY {order}) AS line FROM (SELECT *, lag(lft + width) OVER (PARTITION BY {group} ORDER BY {order}) AS p FROM {source}) j GROUP BY {group}"


_GROUP = "doc_id, page_no, block_num, par_num, line_num"


@query(_sql_join(50, _GROUP, "lft, word_idx", f"(SELECT * FROM {WORDS} v WHERE trim(text) <> '' AND conf >= 25) w"))
def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    return Y.layout_lines(D.derive(spark, d, D.WORDS))


@query(
    f"""WITH RECURSIVE ws AS (SELECT *, top + height // 2 AS cy FROM {WORDS} v WHERE trim(text) <> '' AND conf >= 20),
h AS (SELECT doc_id, page_no, greatest(list_sort(list(height))[len(list(height)) // 2 + 1] // 2, 10) AS tol FROM ws GROUP BY doc_id, page_no),
o AS (SELECT ws.*, tol, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY cy, lft, word_idx) AS i FROM ws JOIN h USING (doc_id, page_no)),
f AS (SELECT doc_id, page_no, i, cy AS anchor, 0 AS row_no FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.page_no, o.i, CASE WHEN abs(o.cy - f.anchor) > o.tol THEN o.cy ELSE f.anchor END, CASE WHEN abs(o.cy - f.anchor) > o.tol THEN f.row_no + 1 ELSE f.row_no END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.page_no = f.page_no AND o.i = f.i + 1),
r AS (SELECT o.*, f.row_no FROM o JOIN f USING (doc_id, page_no, i))
{_sql_join(40, "doc_id, page_no, row_no", "lft, cy, word_idx", "r")}"""
)
def layout_table_rows(spark: SparkSession, d: str) -> DataFrame:
    return Y.table_rows(D.derive(spark, d, D.WORDS))


# --- pages --------------------------------------------------------------------------------------------------------------------------
_WS = STRIP


def sql_score(x: str) -> str:
    u = f"upper({x})"
    kw = " + ".join(f"(length({u}) - length(replace({u}, '{k}', ''))) // {len(k)}" for k in Y.KEYWORDS)
    rows = rf"len(list_filter(string_split_regex({u}, '{ENDS}'), lambda l: regexp_matches(l, '\b[0-9]{{2,4}}[A-Z]?\b') AND regexp_matches(l, '\bHA\b')))"
    pairs = rf"len(regexp_extract_all({u}, '\b[A-Z]{{1,4}}\s+[0-9]{{1,4}}[A-Z]?\b'))"
    surf = rf"len(regexp_extract_all({u}, '\b[0-9O]+\s*HA\b'))"
    return f"30 * {rows} + 12 * {pairs} + 3 * ({kw}) + 2 * {surf}"


SCORED = f"""scored AS (SELECT *, {sql_score("strip_accents(text)")} AS score, {sql_word_signs("text")} AS alnum FROM (SELECT doc_id, page_no, text, min(pos) AS pos FROM {READINGS} r GROUP BY ALL) x)"""


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return D.derive(spark, d, D.READINGS)


@query(f"SELECT doc_id, page_no, pos, CAST({sql_score('strip_accents(text)')} AS INT) AS score, CAST({sql_word_signs('text')} AS INT) AS alnum FROM {READINGS} r")
def ocr_score(spark: SparkSession, d: str) -> DataFrame:
    # accents are dropped on both sides: the two engines see word boundaries beside them differently
    r = _readings(spark, d)
    s = Y.text_score(text.strip_accents(F.col("text")))
    return r.select("doc_id", "page_no", "pos", s["score"].alias("score"), Y.text_score(F.col("text"))["alnum"].alias("alnum"))


@query(
    f"""WITH s AS (SELECT *, upper(text) AS u FROM (SELECT doc_id, page_no, strip_accents(text) AS text, min(pos) AS pos FROM {READINGS} r GROUP BY ALL) x),
k AS (SELECT *, {sql_score("text")} AS score, len(list_filter(string_split_regex(u, '{ENDS}'), lambda l: regexp_matches(l, '\\b[0-9]{{2,4}}[A-Z]?\\b') AND regexp_matches(l, '\\bHA\\b'))) AS rws,
  len(regexp_extract_all(u, '\\b[A-Z]{{1,4}}\\s+[0-9]{{1,4}}[A-Z]?\\b')) AS prs, {sql_word_signs("text")} AS alnum, len(list_filter(string_split_regex(u, '{ENDS}'), lambda l: {sql_strip("l")} <> '')) AS filled, length(text) AS size FROM s)
SELECT doc_id, page_no, pos, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY score DESC, rws DESC, prs DESC, alnum DESC, filled DESC, size DESC, pos) AS r FROM k) x WHERE r = 1"""
)
def ocr_best(spark: SparkSession, d: str) -> DataFrame:
    return Y.best_text(_readings(spark, d).withColumn("text", text.strip_accents(F.col("text"))))


_LAYOUT = "SELECT DISTINCT doc_id, page_no, CASE WHEN doc_id % 2 = 0 THEN 'ZA 12  LES GRANDS TRIOTS  3 ha' ELSE '  ZA 12 ' END AS layout FROM doc_pages"


@query(
    f"""WITH b AS (SELECT doc_id, page_no, text AS other FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY score DESC, size DESC, pos) AS r FROM (
  SELECT DISTINCT doc_id, page_no, 0 AS pos, 'ZB ' || CAST(page_no AS VARCHAR) AS text, 12 AS score, 4 AS size FROM doc_pages WHERE doc_id % 3 = 0
  UNION SELECT DISTINCT doc_id, page_no, 1 AS pos, 'rien' AS text, 0 AS score, 4 AS size FROM doc_pages) c) x WHERE r = 1)
SELECT doc_id, page_no, CASE WHEN length(trim(layout)) > 20 THEN layout ELSE other END AS text FROM ({_LAYOUT}) l FULL JOIN b USING (doc_id, page_no)"""
)
def table_text_choice(spark: SparkSession, d: str) -> DataFrame:
    keys_ = table(spark, d, "doc_pages", "doc_id", "page_no").distinct()
    layout = keys_.select("doc_id", "page_no", F.when(F.col("doc_id") % 2 == 0, "ZA 12  LES GRANDS TRIOTS  3 ha").otherwise("  ZA 12 ").alias("layout"))
    other = keys_.where("doc_id % 3 = 0").select("doc_id", "page_no", F.lit(0).alias("pos"), F.concat(F.lit("ZB "), F.col("page_no").cast("string")).alias("text"))
    return Y.table_text_choice(layout, other.unionByName(keys_.select("doc_id", "page_no", F.lit(1).alias("pos"), F.lit("rien").alias("text"))))


_ASSEMBLED = f"""SELECT doc_id, string_agg('--- Page ' || CAST(page_no AS VARCHAR) || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no, text) AS text
FROM (SELECT DISTINCT doc_id, page_no, trim(text, {_WS}) AS text FROM doc_pages) p WHERE text <> '' GROUP BY doc_id"""


@query(_ASSEMBLED)
def page_assemble(spark: SparkSession, d: str) -> DataFrame:
    return G.assembled(table(spark, d, "doc_pages"))


_USABLE = """SELECT doc_id, n_pages, n_image_pages, n_image_pages <= n_pages // 2 AS usable FROM (
  SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE n > 0) AS n_image_pages FROM (SELECT doc_id, page_no, max(coalesce(n_images, 0)) AS n FROM doc_pages GROUP BY ALL) p GROUP BY doc_id) q"""


@query(_USABLE)
def digital_usable(spark: SparkSession, d: str) -> DataFrame:
    return G.digital_usable(table(spark, d, "doc_pages", "doc_id", "page_no", "n_images"))


_SKIP = f"CASE WHEN {sql_alnum('text')} <= 300 THEN CASE {' '.join(f'''WHEN contains(lower(text), '{p}') THEN '{p}' ''' for p in G.SKIP_PATTERNS)} END END"


@query(f"SELECT doc_id, page_no, text, {_SKIP} AS reason FROM {SKIPPABLE} s")
def skip_page(spark: SparkSession, d: str) -> DataFrame:
    return D.derive(spark, d, D.SKIPPABLE).select("doc_id", "page_no", "text", G.skip_reason(F.col("text")).alias("reason"))


@query("SELECT CAST(i AS INT) AS pattern_idx, pattern FROM (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(G.SKIP_PATTERNS)) + ") v(i, pattern)")
def skip_patterns(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(G.load_skip_patterns(["# texts of skipped pages", "", *(f"  {p} " for p in G.SKIP_PATTERNS)]), "pattern_idx int, pattern string")


# the cleaned text of a page: its lines numbered, those of bursts and of signs alone gone, blanks after blanks gone
_CLEANED = f"""raws AS (SELECT DISTINCT doc_id, page_no, trim(text, {_WS}) AS raw FROM {SKIPPABLE} s),
l0 AS (SELECT doc_id, page_no, raw, unnest(string_split(raw, chr(10))) AS ln, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM raws WHERE raw IS NOT NULL),
l1 AS (SELECT *, length({sql_strip("ln")}) BETWEEN 1 AND 3 AS short, {sql_strip("ln")} = '' AS blank FROM l0),
l2 AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, page_no, raw, short ORDER BY i) AS island FROM l1),
l3 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no, raw, short, island) AS run FROM l2) x WHERE NOT (short AND run >= 3) AND (blank OR regexp_matches(ln, '[\\pL\\pN]'))),
l4 AS (SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc_id, page_no, raw ORDER BY i), false) AS after_blank FROM l3),
cleaned AS (SELECT doc_id, page_no, raw, string_agg(CASE WHEN blank THEN '' ELSE ln END, chr(10) ORDER BY i) AS text FROM l4 WHERE NOT (blank AND after_blank) GROUP BY ALL)"""
_READ_TWO = f"""two AS (SELECT doc_id, page_no, string_agg(text, chr(10) || chr(10) ORDER BY pos, text) AS readings FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos, text) AS r FROM (SELECT DISTINCT * FROM {READINGS} r WHERE text <> '') x) y WHERE r <= 2 GROUP BY ALL)"""
_DUAL = f"""WITH {_CLEANED}, {_READ_TWO}, pages AS (SELECT DISTINCT doc_id, page_no, trim(text, {_WS}) AS raw, {_SKIP} AS skip FROM {SKIPPABLE} s),
t AS (SELECT doc_id, page_no, string_agg('[TABLEAU DETECTE]' || chr(10) || text || chr(10) || '[FIN TABLEAU]', chr(10) || chr(10) ORDER BY table_no) AS marked, string_agg(text, chr(10) || chr(10) ORDER BY table_no) AS bare FROM {PAGE_TABLES} q GROUP BY ALL),
b AS (SELECT p.doc_id, p.page_no, skip, '--- Page ' || CAST(p.page_no AS VARCHAR) || ' ---' AS head, concat_ws(chr(10) || chr(10), nullif(c.text, ''), marked) AS shown, concat_ws(chr(10) || chr(10), coalesce(nullif(p.raw, ''), two.readings), bare) AS rd
  FROM pages p LEFT JOIN t USING (doc_id, page_no) LEFT JOIN two USING (doc_id, page_no) LEFT JOIN cleaned c ON c.doc_id = p.doc_id AND c.page_no = p.page_no AND c.raw = p.raw),
d AS (SELECT doc_id, page_no, CASE WHEN skip IS NOT NULL THEN head || ' [PAGE IGNORÉE : « ' || skip || ' » détecté]' WHEN shown <> '' THEN head || chr(10) || shown END AS shown,
  CASE WHEN skip IS NULL AND rd <> '' THEN head || chr(10) || rd END AS rd FROM b),
j AS (SELECT doc_id, trim(coalesce(string_agg(shown, chr(10) || chr(10) ORDER BY page_no, shown, rd), ''), {_WS}) AS display_text, trim(coalesce(string_agg(rd, chr(10) || chr(10) ORDER BY page_no, shown, rd), ''), {_WS}) AS a FROM d GROUP BY doc_id)
SELECT doc_id, display_text, CASE WHEN a <> '' THEN a ELSE display_text END AS analysis_text FROM j"""


@query(_DUAL)
def dual_text_assemble(spark: SparkSession, d: str) -> DataFrame:
    return G.dual_texts(D.derive(spark, d, D.SKIPPABLE), D.derive(spark, d, D.PAGE_TABLES), _readings(spark, d))


@query(
    f"""SELECT u.doc_id, CASE WHEN usable AND coalesce(a.text, '') <> '' THEN 'digital' ELSE 'scan' END AS route, CASE WHEN usable AND coalesce(a.text, '') <> '' THEN a.text ELSE t.text END AS text
FROM ({_USABLE}) u LEFT JOIN ({_ASSEMBLED}) a USING (doc_id) LEFT JOIN deeds t USING (doc_id)"""
)
def source_router(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "doc_pages")
    return G.routed(G.assembled(pages), G.digital_usable(pages), table(spark, d, "deeds", "doc_id", "text"))


# --- sinks ----------------------------------------------------------------------------------------------------------------------------
def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared checkpoint folder."""
    import uuid

    from parcelforge.session import checkpoint_dir

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, text FROM deeds WHERE text IS NOT NULL")
def sink_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as files and read again."""
    path = _scratch(spark, "texts")
    sinks.write_texts(table(spark, d, "deeds", "doc_id", "text").where("text is not null"), path)
    return spark.read.format("text").option("wholetext", "true").schema("value string, _key bigint").load(path).select(F.col("_key").alias("doc_id"), F.regexp_replace("value", r"\n\z", "").alias("text"))


def _file_record(spark: SparkSession, d: str) -> DataFrame:
    return files.with_filename(table(spark, d, "deeds", "doc_id", "filename", "text"))


_JSON = """'{"site_code":' || coalesce('"' || site_code || '"', 'null') || ',"document_type":' || coalesce('"' || document_type || '"', 'null') || ',"document_date":' || coalesce('"' || document_date || '"', 'null') || '}'"""


@query(f"SELECT doc_id, {_JSON} AS json FROM ({_FILE}) f")
def sink_json(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines and read again."""
    path, fields = _scratch(spark, "records"), ("site_code", "document_type", "document_date")
    sinks.write_records(_file_record(spark, d).select("doc_id", *fields), path)
    back = spark.read.schema("doc_id bigint, " + ", ".join(f"{f} string" for f in fields)).json(path)
    return back.select("doc_id", sinks.json_text(F.struct(*fields)).alias("json"))


@query(f"SELECT f.doc_id, {_JSON} || chr(10) || repeat('=', 72) || chr(10) || chr(10) || coalesce(t.text, '') AS content FROM ({_FILE}) f JOIN deeds t USING (doc_id)")
def sink_header_text(spark: SparkSession, d: str) -> DataFrame:
    """Records with their texts written as files and read again."""
    path, record = _scratch(spark, "headed"), F.struct("site_code", "document_type", "document_date")
    sinks.write_texts(_file_record(spark, d).select("doc_id", sinks.headed_text(record, F.col("text")).alias("content")), path, text="content")
    back = spark.read.format("text").option("wholetext", "true").schema("value string, _key bigint").load(path)
    return back.select(F.col("_key").alias("doc_id"), F.regexp_replace("value", r"\n\z", "").alias("content"))
