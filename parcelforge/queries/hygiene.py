"""Queries of the general data-hygiene operators: orphan references, units, packed fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.operators import orphans, packed, units
from parcelforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    checks = table(spark, d, "verify_parcelle", "verif_id", "idu", "code_insee", "section", "numero", "verified_at")
    asked = table(spark, d, "idus", "req_id", "idu", "requested_at")
    kids = orphans.child_refs(checks, "verify_parcelle", "verif_id", "verified_at", "idu", ("code_insee", "section", "numero")).unionByName(
        orphans.child_refs(asked, "idus", "req_id", "requested_at", "idu")
    )
    parents = table(spark, d, "parcel_ref", "code_insee", "section", "numero", "idu", "code_parcelle", "loaded_at", "deleted_at")
    return orphans.orphan_refs(kids, orphans.parent_spans(parents))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_packed(table(spark, d, "deeds", "doc_id", "parcelles"), "doc_id", "parcelles").select("doc_id", "pos", "value").distinct()


def p5_malformed(spark: SparkSession, d: str) -> DataFrame:
    """Fields by how many of their values were parsed only by backtracking."""
    values = packed.split_packed(table(spark, d, "deeds", "doc_id", "parcelles"), "doc_id", "parcelles")
    return values.groupBy("malformed").agg(F.count("*").alias("n_values"), F.max("pos").alias("max_pos"))


def _areas(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "verify_parcelle", "verif_id", "source", "contenance_ha", "contenance", "verified_at")
    return units.common_areas(rows, table(spark, d, "source_units"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _areas(spark, d).select("verif_id", "area_m2")


def p4_uncertain(spark: SparkSession, d: str) -> DataFrame:
    """Areas by the way their unit was found, with how many stay uncertain."""
    return _areas(spark, d).groupBy("unit_from", "uncertain").agg(F.count("*").alias("n_areas"), F.sum("area_m2").alias("sum_m2"))


def _hidden(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "verify_parcelle", "verif_id", "source", "contenance_ha", "contenance", "verified_at")
    got = units.hidden_units(rows, table(spark, d, "source_units"))
    right = (F.col("factor") == F.col("unit_factor")) & ~F.col("uncertain")
    return got.groupBy(F.col("factor").alias("unit_m2")).agg(F.count("*").alias("n_rows"), F.count_if(~F.col("uncertain")).alias("n_sure"), F.count_if(right).alias("n_right"))


def p4_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Numbers whose source tells their unit, fitted with that unit hidden: by true unit, how many, how many surely assigned, how many
    of those rightly."""
    return _hidden(spark, d)


def p4_hidden(spark: SparkSession, d: str) -> DataFrame:
    """The same as (unit_m2, n_rows, accurate): whether at least 0.95 of the surely assigned ones are right, and there are any."""
    return _hidden(spark, d).select("unit_m2", "n_rows", ((F.col("n_sure") > 0) & (F.col("n_right") >= 0.95 * F.col("n_sure"))).alias("accurate"))


_IDU_RE = "^([0-9]{5})[0-9]+([A-Za-z]{1,2})([0-9]{3,4})$"


def _sql_pad(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) < {n} THEN lpad({x}, {n}, '0') ELSE {x} END"


def _sql_key(code: str, section: str, numero: str) -> str:
    return f"{_sql_pad(code, 5)} || '|' || {_sql_pad(section, 2)} || '|' || {_sql_pad(numero, 4)}"


def _sql_idu(x: str) -> str:
    part = lambda k: f"upper(regexp_extract(trim({x}), '{_IDU_RE}', {k}))"
    return f"CASE WHEN regexp_matches(trim({x}), '{_IDU_RE}') THEN {_sql_key(part(1), part(2), part(3))} END"


_P2_SQL = f"""
WITH kids AS (
  SELECT DISTINCT 'verify_parcelle' AS src_table, verif_id AS row_id, 'idu' AS ref, {_sql_idu("idu")} AS key, verified_at AS t
  FROM verify_parcelle WHERE trim(idu) <> ''
  UNION SELECT 'verify_parcelle', verif_id, 'parcel', {_sql_key("trim(code_insee)", "upper(trim(section))", "trim(numero)")}, verified_at
  FROM verify_parcelle WHERE section IS NOT NULL AND numero IS NOT NULL
  UNION SELECT 'idus', req_id, 'idu', {_sql_idu("idu")}, requested_at FROM idus WHERE trim(idu) <> ''),
parents AS (
  SELECT DISTINCT {_sql_key("code_insee", "section", "numero")} AS key, loaded_at AS l, coalesce(deleted_at, TIMESTAMP '9999-12-31') AS u
  FROM parcel_ref),
judged AS (
  SELECT k.src_table, k.row_id, k.ref, k.t, count(p.key) AS n,
    count(*) FILTER (WHERE p.l <= k.t AND k.t < p.u) AS living, count(*) FILTER (WHERE p.l <= k.t) AS begun
  FROM kids k LEFT JOIN parents p ON k.key = p.key GROUP BY ALL),
found AS (
  SELECT src_table, row_id, ref, CASE WHEN n = 0 THEN 'missing' WHEN begun = 0 THEN 'late' ELSE 'deleted' END AS reason,
    strftime(t, '%Y-%m') AS period
  FROM judged WHERE living = 0)
"""

_N = "[0-9]+(?:[.,][0-9]+)?"
_UNIT_SQL = {"km2": "km ?2|kilom[eè]tres? carr[eé]s?", "ha": "hectares?|ha", "a": "ares?|a", "m2": "m[eè]tres? carr[eé]s?|m ?2|centiares?|ca"}

_P4_PARTS = f"""
WITH c AS (SELECT verif_id, source, verified_at AS t, contenance_ha AS ha,
    regexp_replace(replace(lower(contenance), '²', '2'), '[\\s\\x{{00A0}}\\x{{202F}}\\x{{2009}}]+', ' ', 'g') AS s FROM verify_parcelle),
o1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(s, '([0-9])o', '\\1~', 'g'), 'o([0-9])', '~\\1', 'g'), '(^|[^a-zà-ÿ0-9])o( ?(?:ha|a|ca)(?:$|[^a-zà-ÿ]))', '\\1~\\2', 'g') AS z FROM c),
o2 AS (SELECT * EXCLUDE (s, z), regexp_replace(replace(z, '~', '0'), '([0-9]) ([0-9]{{3}})($|[^0-9])', '\\1\\2\\3', 'g') AS s FROM o1),
f AS (SELECT *, string_split_regex(s, '\\(|=|\\bsoit\\b')[1] AS head FROM o2),
g AS (SELECT *, CASE WHEN regexp_matches(head, '[0-9]') THEN head ELSE s END AS one FROM f),
q AS (SELECT *, {", ".join(f"nullif(regexp_extract(one, '({_N}) ?(?:{p})(?:$|[^a-zà-ÿ])', 1), '') AS n{i}" for i, p in enumerate(_UNIT_SQL.values()))},
    {", ".join(f"try_cast(replace(nullif(regexp_extract(s, '(?:^|[^a-zà-ÿ]){u} ?[:=] ?({_N})', 1), ''), ',', '.') AS DOUBLE) AS l{u}" for u in ("ha", "a", "ca"))},
    try_cast(replace(nullif(regexp_extract(s, '^ ?({_N}) ?$', 1), ''), ',', '.') AS DOUBLE) AS bare FROM g),
v AS (SELECT *, CASE WHEN coalesce(lha, la, lca) IS NOT NULL THEN coalesce(lha, 0) * 10000 + coalesce(la, 0) * 100 + coalesce(lca, 0)
    WHEN n0 IS NOT NULL THEN try_cast(replace(n0, ',', '.') AS DOUBLE) * 1000000
    WHEN regexp_matches(n1, '[.,]') THEN try_cast(replace(n1, ',', '.') AS DOUBLE) * 10000
    WHEN regexp_matches(n2, '[.,]') THEN coalesce(CAST(n1 AS DOUBLE), 0) * 10000 + try_cast(replace(n2, ',', '.') AS DOUBLE) * 100
    WHEN coalesce(n1, n2, n3) IS NOT NULL THEN coalesce(CAST(n1 AS DOUBLE), 0) * 10000 + coalesce(CAST(n2 AS DOUBLE), 0) * 100 + coalesce(try_cast(replace(n3, ',', '.') AS DOUBLE), 0) END AS said,
    coalesce(ha, bare) AS num, CASE (SELECT max(unit) FROM source_units u WHERE u.source = q.source AND (valid_from IS NULL OR valid_from <= t) AND (valid_to IS NULL OR t < valid_to))
      WHEN 'ha' THEN 10000 WHEN 'a' THEN 100 WHEN '1000 m2' THEN 1000 ELSE 1 END AS factor FROM q),
w AS (SELECT *, num * factor AS given FROM v)
"""
_P4_SQL = _P4_PARTS + """SELECT verif_id, CAST(round(max(coalesce(said, given))) AS BIGINT) AS area_m2 FROM w WHERE coalesce(said, given) IS NOT NULL GROUP BY verif_id"""
_P4_HIDDEN_SQL = (
    _P4_PARTS
    + """SELECT CAST(factor AS DOUBLE) AS unit_m2, count(*) AS n_rows, true AS accurate
    FROM (SELECT DISTINCT verif_id, source, num, factor, said FROM w) x WHERE said IS NULL AND num > 0 GROUP BY factor"""
)

_QUOTES = '"(?:[^"]|"")*"|«[^»]*»'
_P5_SQL = f"""
WITH c AS (SELECT DISTINCT doc_id, parcelles, array_to_string(list_transform(regexp_extract_all(parcelles, '{_QUOTES}|[^"«]+'),
    lambda x: CASE WHEN x[1] IN ('"', '«') THEN x ELSE regexp_replace(x, '(^|\\s)et(\\s|$)', '\\1;\\2', 'g') END), '') AS s FROM deeds WHERE parcelles IS NOT NULL),
l AS (SELECT doc_id, list_filter(list_transform(
    regexp_extract_all(s, '(?:{_QUOTES}|[0-9]+(?:[,./+][0-9]+)+|\\([^()]*\\)|[^,;|/+\\t\\n"«])+'), lambda x: trim(x)),
    lambda x: trim(x, ' "«»') <> '') AS ws FROM c),
n AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM l)
SELECT DISTINCT doc_id, CAST(pos AS INT) AS pos, CASE WHEN regexp_full_match(w, '"(?:[^"]|"")*"') THEN trim(replace(w[2:-2], '""', '"')) WHEN regexp_full_match(w, '«[^»]*»') THEN trim(w[2:-2]) ELSE w END AS value FROM n"""

QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p4_found": p4_found,
    "p4_uncertain": p4_uncertain,
    "p4_accuracy": p4_accuracy,
    "p4_hidden": p4_hidden,
    "p5_found": p5_found,
    "p5_malformed": p5_malformed,
}
ORACLES: dict[str, str] = {
    "p2_found": _P2_SQL + "SELECT * FROM found",
    "p4_found": _P4_SQL,
    "p4_hidden": _P4_HIDDEN_SQL,
    "p5_found": _P5_SQL,
    "p2_report": _P2_SQL + "SELECT src_table, period, ref, reason, count(*) AS n_refs FROM found GROUP BY ALL",
}
