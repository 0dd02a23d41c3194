"""Inputs derived from the tables by SQL that reads alike in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelforge.sources.tables import table

_K, _K2, _NL = "CAST(doc_id % 97 + 1 AS STRING)", "CAST(doc_id * 7 % 900 AS STRING)", "chr(10)"


def _text(*lines: str) -> str:
    return " || ".join(f"{_NL} || {x}" for x in lines)


# Deeds with the wordings of all extraction rules, by the number of the deed.
DEED_TEXTS = f"""
SELECT doc_id, filename, coalesce(text, '') || CASE doc_id % 8
  WHEN 1 THEN {_text("'Références cadastrales'", "'Section Parcelle Lieudit Surface'", f"'ZW ' || {_K} || ' LES TRIOTS 4 ha 09 a'", f"'A ' || {_K2} || ' LES BOIS'", "'TOTAL DE LA SURFACE'", "'ZX 99 HORS CONTEXTE'")}
  WHEN 2 THEN {_text("'[TABLEAU DETECTE]'", f"'078 ZA ' || {_K} || ' LA FONTAINE 15,6790 ha'", f"'B ' || {_K2} || ' PRE'", f"'079 AV ' || {_K2} || ',3500 ha'", "'[FIN TABLEAU]'", "'ZY 11 APRES'")}
  WHEN 3 THEN {_text(f"'les parcelles ZA' || {_K} || ', ZB' || {_K2} || ' et BS55 ainsi que A1 / A2'")}
  WHEN 4 THEN {_text(f"'soit B' || {_K} || ' / B' || {_K2} || ' / ZS10 et ZS19'")}
  WHEN 5 THEN {_text(f"'parcelle cadastrée A ' || {_K} || ', et parcelles cadastrées ZD ' || {_K2}", f"'Section' || chr(160) || 'ZB' || chr(160) || 'n° ' || {_K2}")}
  WHEN 6 THEN {_text("'LA COMMUNE DE'", "' ' || chr(9) || chr(160)", "'Ormoy-sur-Aube - chef-lieu'", "'FIGURANT AU CADASTRE'", f"'C ' || {_K} || ' TERRE'", "''", "'D 12 ENCORE'", "''", "''", "'E 13 PERDU'")}
  WHEN 7 THEN {_text("'BAIL'", "'  EMPHYTEOTIQUE AU CONSERVATOIRE'", "'Article 2 - Références cadastrales'", f"'ZC ' || {_K} || ' PRES'", "'ARTICLE 3 FIN'", "'ZE 14 NON'", "'[TABLEAU DETECTE]'", "'x'", "'..'", "'[FIN TABLEAU]'")}
  ELSE '' END AS text
FROM {{deeds}}
"""

# Recognised words, one page an order.
WORDS = """
SELECT doc_id, 1 AS page_no, word_idx, text, conf, 1 + CAST(word_idx % 2 AS INT) AS block_num, 1 AS par_num, line_num, lft, top, width, height FROM (
  SELECT l_orderkey AS doc_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS INT) AS word_idx,
    CASE WHEN l_partkey % 11 = 0 THEN '  ' ELSE 'W' || CAST(l_partkey % 1000 AS STRING) END AS text,
    CAST(l_suppkey % 100 AS INT) AS conf, CAST(1 + l_partkey % 2 AS INT) AS line_num, CAST(l_partkey * 7 % 900 AS INT) AS lft,
    CAST(l_suppkey * 13 % 60 AS INT) AS top, CAST(20 + l_partkey % 60 AS INT) AS width, CAST(10 + l_partkey % 25 AS INT) AS height
  FROM {lineitem}) w
"""

# Boxes of text and of tables on pages of 1 000 x 1 200 pixels.
BOXES = """
SELECT l_orderkey AS doc_id, 1 AS page_no,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS INT) AS box_idx,
  CAST(l_partkey % 800 AS INT) AS x, CAST(l_suppkey * 7 % 900 AS INT) AS y, CAST(l_partkey * 3 % 600 + 10 AS INT) AS w, CAST(l_suppkey % 200 + 5 AS INT) AS h
FROM {lineitem}
"""
TABLES = """
SELECT o_orderkey AS doc_id, 1 AS page_no, 1 AS box_idx, CAST(o_custkey % 400 AS INT) AS x, CAST(o_orderkey % 500 AS INT) AS y,
  CAST(o_custkey * 3 % 700 + 20 AS INT) AS w, CAST(o_orderkey * 7 % 600 + 10 AS INT) AS h
FROM {orders}
"""

# Several readings of each page of a deed.
READINGS = """
SELECT doc_id, page_no, 0 AS pos, text FROM {doc_pages} WHERE text IS NOT NULL
UNION SELECT doc_id, page_no, 1 AS pos, upper(text) AS text FROM {doc_pages} WHERE text IS NOT NULL
UNION SELECT doc_id, page_no, 2 AS pos, text || chr(13) || 'Section ZA_12 12 3 ha 40' || chr(13) || '___' AS text FROM {doc_pages} WHERE text IS NOT NULL AND doc_id % 3 = 0
"""

# Tables on the pages of deeds, and pages with the wording of some that are skipped.
PAGE_TABLES = "SELECT DISTINCT doc_id, page_no, 1 AS table_no, 'ZA ' || CAST(doc_id % 90 + 1 AS STRING) || ' 1 ha' AS text FROM {doc_pages} WHERE (doc_id + page_no) % 4 = 0"
SKIPPABLE = """
SELECT DISTINCT doc_id, page_no, n_images, CASE WHEN (doc_id + page_no) % 7 = 0 THEN 'ANNEXE 1' || chr(10) || 'Plan de situation' WHEN (doc_id + page_no) % 11 = 0 THEN 'Legende' || coalesce(text, '') 
  WHEN (doc_id + page_no) % 5 = 0 THEN '_ 1' || chr(10) || chr(9) || chr(10) || '--' || chr(160) || chr(10) || coalesce(text, '') || chr(10) || 'ab' || chr(10) || 'c' || chr(9) || chr(10) || chr(160) || 'de' ELSE text END AS text
FROM {doc_pages}
"""

BBOX_TEXTS = """
SELECT DISTINCT idu AS bbox_key, CASE contenance % 5 WHEN 0 THEN '4.1,48.2,4.3,48.9' WHEN 1 THEN '4.1,,4.3,48.9' WHEN 2 THEN '1,2,3' WHEN 3 THEN 'a,2,3,4'
  ELSE CAST(contenance % 7 AS STRING) || ', 47.5,' || CAST(contenance % 11 AS STRING) || ',48' END AS bbox
FROM {parcel_ref} WHERE idu <> '' AND contenance IS NOT NULL
"""

_SOURCES = ("deeds", "doc_pages", "lineitem", "orders", "parcel_ref")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in _SOURCES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """The same input as a subquery over views of the tables' names."""
    return "(" + sql.format(**{t: t for t in _SOURCES}).strip() + ")"
