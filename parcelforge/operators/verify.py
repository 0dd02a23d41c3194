"""Parcels of deeds checked against the reference: lookup, verification flags, fallback and degradation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import geometry as G
from parcelforge.functions import keys
from parcelforge.functions.text import null_if_empty


def area_ha(m2: Column) -> Column:
    """Hectares to four places, half to even; null stays null."""
    return F.bround(m2 / 10_000, 4)


def reference_features(ref: DataFrame) -> DataFrame:
    """(p_code, p_section, p_numero, idu, nom_com, contenance, contenance_ha, bbox): one feature for each key, the one loaded
    first; an empty idu or name falls through to the other column that carries it. A feature's bbox is null without coordinates."""
    rows = ref.select(
        keys.norm_insee(F.col("code_insee")).alias("p_code"),
        keys.norm_section(F.col("section")).alias("p_section"),
        keys.norm_numero(F.col("numero")).alias("p_numero"),
        F.struct(
            F.col("loaded_at"),
            F.coalesce(F.col("deleted_at"), F.expr("timestamp'9999-12-31 00:00:00'")).alias("until"),
            F.coalesce(null_if_empty(F.col("idu")), F.col("code_parcelle")).alias("idu"),
            F.coalesce(null_if_empty(F.col("nom_com")), F.col("nom_commune")).alias("nom_com"),
            F.col("contenance"),
            G.bbox_text(G.outer_ring(F.col("geometry.type"), F.col("geometry.coordinates"))).alias("bbox"),
        ).alias("f"),
    ).where("p_code is not null and p_section is not null and p_numero is not null")
    one = rows.groupBy("p_code", "p_section", "p_numero").agg(F.min("f").alias("f"))
    return one.select("p_code", "p_section", "p_numero", "f.idu", "f.nom_com", "f.contenance", area_ha(F.col("f.contenance")).alias("contenance_ha"), "f.bbox")


def lookup(parcels: DataFrame, features: DataFrame, how: str = "left") -> DataFrame:
    """`parcels` (code_insee, section, number ..) joined with their feature on normalised keys."""
    keyed = parcels.withColumns({"k1": keys.norm_insee(F.col("code_insee")), "k2": keys.norm_section(F.col("section")), "k3": keys.norm_numero(F.col("number"))})
    cond = (F.col("k1") == F.col("p_code")) & (F.col("k2") == F.col("p_section")) & (F.col("k3") == F.col("p_numero"))
    return keyed.join(features, cond, how).drop("k1", "k2", "k3")


def verify(parcels: DataFrame, features: DataFrame) -> DataFrame:
    """Every parcel with ign_verified: true with idu, nom_com, contenance_ha, bbox on a hit, false on a miss, null where the
    document has no commune code. Section and number stay as they were found."""
    flag = F.when(F.col("code_insee").isNotNull(), F.col("p_code").isNotNull())
    return lookup(parcels, features).withColumn("ign_verified", flag).drop("p_code", "p_section", "p_numero", "contenance")


def confirmed_or_all(verified: DataFrame) -> DataFrame:
    """Confirmed parcels of each document; where none is confirmed, or none could be checked, all of them. Parcels without a
    document stay. Documents are told apart by an aggregation with a partial step and a join, which a document with very many
    parcels can't overload as it would a window."""
    hits = verified.where("ign_verified").select("doc_id").distinct().withColumn("any_hit", F.lit(True))
    return verified.join(hits, "doc_id", "left").where(F.col("any_hit").isNull() | F.col("ign_verified")).drop("any_hit")


def degrade(verified: DataFrame, failed: Column) -> DataFrame:
    """ign_verified and what came with it set null on all parcels of a document of which any lookup failed."""
    bad = verified.where(F.coalesce(failed, F.lit(False))).select("doc_id").distinct().withColumn("failed", F.lit(True))
    rows = verified.join(bad, "doc_id", "left")
    for c in ("ign_verified", "idu", "nom_com", "contenance_ha", "bbox"):
        rows = rows.withColumn(c, F.when(F.col("failed").isNull(), F.col(c)))
    return rows.drop("failed")


def info_by_idu(asked: DataFrame, features: DataFrame) -> DataFrame:
    """(list_id, ord, idu, ..): parcels of a list of identifiers in their order; misses and identifiers that can't be read drop
    out, the area stays in m²."""
    rows = asked.select("list_id", "ord", F.col("idu").alias("asked"), keys.idu_part(F.col("idu"), 1).alias("code_insee"), keys.idu_part(F.col("idu"), 3).alias("section"), keys.idu_part(F.col("idu"), 4).alias("number"))
    return lookup(rows.where("code_insee is not null"), features, "inner").select("list_id", "ord", "asked", "idu", "nom_com", "contenance", "bbox")
