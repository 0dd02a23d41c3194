"""The whole record of a deed: file name, act, commune and checked parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.files import detected_act, with_filename
from parcelforge.operators import communes as C
from parcelforge.operators import lines as L
from parcelforge.operators import parcels as P
from parcelforge.operators import verify as V
from parcelforge.session import cut_lineage


def document_records(deeds: DataFrame, communes: DataFrame, reference: DataFrame) -> DataFrame:
    """(doc_id, site_code, document_type, document_date, source_filename, document_type_label, commune, code_insee,
    cadastral_parcels) of every deed.

    The file name's act type holds before the text's, the label comes from the text alone. A matched commune's official name
    replaces the raw one; an unmatched one keeps a null code, and its parcels stay unchecked. Null texts give a record without
    commune and parcels."""
    code, label = detected_act(F.coalesce("text", F.lit("")))
    docs = with_filename(deeds.select("doc_id", "filename", "text")).withColumn("document_type", F.coalesce("document_type", code)).withColumn("document_type_label", label)
    texts = deeds.select("doc_id", "text").where("text is not null")
    raw = cut_lineage(C.document_communes(L.text_lines(texts)))  # one short row a document, read by the matching and the record
    names = C.match_names(raw, communes.where(F.col("dep").isin(*C.DEPARTMENTS)))
    named = cut_lineage(raw.join(names, "candidate", "left").select("doc_id", F.coalesce("nom", "candidate").alias("commune"), F.col("code").alias("code_insee")))
    parcels = P.document_parcels(texts).join(named.select("doc_id", "code_insee"), "doc_id", "left")
    checked = V.verify(parcels, V.reference_features(reference))
    one = F.struct("ord", "section", "number", "ign_verified", "idu", "nom_com", "contenance_ha", "bbox")
    # the parcels of a record stand in one row anyway, so the confirmed ones are chosen there
    nested = checked.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("ps"))
    kept = F.when(F.exists("ps", lambda p: p["ign_verified"]), F.filter("ps", lambda p: p["ign_verified"])).otherwise(F.col("ps"))
    nested = nested.select("doc_id", F.transform(kept, lambda p: p.dropFields("ord")).alias("cadastral_parcels"))
    out = docs.join(named, "doc_id", "left").join(nested, "doc_id", "left")
    empty = F.array().cast(nested.schema["cadastral_parcels"].dataType)
    return out.select("doc_id", "site_code", "document_type", "document_date", "source_filename", "document_type_label", "commune", "code_insee", F.coalesce("cadastral_parcels", empty).alias("cadastral_parcels"))
