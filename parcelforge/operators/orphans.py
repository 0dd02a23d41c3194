"""References to records that do not exist at the time of the reference.

Parent and child keys are put in long form, tagged, and grouped by key and month in one partial aggregation; a running
summary over the months of a key (few rows however many references it has) tells which groups lack a living parent. Only the
references of such groups are looked at one by one, against the lives that begin in their month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions import keys

#: End of a record that still lives.
FOREVER = "timestamp'9999-12-31 00:00:00'"


def child_refs(df: DataFrame, src_table: str, row_id: str, time: str, idu: str, parts: tuple[str, str, str] | None = None) -> DataFrame:
    """(src_table, row_id, ref, key, t) of every reference a row makes: `idu` where it is not blank, `parcel` where section and
    number are not null. A key that can't be read is null."""
    both = [F.struct(F.lit("idu").alias("ref"), keys.idu_key(F.col(idu)).alias("key"), (F.length(keys.trim_all(F.col(idu))) > 0).alias("there"))]
    if parts:
        code, section, numero = parts
        both.append(F.struct(F.lit("parcel").alias("ref"), keys.parcel_key(*map(F.col, parts)).alias("key"), (F.col(section).isNotNull() & F.col(numero).isNotNull()).alias("there")))
    rows = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(time).cast("timestamp").alias("t"), F.explode(F.array(*both)).alias("r"))
    return rows.where("r.there").select(F.lit(src_table).alias("src_table"), "row_id", F.col("r.ref").alias("ref"), F.col("r.key").alias("key"), "t")


def parent_spans(df: DataFrame) -> DataFrame:
    """(ref, key, t, until) of every parent row under both kinds of key: it lives from t (included) to until (excluded). A row
    without loaded_at lives from the start of time; rows whose end is not after their start count as loaded, never living."""
    packed = F.coalesce(F.nullif(keys.trim_all(F.col("idu")), F.lit("")), F.col("code_parcelle"))
    by_parts = keys.parcel_key(F.col("code_insee"), F.col("section"), F.col("numero"))
    both = F.array(
        F.struct(F.lit("idu").alias("ref"), F.coalesce(keys.idu_key(packed), by_parts).alias("key")),
        F.struct(F.lit("parcel").alias("ref"), F.coalesce(by_parts, keys.idu_key(packed)).alias("key")),
    )
    t = F.coalesce(F.col("loaded_at").cast("timestamp"), F.expr("timestamp'0001-01-01 00:00:00'"))
    until = F.coalesce(F.col("deleted_at").cast("timestamp"), F.expr(FOREVER))
    return df.select(t.alias("t"), F.greatest(t, until).alias("until"), F.explode(both).alias("r")).where("r.key is not null").select("r.ref", "r.key", "t", "until")


def _month(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c)).cast("int")


def orphan_refs(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(src_table, row_id, ref, reason, period) of every reference without a living parent at its time, without repeats.

    reason: `missing` (no parent row of the key at all, or a key that can't be read), `late` (all parent rows start after the
    reference), `deleted` (the rest). period: month of the reference as YYYY-MM, null where its time is null; such a reference
    is an orphan only if its key is missing.

    Skew: a key with a third of all references shrinks to one row a month before the first shuffle. The join back is on key and
    month with one row a group on the right, which AQE's skew join splits; no group of references is collected or ordered. Where
    parents of a key start in the month, their different lives come as an array of that row and each reference looks them up in it;
    the array grows with how often one record is loaded anew in a month, not with its references."""
    kids = children.withColumn("m", F.coalesce(_month(F.col("t")), F.lit(0)))
    unread = kids.where("key is null").select("src_table", "row_id", "ref", F.lit("missing").alias("reason"), "t")
    kids = kids.where("key is not null")
    spans = parents.withColumn("m", _month(F.col("t")))

    long = kids.select("ref", "key", "m", F.lit(1).alias("child"), F.lit(None).cast("timestamp").alias("until")).unionByName(
        spans.select("ref", "key", "m", F.lit(0).alias("child"), "until")
    )
    groups = long.groupBy("ref", "key", "m").agg(F.max("child").alias("child"), F.max("until").alias("until"))
    by_key = Window.partitionBy("ref", "key")
    before = by_key.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "ref", "key", "m", "child",
        F.col("until").isNotNull().alias("starts"),
        F.max("until").over(before).alias("carry"),
        F.max("until").over(by_key).isNotNull().alias("any"),
    )
    # a parent that lives for good before the month makes every reference of the month sound
    suspect = groups.where(f"child = 1 and (carry is null or carry < {FOREVER}) and not (m = 0 and any)")

    key = ["ref", "key", "m"]
    starting = spans.groupBy(*key, "t").agg(F.max("until").alias("until")).join(suspect.where("starts").select(*key), key, "left_semi")
    lives = starting.groupBy(*key).agg(F.collect_list(F.struct("t", "until")).alias("lives"))
    right = suspect.select(*key, "carry", "any").join(lives, key, "left")
    met = kids.join(right, key)
    begun = F.array_max(F.transform(F.filter("lives", lambda s: s["t"] <= F.col("t")), lambda s: s["until"]))
    met = met.withColumn("last", F.greatest("carry", begun)).where("last is null or t >= last")
    reason = F.when(~F.col("any"), "missing").when(F.col("last").isNull(), "late").otherwise("deleted")
    met = met.select("src_table", "row_id", "ref", reason.alias("reason"), "t")

    every = unread.unionByName(met)
    return every.select("src_table", "row_id", "ref", "reason", F.date_format("t", "yyyy-MM").alias("period")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """(src_table, period, ref, reason, n_refs): orphans by table and month."""
    return found.groupBy("src_table", "period", "ref", "reason").agg(F.count("*").alias("n_refs"))
