"""Quantities recorded in different units, brought to square metres.

A text quantity carries its unit, a bare number takes the unit its source used at that time, and a number whose source
names no unit is assigned one by a mixture on the log scale: every unit is the reference distribution of areas shifted by the
unit's known factor, only the weights are fitted, and the posterior tells how sure the choice is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.binding import let, once
from parcelforge.session import cut_lineage

# Square metres of one unit.
FACTORS = {"km2": 1_000_000.0, "ha": 10_000.0, "1000 m2": 1_000.0, "a": 100.0, "ca": 1.0, "m2": 1.0}

# Spellings of the units that occur in texts, longest first within an alternative.
UNIT_SPELLINGS = {
    "km2": r"km\s*2|kilom[eè]tres?\s+carr[eé]s?",
    "ha": r"hectares?|ha",
    "a": r"ares?|a",
    "m2": r"m[eè]tres?\s+carr[eé]s?|m\s*2|centiares?|ca",
}

#: Units a bare number may be in when nothing tells; m2 stands for ca, which has the same size.
CANDIDATES = ("m2", "a", "1000 m2", "ha", "km2")

#: Bins of the log scale: 1/50 of a decade from 10^-8 to 10^12.
BIN, LOW, HIGH = 0.02, -8.0, 12.0
N_BINS = round((HIGH - LOW) / BIN)

#: Posterior below which a fitted unit is uncertain.
SURE = 0.9

_NUM = r"[0-9]+(?:[.,][0-9]+)?"
_SPACE = r"[\s    ]"


def clean_quantity(c: Column) -> Column:
    """Lower case, exponent signs as digits, misread letters o and l as digits where they stand for digits, digit groups joined."""
    s = F.lower(F.translate(c, "²    ", "2    "))
    unit = r"(?=\s*(?:ha\b|a\b|ca\b|hectare|are|centiare|m2|km2))"
    s = F.regexp_replace(s, r"(?<![\p{L}])o(?=[o0-9.,])|(?<=[0-9])o(?![\p{L}])", "0")
    s = F.regexp_replace(s, r"(?<=[0-9])o(?=[0-9o])|(?<![\p{L}0-9])o" + unit, "0")
    s = F.regexp_replace(s, r"(?<=[0-9])o(?![\p{L}])", "0")
    s = F.regexp_replace(s, r"(?<![\p{L}])[li|](?=[0-9])|(?<=[0-9])[li|](?=[0-9]|\s*(?:ha\b|a\b|ca\b))", "1")
    return F.regexp_replace(s, r"(?<=[0-9])" + _SPACE + r"+(?=[0-9]{3}(?![0-9]))", "")


def _number(c: Column) -> Column:
    return F.translate(c, ",", ".").try_cast("double")


def text_area(clean: Column) -> Column:
    """Square metres stated with a unit in a cleaned text, else null. The first statement counts: a repetition in brackets,
    after `soit`, `ou` or `=`, or after a decimal quantity is the same area again."""

    def labelled(s: Column) -> Column:  # `ha : 0 / a : 33 / ca : 19` names the unit before each number
        part = lambda u: F.coalesce(_number(F.regexp_extract(s, rf"(?<![\p{{L}}]){u}\s*[:=]\s*({_NUM})", 1)), F.lit(0.0))
        return part("ha") * FACTORS["ha"] + part("a") * FACTORS["a"] + part("ca")

    def first_statement(s: Column) -> Column:
        head = F.element_at(F.split(s, r"\(|=|\bsoit\b|\bou\b|\bdonc\b|\bc'est", 2), 1)
        return let(head, lambda h: F.when(h.rlike("[0-9]"), h).otherwise(s))

    def terms(s: Column) -> Column:  # (factor, quantity as written) from the largest unit down
        term = lambda u: F.struct(F.lit(FACTORS[u]).alias("f"), F.regexp_extract(s, rf"({_NUM})\s*(?:{UNIT_SPELLINGS[u]})(?!\p{{L}})", 1).alias("n"))
        return F.filter(F.array(*map(term, UNIT_SPELLINGS)), lambda t: t["n"] != "")

    def total(ts: Column) -> Column:  # a decimal quantity ends the statement
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(True).alias("open"))
        step = lambda acc, t: F.struct(
            F.when(acc["open"], acc["sum"] + _number(t["n"]) * t["f"]).otherwise(acc["sum"]).alias("sum"),
            (acc["open"] & ~t["n"].rlike("[.,]")).alias("open"),
        )
        return F.when(F.size(ts) > 0, F.aggregate(ts, start, step, lambda acc: acc["sum"]))

    return F.when(clean.rlike(rf"\b(?:ha|a|ca)\s*[:=]\s*{_NUM}"), labelled(clean)).otherwise(let(let(first_statement(clean), terms), total))


def bare_number(clean: Column) -> Column:
    """The number of a cleaned text that holds nothing else, else null."""
    return _number(F.regexp_extract(clean, rf"^\s*({_NUM})\s*$", 1))


def unit_factor(unit: Column) -> Column:
    """Square metres of a unit's name, null when unknown."""
    u = F.regexp_replace(F.lower(F.trim(F.translate(unit, "²", "2"))), r"\s+", " ")
    out = F.lit(None).cast("double")
    for name, f in FACTORS.items():
        out = F.when(u == name, F.lit(f)).otherwise(out)
    return out


def unit_intervals(source_units: DataFrame) -> DataFrame:
    """(u_source, u_factor, u_from, u_to) with open ends filled; rows of unknown units drop out."""
    return source_units.select(
        F.col("source").alias("u_source"),
        unit_factor(F.col("unit")).alias("u_factor"),
        F.coalesce(F.col("valid_from").cast("timestamp"), F.expr("timestamp'0001-01-01 00:00:00'")).alias("u_from"),
        F.coalesce(F.col("valid_to").cast("timestamp"), F.expr("timestamp'9999-12-31 00:00:00'")).alias("u_to"),
    ).where("u_factor is not null and u_source is not null")


def state_areas(rows: DataFrame, source_units: DataFrame) -> DataFrame:
    """(verif_id, source, number, area): `area` in m² where text or source tells the unit, `number` where a number stays
    without one.

    Null or blank text and null contenance_ha state none; NaN counts as null; a null time meets only units open at both ends;
    where validities overlap the one that began last holds. The join is on the source with the time as a filter:
    source_units is a table of fixed size, and Spark broadcasts it only under its own size threshold.
    """
    ha = F.when(~F.isnan("contenance_ha"), F.col("contenance_ha"))
    said = let(clean_quantity(F.col("contenance")), lambda s: F.struct(text_area(s).alias("area"), bare_number(s).alias("number")))
    base = once(
        rows.select("verif_id", "source", ha.alias("ha"), "contenance", F.coalesce(F.col("verified_at").cast("timestamp"), F.expr("timestamp'9999-12-30 00:00:00'")).alias("t")),
        said=said,
    ).select("verif_id", "source", "t", F.col("said.area").alias("by_text"), F.coalesce("ha", "said.number").alias("number"))
    base = base.where("by_text is not null or number is not null")
    # one row per source: its validities as an array, so no row of the large side is multiplied
    units = unit_intervals(source_units).groupBy("u_source").agg(F.sort_array(F.collect_set(F.struct("u_from", "u_to", "u_factor")), asc=False).alias("spans"))
    holding = F.filter("spans", lambda s: (s["u_from"] <= F.col("t")) & (F.col("t") < s["u_to"]))
    area = F.coalesce("by_text", F.col("number") * F.col("factor"), F.when(F.col("number") == 0, F.lit(0.0)))
    met = base.join(units, base.source == units.u_source, "left").withColumn("factor", F.try_element_at(holding, F.lit(1))["u_factor"])
    return met.select("verif_id", "source", area.alias("area"), "number", F.when(F.col("by_text").isNull(), F.col("factor")).alias("factor"))


def log_bin(c: Column) -> Column:
    """Bin of a positive number on the log scale."""
    return F.least(F.greatest(F.floor((F.log10(c) - LOW) / BIN), F.lit(0)), F.lit(N_BINS - 1)).cast("int")


def fit_weights(base: np.ndarray, bins: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over binned log numbers: weights of CANDIDATES, and the posterior of each bin (bins x units).

    base: probability of each log bin of an area in m². A number in unit u lies log10(factor) below its area, so the
    component of u is the base shifted by that known offset; only the weights move."""
    like = np.empty((len(bins), len(CANDIDATES)))
    for k, u in enumerate(CANDIDATES):
        at = bins + round(math.log10(FACTORS[u]) / BIN)
        like[:, k] = np.where((at >= 0) & (at < N_BINS), base[np.clip(at, 0, N_BINS - 1)], 0.0)
    like += 1e-12
    w = np.full(len(CANDIDATES), 1 / len(CANDIDATES))
    post = like * w
    for _ in range(rounds):
        post = like * w
        post /= post.sum(axis=1, keepdims=True)
        new = (post * counts[:, None]).sum(axis=0) / counts.sum()
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w, post


def smooth(hist: np.ndarray, width: float = 0.08) -> np.ndarray:
    """Histogram over the log bins as a density, smoothed by a Gaussian of `width` decades."""
    k = np.arange(-40, 41) * BIN
    g = np.exp(-0.5 * (k / width) ** 2)
    out = np.convolve(hist.astype(float), g / g.sum(), mode="same")
    return out / out.sum() if out.sum() else np.full(N_BINS, 1 / N_BINS)


def histogram(stated: DataFrame, by: Column) -> dict[int, np.ndarray]:
    """Known areas over the log bins, for each value of `by`; at most N_BINS rows a value come to the driver."""
    out: dict[int, np.ndarray] = {}
    for r in stated.where("area > 0").groupBy(by.alias("by"), log_bin(F.col("area")).alias("bin")).count().collect():
        out.setdefault(r["by"], np.zeros(N_BINS))[r["bin"]] = r["count"]
    return out


def assign_units(left: DataFrame, bases: dict[int, np.ndarray], sure: float = SURE) -> DataFrame:
    """(f_fold, f_source, f_bin, unit_factor, posterior, uncertain): the unit of each log bin of the numbers of `left` (fold, source,
    number), fitted by fold and source on the fold's reference distribution.

    A fitting task gets at most N_BINS rows a source and fold, whatever the input's size."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        _, post = fit_weights(bases[int(pdf["fold"].iloc[0])], pdf["bin"].to_numpy(), pdf["n"].to_numpy(dtype=float))
        best = post.argmax(axis=1)
        p = post[np.arange(len(best)), best]
        return pd.DataFrame({"f_fold": pdf["fold"], "f_source": pdf["source"], "f_bin": pdf["bin"], "unit_factor": [FACTORS[CANDIDATES[i]] for i in best], "posterior": p, "uncertain": p < sure})

    open_rows = left.groupBy("fold", "source", log_bin(F.col("number")).alias("bin")).agg(F.count("*").alias("n"))
    return open_rows.groupBy("fold", "source").applyInPandas(fit, "f_fold int, f_source string, f_bin int, unit_factor double, posterior double, uncertain boolean")


def with_units(left: DataFrame, bases: dict[int, np.ndarray], sure: float = SURE) -> DataFrame:
    """`left` (fold, source, number, ..) with unit_factor, posterior and uncertain. The fitted units have one row a bin and source."""
    fitted, left = assign_units(left, bases, sure), left.withColumn("bin", log_bin(F.col("number")))
    same = left.source.eqNullSafe(fitted.f_source) & (left.bin == fitted.f_bin) & (left.fold == fitted.f_fold)
    return left.join(fitted, same).drop("f_fold", "f_source", "f_bin", "bin")


def common_areas(rows: DataFrame, source_units: DataFrame, sure: float = SURE) -> DataFrame:
    """(verif_id, area_m2, unit_from, posterior, uncertain), one row per verif_id with a stated area.

    Rows delivered twice count once: should their statements differ, the largest area holds with the least posterior. A zero
    quantity is an area of 0; a negative one states none. unit_from is `stated` (text or source) or `fitted` (mixture). The texts are
    read once; what they state is kept. Only a histogram of at most N_BINS rows comes to the driver, and only if a number is left
    without a unit."""
    stated = state_areas(rows, source_units).where("area >= 0 or (area is null and number >= 0)")
    stated = cut_lineage(stated.select("verif_id", "area", F.when(F.col("area").isNull(), F.col("source")).alias("source"), F.when(F.col("area").isNull(), F.col("number")).alias("number")))
    every = stated.where("area is not null").select("verif_id", "area", F.lit(False).alias("fitted"), F.lit(1.0).alias("posterior"))
    left = stated.where("area is null")
    if not left.isEmpty():
        base = smooth(histogram(stated, F.lit(0)).get(0, np.zeros(N_BINS)))
        got = with_units(left.withColumn("fold", F.lit(0)), {0: base}, sure)
        every = every.unionByName(got.select("verif_id", (F.col("number") * F.col("unit_factor")).alias("area"), F.lit(True).alias("fitted"), "posterior"))
    # fixed-width values, so that the aggregation stays in hash tables with a partial step before the shuffle
    return (
        every.groupBy("verif_id")
        .agg(F.max("area").alias("area"), F.max("fitted").alias("fitted"), F.min("posterior").alias("posterior"))
        .select(
            "verif_id",
            F.round("area").cast("bigint").alias("area_m2"),
            F.when(F.col("fitted"), "fitted").otherwise("stated").alias("unit_from"),
            "posterior",
            (F.col("posterior") < sure).alias("uncertain"),
        )
    )


def hidden_units(rows: DataFrame, source_units: DataFrame, folds: int = 3, sure: float = SURE) -> DataFrame:
    """(verif_id, source, factor, unit_factor, posterior, uncertain): every number whose unit its source tells, once with that unit
    hidden: `factor` is the hidden one, `unit_factor` what the mixture assigns.

    The numbers fall into `folds` by a hash of verif_id. Each fold is fitted in turn without its units, on the distribution of all
    areas that texts or the sources of the other folds tell."""
    fold = F.pmod(F.xxhash64("verif_id"), F.lit(folds)).cast("int")
    stated = state_areas(rows, source_units).where("area >= 0").select("verif_id", "source", "area", "factor", "number", fold.alias("fold"))
    stated = cut_lineage(stated.distinct())
    own = histogram(stated.where("factor is not null"), F.col("fold"))
    said = histogram(stated.where("factor is null"), F.lit(0)).get(0, np.zeros(N_BINS))
    bases = {f: smooth(said + sum((h for g, h in own.items() if g != f), np.zeros(N_BINS))) for f in range(folds)}
    hidden = stated.where("factor is not null and number > 0")
    return with_units(hidden, bases, sure).select("verif_id", "source", "factor", "unit_factor", "posterior", "uncertain")
