"""Freely entered names mapped to a canonical list, SQL only.

A candidate is cut into words, every run of words is a span, and a span matches a list entry if their folded spellings are
within k edits, k growing with the entry's length. Pairs are found by the pigeonhole: an entry cut into k + 1 segments keeps at
least one segment whole under k edits, and that segment can have moved only so far. So entries are indexed by (length, segment
number, segment), spans probe with the substrings at the positions a segment may have, and only pairs that meet in this equality
join are verified with levenshtein.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.binding import once
from parcelforge.functions.text import strip_accents
from parcelforge.operators.joins import bounded
from parcelforge.session import cut_lineage

# Abbreviations of words in place names.
ABBREVIATIONS = {"st": "saint", "ste": "sainte", "s": "sur", "ss": "sous", "gd": "grand", "gde": "grande", "pt": "petit", "pte": "petite", "vx": "vieux", "nd": "notredame"}

# Words that stand round a name without being part of it.
SURROUNDINGS = (
    "commune communes ville mairie maire territoire village la le les l de du des d a au en et section sections za chef lieu representee par son sa ladite dite"
    " departement canton"
).split()

# Signs that scanning mistakes for one another, folded alike on both sides.
LOOKALIKES = ("0156894", "olsebga")
LOOKALIKE_RUNS = (("iii", "iu"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("c", "e"))

#: Edits allowed, by the folded length of the entry: below 6 none but 1, then 2, 3, 4.
EDITS = ((11, 4), (8, 3), (6, 2), (0, 1))
MAX_EDITS = EDITS[0][1]
#: Edits allowed where the candidate holds other words than surroundings and numbers beside the span: by the entry's length.
STRAY_EDITS = ((8, 1), (0, 0))
#: Characters of a spelling that folding makes one of, at most; with the longest entry it bounds the words of a span.
FOLDED_RUN = 2


def edits_of(length: Column, table: tuple[tuple[int, int], ...] = EDITS) -> Column:
    out = F.lit(table[-1][1])
    for least, k in reversed(table[:-1]):
        out = F.when(length >= least, k).otherwise(out)
    return out


def words(c: Column) -> Column:
    """Array of lower-case words without accents, abbreviations written out."""
    s = F.lower(strip_accents(c))
    s = F.regexp_replace(s, r"['’`]", " ")
    s = F.regexp_replace(s, r"/", " sur ")
    s = F.regexp_replace(s, r"\bs[\s.-]*sur\b", "sur")
    raw = F.filter(F.split(s, r"[^a-z0-9]+"), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.transform(raw, lambda w: F.coalesce(F.try_element_at(table, w), w))


def fold(c: Column) -> Column:
    """Spelling in which signs that scanning confuses are the same."""
    out = F.when(c.rlike("[a-z]"), F.translate(c, *LOOKALIKES)).otherwise(c)
    for a, b in LOOKALIKE_RUNS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def entries(reference: DataFrame) -> DataFrame:
    """(e_id, e_code, e_dep, e_key, e_fold, e_len, e_k) of each list entry with a name; e_id is its place in the list."""
    key = F.array_join(words(F.col("nom")), "")
    rows = reference.select(F.col("list_pos").cast("bigint").alias("e_id"), F.col("code").alias("e_code"), F.col("dep").alias("e_dep"), key.alias("e_key"), fold(key).alias("e_fold"))
    return rows.where("e_fold <> '' and e_code is not null").withColumn("e_len", F.length("e_fold")).withColumn("e_k", edits_of(F.col("e_len")))


def segment_start(length: Column, k: Column, i: Column) -> Column:
    """1-based start of segment i (from 1) when `length` is cut into k + 1 pieces, the longer ones last."""
    base, extra = F.floor(length / (k + 1)), length % (k + 1)
    return (i - 1) * base + F.greatest(F.lit(0), (i - 1) - (k + 1 - extra)) + 1


def segment_length(length: Column, k: Column, i: Column) -> Column:
    base, extra = F.floor(length / (k + 1)), length % (k + 1)
    return base + F.when(i > k + 1 - extra, 1).otherwise(0)


def segment_index(ents: DataFrame) -> DataFrame:
    """(e_id, p_len, p_seg, p_text): the k + 1 segments of each entry."""
    i = F.explode(F.sequence(F.lit(1), F.col("e_k") + 1)).alias("p_seg")
    rows = ents.select("e_id", "e_fold", "e_len", "e_k", i)
    start, size = segment_start(F.col("e_len"), F.col("e_k"), F.col("p_seg")), segment_length(F.col("e_len"), F.col("e_k"), F.col("p_seg"))
    return rows.select("e_id", F.col("e_len").alias("p_len"), "p_seg", F.substring("e_fold", start.cast("int"), size.cast("int")).alias("p_text"))


def probe_plan(spark, longest: int) -> DataFrame:
    """(n, p_len, p_seg, pos, size): the substrings that a span of n characters probes with. At most about
    9 x 5 x 5 rows for each n up to `longest` + MAX_EDITS, so its size is set by the longest entry."""
    n = spark.range(1, longest + MAX_EDITS + 1).select(F.col("id").cast("int").alias("n"))
    rows = n.select("n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - MAX_EDITS), F.least(F.lit(longest), F.col("n") + MAX_EDITS))).alias("p_len"))
    rows = rows.withColumn("k", edits_of(F.col("p_len"))).where("abs(n - p_len) <= k")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("k") + 1)).alias("p_seg"))
    rows = rows.withColumn("start", segment_start(F.col("p_len"), F.col("k"), F.col("p_seg")).cast("int")).withColumn("size", segment_length(F.col("p_len"), F.col("k"), F.col("p_seg")).cast("int"))
    shift, before, after = F.col("n") - F.col("p_len"), F.col("p_seg") - 1, F.col("k") + 1 - F.col("p_seg")
    # at most i - 1 edits lie before segment i, or at most k + 1 - i after it
    low = F.greatest(F.lit(1), F.col("start") - before, F.col("start") + shift - after)
    high = F.least(F.col("n") - F.col("size") + 1, F.col("start") + before, F.col("start") + shift + after)
    rows = rows.withColumn("low", low).withColumn("high", high).where("low <= high and size > 0")
    return rows.select("n", "p_len", "p_seg", F.explode(F.sequence("low", "high")).alias("pos"), "size")


def name_spans(keys: DataFrame, least: int, longest: int) -> DataFrame:
    """(key_id columns.., s_key, s_fold, n, stray) of every run of words that folds to least .. longest + MAX_EDITS characters; stray:
    words beside it that are no surroundings. A word has a character at least, so longer runs of words need not be tried."""
    most = FOLDED_RUN * (longest + MAX_EDITS)
    at = F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at")
    rows = keys.where("size(w) > 0").select("*", at).select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - F.col("at") + 1))).alias("many"))
    rows = once(rows, s_key=F.array_join(F.slice("w", F.col("at"), F.col("many")), "")).where((F.length("s_key") >= least) & (F.length("s_key") <= most))
    rows = once(rows, s_fold=fold(F.col("s_key")))
    beside = F.concat(F.slice("w", F.lit(1), F.col("at") - 1), F.slice("w", F.col("at") + F.col("many"), F.size("w")))
    rows = rows.withColumn("stray", F.exists(beside, lambda x: ~x.isin(SURROUNDINGS) & ~x.rlike("^[0-9]+$")))
    return rows.withColumn("n", F.length("s_fold")).where((F.col("n") >= least) & (F.col("n") <= longest + MAX_EDITS)).drop("w", "at", "many")


def near_entries(spellings: DataFrame, ents: DataFrame, longest: int) -> DataFrame:
    """(s_fold, e_id, lev) of every pair of a folded spelling (s_fold, n) and an entry within the entry's edits."""
    probes = spellings.join(bounded(probe_plan(ents.sparkSession, longest)), "n").withColumn("p_text", F.expr("substring(s_fold, pos, size)"))
    met = probes.join(bounded(segment_index(ents)), ["p_len", "p_seg", "p_text"]).select("s_fold", "e_id").distinct()
    met = once(met.join(bounded(ents), "e_id"), lev=F.levenshtein("s_fold", "e_fold", MAX_EDITS))
    return met.where((F.col("lev") >= 0) & (F.col("lev") <= F.col("e_k"))).select("s_fold", "e_id", "lev")


def map_names(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """(cand_id, code) of every non-blank candidate, code = `unmatched` where no entry is near enough.

    candidates(cand_id, candidate, dep), reference(nom, code, dep, list_pos). Among the entries found, the longest with the
    fewest edits wins; ties go to the row's department (or one named in brackets or by a code in the candidate), then to the order
    of the list. Null and blank candidates give no row; repeated rows give one; an empty list leaves all unmatched.

    Scale: equal candidates are mapped once (partial aggregation absorbs a name that holds a third of the rows), and equal spellings
    within them are looked up once; the joins with
    the list are map-side only behind a count of the list, the last join back to the rows has one row a name on the right, so
    AQE splits a hot name's rows."""
    spark = candidates.sparkSession
    rows = candidates.where(F.length(F.trim(F.regexp_replace("candidate", r"(?U)\s+", " "))) > 0)
    ents = entries(reference)
    size = ents.agg(F.min("e_len").alias("a"), F.max("e_len").alias("b")).first()
    if size["b"] is None:
        return rows.select("cand_id", F.lit("unmatched").alias("code")).distinct()
    least, longest = max(1, size["a"] - MAX_EDITS), size["b"]

    keyed = rows.select("cand_id", "candidate", F.coalesce("dep", F.lit("")).alias("dep"))
    names = keyed.select("candidate", "dep").distinct()
    hint = F.coalesce(
        F.nullif("dep", F.lit("")),
        F.nullif(F.regexp_extract("candidate", r"\(\s*([0-9]{2}|2[AB])\s*\)", 1), F.lit("")),
        F.nullif(F.regexp_extract("candidate", r"(?<![0-9])([0-9]{2})[0-9]{3}(?![0-9])", 1), F.lit("")),
    )
    names = names.withColumn("hint", hint).withColumn("said", F.nullif(F.regexp_extract("candidate", r"(?<![0-9])([0-9]{5})(?![0-9])", 1), F.lit(""))).withColumn("w", words(F.col("candidate")))
    name = ["candidate", "dep", "hint", "said"]
    ents_b = bounded(ents)

    spans = name_spans(names.select(*name, "w"), least, longest)
    near = cut_lineage(near_entries(spans.select("s_fold", "n").distinct(), ents, longest))
    allowed = F.when(F.col("stray"), edits_of(F.col("e_len"), STRAY_EDITS)).otherwise(F.col("e_k"))
    met = spans.join(bounded(near, 500_000), "s_fold").join(ents_b, "e_id").where(F.col("lev") <= allowed)
    # one long orders them: length against edits, exact spelling, code and department named, place in the list
    score = F.col("e_len") - 3 * F.col("lev")
    exact = F.least(F.levenshtein("s_key", "e_key"), F.lit(15))
    rank = (
        (score + 64).cast("bigint") * (1 << 52)
        + (15 - exact).cast("bigint") * (1 << 48)
        + F.coalesce((F.col("said") == F.col("e_code")).cast("bigint"), F.lit(0)) * (1 << 46)
        + F.coalesce((F.col("hint") == F.col("e_dep")).cast("bigint"), F.lit(0)) * (1 << 45)
        + (F.lit((1 << 40) - 1) - F.col("e_id"))
    )
    best = met.groupBy("candidate", "dep").agg(F.max(rank).alias("rank")).withColumn("e_id", F.lit((1 << 40) - 1) - F.col("rank") % (1 << 40))
    found = best.join(ents_b.select("e_id", "e_code"), "e_id").select("candidate", "dep", F.col("e_code").alias("code"))
    none = names.select("candidate", "dep").join(found, ["candidate", "dep"], "left_anti").withColumn("code", F.lit("unmatched"))
    mapping = found.unionByName(none)
    return keyed.join(mapping, ["candidate", "dep"]).select("cand_id", "code").distinct()
