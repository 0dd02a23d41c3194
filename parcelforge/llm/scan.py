"""Scanned pages repaired: running lines, page numbers, broken words and misread characters, in SQL.

Words are compared by anagram values: the value of a word is the sum of the values of its characters, so a confusion of signs
changes it by a known difference. A rare word that holds a misread sign is joined by equality with the frequent word whose value
lies that difference away, the pair is verified at the place of the sign, and corrections are ranked by frequency. Running lines
are edge lines that repeat within a document, or look like such lines, and are made of word pairs that running text doesn't have.
A word broken at the line's end is joined in the spelling the rest of the corpus uses.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.binding import let, once
from parcelforge.functions.text import ACCENTED, BARE
from parcelforge.operators.joins import bounded
from parcelforge.session import cut_lineage

# Signs and the signs that scanning makes of them.
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("a", "@"), ("i", "l"), ("s", "5"), ("o", "0"), ("u", "ii"), ("l", "1"), ("é", "6"), ("d", "cl"),
    ("m", "rn"), ("g", "9"), ("v", "y"), ("b", "6"), ("h", "b"), ("nn", "im"), ("li", "h"), ("ri", "n"), ("cl", "d"), ("E", "F"),
    ("O", "0"), ("S", "5"), ("I", "1"), ("B", "8"), ("A", "@"), ("i", "1"), ("l", "I"), ("g", "q"), ("w", "vv"), ("z", "2"), ("rn", "m"),
)

# Letters that stand for digits in a misread number, and those digits.
NUMBER_SIGNS = ("OolIS|", "001151")

# Classes of signs that scanning confuses, for comparing whole lines.
LINE_SIGNS = ("CFT68BHL1|50QY9@2", "EEEEEEEII" + "ISOOVGAZ")
LINE_RUNS = (("RN", "M"), ("II", "E"), ("U", "E"), ("NN", "M"), ("IM", "M"), ("RI", "N"), ("EI", "D"))

_HYPHENS = "\\-‐­¬"
_HYPHEN_SIGNS = "-‐\u00ad¬"
_SPACES = "\t\r\f\v\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\x85"
_OUTER = ".,;:!?()\\[\\]{}«»\"“”„'’…—–/*" + _HYPHENS
_BROKEN = rf"[\p{{L}}\p{{N}}'’][{_HYPHENS}]$"
_FOLIO = r"(?iU)^[\s\p{Pd}\[\](){}|.·~*]*(?:(?:page|folio|feuillet|pages?|fol\.?|f°|p\.?)\s*)?([0-9]+)\s*(?:(?:/|sur|de|of|von)\s*[0-9]+)?[\s\p{Pd}\[\](){}|·~*]*$"

#: Accented letters go straight to the class of their bare letter.
_BARE_CLASSES = BARE.upper().translate(str.maketrans(*LINE_SIGNS))

#: How often a word must be met to correct others, and how many times oftener than the misread form.
GOOD_WORD, OFTENER = 3, 8
#: A pair of words is running text if it stands inside pages this many times as often as at their edges.
INSIDE = 2
#: Pages of a document on which a line of one or two words must stand at the same edge to be a running line.
SHORT_PAGES = 3


def core(word: Column) -> Column:
    """Word without outer punctuation."""
    return F.regexp_replace(word, f"^[{_OUTER}]+|[{_OUTER}]+$", "")


def spaced(line: Column) -> Column:
    """A line with plain spaces for spaces of any kind, none at its ends."""
    return F.trim(F.translate(line, _SPACES, " " * len(_SPACES)))


def tokens(line: Column) -> Column:
    """Words of a line with plain spaces."""
    return F.filter(F.split(line, " +"), lambda w: w != "")


def anagram_value(word: Column) -> Column:
    """Sum of the values of a word's characters, whatever their order."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda acc, ch: acc + F.xxhash64(ch).bitwiseAND(F.lit((1 << 40) - 1)))


def _signs_folded(upper: Column) -> Column:
    """Accents and misreadings of single signs folded away in one pass."""
    return F.translate(upper, ACCENTED + LINE_SIGNS[0], _BARE_CLASSES + LINE_SIGNS[1])


def without_page_number(line: Column) -> Column:
    return F.regexp_replace(line, "  +[0-9]+$", "")


def line_key(line: Column) -> Column:
    """A line without a page number behind it, misreadings and case folded away."""
    out = _signs_folded(F.regexp_replace(F.upper(without_page_number(line)), " +", " "))
    for a, b in LINE_RUNS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def word_pairs(rows: DataFrame, line: Column) -> DataFrame:
    """`rows` exploded to the pairs of neighbouring words of `line`, folded, numbers alike; `pair` is null for a line of one word. Each
    step is bound to a column of its own, as generators evaluate what they are given as often as it is named."""
    rows = once(rows.withColumn("_line", F.upper(line)), _digits=F.col("_line").rlike("[0-9]"))
    up = F.when(F.col("_digits"), F.regexp_replace("_line", "(?<![A-Z0-9])[0-9OISL]*[0-9][0-9OISL]*(?![A-Z0-9])", "#")).otherwise(F.col("_line"))
    words = F.array_remove(F.split(_signs_folded(up), " "), "")
    rows = once(rows.withColumn("_words", words), _n=F.size("_words")).where("_n > 0")
    zipped = F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", F.lit(2), F.col("_n")).alias("b"))
    rows = rows.drop("_line", "_digits").select("*", F.posexplode(zipped).alias("_i", "_ab")).where("_i = 0 or _ab.b is not null")
    ends = F.lit(".,;:")
    pair = F.when(F.col("_ab.b").isNotNull(), F.concat(F.rtrim(F.col("_ab.a"), ends), F.lit(" "), F.rtrim(F.col("_ab.b"), ends)))
    return rows.withColumn("pair", pair).drop("_words", "_n", "_i", "_ab")


#: What tells one text of a page apart from another under the same number.
PAGE = ["doc_id", "page_no", "h"]


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, h, folios, i, size, n, s, before, next_n, next_s): the non-blank lines of each page but for its folio lines,
    i counting from 0, with the lines before and after; pages of nothing but folio lines have one row without a line. h is the hash of
    the page's text. Nothing is shuffled, and a page's lines are only looked at where it is read."""
    rows = pages.select(F.col("doc_id").cast("bigint"), F.col("page_no").cast("int"), "text").where("doc_id is not null and page_no is not null and text is not null")
    # a look for each odd space is much cheaper than the translation of texts that have none
    odd = reduce(lambda a, b: a | b, [F.contains("text", F.lit(c)) for c in _SPACES])
    text = F.when(odd, F.translate("text", _SPACES, " " * len(_SPACES))).otherwise(F.col("text"))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("n"), F.trim(x).alias("s"))), lambda x: x["s"] != "")
    rows = rows.select("doc_id", "page_no", F.xxhash64("text").alias("h"), F.explode(F.array(lines)).alias("ls")).where("size(ls) > 0")
    size = F.size("ls")

    def folio(at: Column, if_there: Column) -> Column:
        x = F.try_element_at("ls", at)
        number = F.regexp_extract(x["s"], _FOLIO, 1).try_cast("int")
        return F.when(if_there & x["s"].rlike("[0-9]") & (number == F.col("page_no")), x["n"])

    ends = [(F.lit(1), size > 0), (F.lit(2), size > 1), (size, size > 2), (size - 1, size > 3)]
    rows = rows.select(*PAGE, F.explode(F.array(F.array_compact(F.array(*[folio(at, there) for at, there in ends])))).alias("folios"), "ls")
    body = F.when(F.size("folios") == 0, F.col("ls")).otherwise(F.filter("ls", lambda x: ~F.array_contains("folios", x["n"])))
    rows = rows.select(*PAGE, "folios", F.explode(F.array(body)).alias("b"))
    # the line before and the line after stand beside each line
    every = F.size("b")
    no = F.array(F.lit(None).cast(_LINE))
    near = F.arrays_zip(F.col("b").alias("l"), F.concat(no, F.slice("b", F.lit(1), F.greatest(every - 1, F.lit(0)))).alias("p"), F.slice("b", F.lit(2), every).alias("f"))
    rows = rows.select(*PAGE, "folios", every.alias("size"), F.posexplode_outer(near).alias("i", "x"))
    return rows.select(*PAGE, "folios", "i", "size", F.col("x.l.n").alias("n"), F.col("x.l.s").alias("s"), F.col("x.p.s").alias("before"), F.col("x.f.n").alias("next_n"), F.col("x.f.s").alias("next_s"))


_LINE = "struct<n:int,s:string>"


def is_broken(s: Column) -> Column:
    """Whether a line ends within a word; the cheap test goes first."""
    return F.coalesce(F.right(s, F.lit(1)).isin(*_HYPHEN_SIGNS) & F.right(s, F.lit(2)).rlike(_BROKEN), F.lit(False))


def at_edge() -> Column:
    return (F.col("i") == 0) | (F.col("i") == F.col("size") - 1)


def whole_tokens(rows: DataFrame) -> DataFrame:
    """`rows` of lines (s, broken, after_broken) exploded to `token`: what stands between spaces, but for parts of broken words."""
    rows = once(rows, _ws=F.split("s", " "))
    part = F.slice("_ws", F.when(F.col("after_broken"), 2).otherwise(1), F.greatest(F.size("_ws") - F.col("broken").cast("int") - F.col("after_broken").cast("int"), F.lit(0)))
    kept = F.when(F.col("broken") | F.col("after_broken"), part).otherwise(F.col("_ws"))
    return rows.withColumn("token", F.explode(kept)).drop("_ws").where("token <> ''")


def different_pages(pages: DataFrame) -> DataFrame:
    """`pages` without copies of a page's text, as evidence of word pairs."""
    rows = pages.where("doc_id is not null and page_no is not null and text is not null").withColumn("h1", F.xxhash64("text")).withColumn("h2", F.hash("text"))
    first = rows.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"))).alias("k"))
    copied = bounded(cut_lineage(first.where("c > 1").select("h1", "h2", F.col("k.doc_id").alias("d"), F.col("k.page_no").alias("p"))))
    return rows.join(copied, ["h1", "h2"], "left").where("d is null or (d = doc_id and p = page_no)").select("doc_id", "page_no", "text")


def running_lines(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(doc_id, page_no, h, n) of header and footer lines among `edges` (doc_id, page_no, h, n, s, top); `evidence` are page_lines whose
    word pairs tell what is running text.

    A line of several words is a running line if most of its word pairs aren't running text and it comes again in its document or has
    the pairs of lines that do. A line of one or two words must come again on three pages at the same edge."""
    bare = F.when(at_edge(), without_page_number(F.col("s"))).otherwise(F.col("s"))
    met = word_pairs(evidence.where("n is not null").select(at_edge().alias("edge"), bare.alias("s")), F.col("s")).where("pair is not null")
    met = met.groupBy("pair").agg(F.count_if("edge").alias("at_edge"), F.count_if(~F.col("edge")).alias("inside"))
    running_text = met.where((F.col("at_edge") > 0) & (F.col("inside") >= INSIDE * F.col("at_edge"))).select("pair", F.lit(1).alias("in_text"))
    edges = edges.select(*PAGE, "n", "top", line_key(F.col("s")).alias("key"), without_page_number(F.col("s")).alias("s")).distinct()
    pairs = word_pairs(edges, F.col("s")).select(*PAGE, "n", "top", "key", "pair")
    scored = pairs.join(bounded(cut_lineage(running_text), 500_000), "pair", "left").groupBy(*PAGE, "n", "top", "key")
    scored = scored.agg(F.count("pair").alias("pairs"), F.count("in_text").alias("known"), F.collect_list("pair").alias("ps"))
    strange = cut_lineage(scored.where("known * 2 < pairs or pairs = 0"))
    repeated = strange.groupBy("doc_id", "key").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b"), F.min("pairs").alias("pairs")).where("pairs > 1 and a < b").select("doc_id", "key")
    short = strange.where("pairs <= 1").groupBy("doc_id", "key", "top").agg(F.count_distinct("page_no").alias("c")).where(F.col("c") >= SHORT_PAGES).select("doc_id", "key", "top")
    long = strange.where("pairs > 1")
    sure = long.join(repeated, ["doc_id", "key"], "left_semi")
    head_pairs = sure.select(F.explode("ps").alias("pair")).groupBy("pair").agg(F.count("*").alias("c")).where("c >= 2").select("pair", F.lit(1).alias("in_head"))
    rest = long.join(repeated, ["doc_id", "key"], "left_anti").select(*PAGE, "n", F.explode("ps").alias("pair"))
    alike = rest.join(bounded(cut_lineage(head_pairs)), "pair", "left").groupBy(*PAGE, "n").agg(F.count("*").alias("c"), F.count("in_head").alias("h_")).where("h_ * 2 >= c and h_ > 0")
    named = strange.where("pairs <= 1 and key <> ''").join(short, ["doc_id", "key", "top"], "left_semi")
    return sure.select(*PAGE, "n").unionByName(alike.select(*PAGE, "n")).unionByName(named.select(*PAGE, "n")).distinct()


def token_counts(lines: DataFrame) -> DataFrame:
    """(token, word, freq): tokens of the different lines, their cores and frequencies. Copies of a line make its misreadings no more
    frequent."""
    rows = lines.select("s", is_broken(F.col("s")).alias("broken"), is_broken(F.col("before")).alias("after_broken")).where("s is not null").distinct()
    met = whole_tokens(rows).groupBy("token").agg(F.count("*").alias("freq"))
    return met.select("token", core(F.col("token")).alias("word"), "freq").where("word <> ''")


def word_counts(met: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """(word, freq, listed): words with their frequency, and words of the lexicon, listed = 1."""
    both = met.select("word", "freq", F.lit(0).alias("listed"))
    if lexicon is not None:
        names = lexicon.select(F.explode(F.split(lexicon.columns[0], " ")).alias("word")).where("word <> ''").distinct()
        both = both.unionByName(names.select("word", F.lit(0).cast("bigint").alias("freq"), F.lit(1).alias("listed")))
    return both.groupBy("word").agg(F.sum("freq").alias("freq"), F.max("listed").alias("listed"))


def corrections(words: DataFrame) -> DataFrame:
    """(word, right): misread words and the word each most likely was."""
    words = words.where((F.length("word") > 1) & ~F.col("word").rlike(r"^[0-9\p{P}]+$"))
    good = words.where((F.col("freq") >= GOOD_WORD) | (F.col("listed") == 1)).select(F.col("word").alias("right"), F.col("freq").alias("right_freq"), F.col("listed").alias("right_listed"), anagram_value(F.col("word")).alias("value"))
    table = F.array(*[F.struct(F.lit(a).alias("was"), F.lit(b).alias("is"), (anagram_value(F.lit(a)) - anagram_value(F.lit(b))).alias("difference")) for a, b in CONFUSIONS])
    bad = words.where("listed = 0").select("word", "freq", F.explode(F.filter(table, lambda c: F.col("word").contains(c["is"]))).alias("c"))
    bad = bad.select("word", "freq", F.col("c.was").alias("was"), F.col("c.is").alias("is"), (anagram_value(F.col("word")) + F.col("c.difference")).alias("value"))
    at_place = F.exists(
        F.sequence(F.lit(1), F.length("word")),
        lambda p: (F.substring("word", p, F.length("is")) == F.col("is"))
        & (F.concat(F.substring("word", F.lit(1), p - 1), F.col("was"), F.substring("word", p + F.length("is"), F.length("word"))) == F.col("right")),
    )
    odd = F.col("word").rlike(r"[@0-9]") & ~F.col("right").rlike(r"[@0-9]")
    likely = (F.col("right_freq") >= OFTENER * F.col("freq")) | ((odd | (F.col("right_listed") == 1)) & (F.col("right_freq") + F.col("right_listed") >= F.col("freq")))
    met = bad.join(good, "value").where(at_place & likely)
    best = met.groupBy("word").agg(F.max(F.struct("right_freq", "right_listed", "right")).alias("b")).select("word", F.col("b.right").alias("right"))
    # a word misread twice leads to a word misread once, and that to the right one
    again = best.select(F.col("word").alias("right"), F.col("right").alias("further"))
    return best.join(again, "right", "left").select("word", F.coalesce("further", "right").alias("right"))


def joined_words(sparse: DataFrame, heads: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, page_no, h, n, word) of every line whose last word goes on in the next body line, and (doc_id, page_no, h, n, word) of
    the ends of words that stand at the top of a page, on its line n. sparse: rows of page_lines with every broken line and the first
    line of every page."""
    first = lambda s: F.element_at(tokens(s), 1)
    broken = sparse.where(is_broken(F.col("s")))
    broken = broken.select(*PAGE, "n", F.element_at(tokens(F.col("s")), -1).alias("left"), "next_n", first(F.col("next_s")).alias("next_word"))
    broken = broken.join(heads, [*PAGE, "n"], "left_anti")
    head = heads.withColumn("is_head", F.lit(True))
    # the first body word of a page, past a running line
    tops = sparse.where("i = 0").join(head, [*PAGE, "n"], "left")
    tops = tops.select(
        "doc_id", (F.col("page_no") - 1).alias("page_no"), F.col("h").alias("top_h"), F.when(F.col("is_head"), F.col("next_n")).otherwise(F.col("n")).alias("top_n"), F.when(F.col("is_head"), first(F.col("next_s"))).otherwise(first(F.col("s"))).alias("top_word")
    )
    broken = broken.join(head.withColumnRenamed("n", "next_n"), [*PAGE, "next_n"], "left")
    none = F.lit(None)
    inside = broken.where("next_n is not null and is_head is null").select(*PAGE, "n", "left", F.col("next_word").alias("right"), none.cast("bigint").alias("top_h"), none.cast("int").alias("top_n"))
    over = broken.where("next_n is null or is_head").join(tops, ["doc_id", "page_no"]).select(*PAGE, "n", "left", F.col("top_word").alias("right"), "top_h", "top_n")
    both = inside.unionByName(over).where("right is not null")
    stem, tail = core(F.regexp_replace("left", f"[{_HYPHENS}]$", "")), core(F.col("right"))
    both = cut_lineage(both.select(*PAGE, "n", stem.alias("stem"), tail.alias("tail"), "top_h", "top_n"))
    tails = both.where("top_n is not null").select("doc_id", (F.col("page_no") + 1).alias("page_no"), F.col("top_h").alias("h"), F.col("top_n").alias("n"), F.col("tail").alias("word")).distinct()
    both = both.where("stem <> '' and tail <> ''").select(*PAGE, "n", "stem", "tail").distinct()
    spelt = both.select("stem", "tail").distinct().select("stem", "tail", F.explode(F.array(F.struct(F.lit(0).alias("kept"), F.concat("stem", "tail").alias("word")), F.struct(F.lit(1).alias("kept"), F.concat("stem", F.lit("-"), "tail").alias("word")))).alias("w"))
    spelt = spelt.select("stem", "tail", "w.kept", "w.word").join(words, "word", "left")
    score = F.coalesce(F.col("freq") * 2 + F.col("listed"), F.lit(0))
    evidence = spelt.groupBy("stem", "tail").agg(F.max(F.when(F.col("kept") == 0, score)).alias("plain"), F.max(F.when(F.col("kept") == 1, score)).alias("compound"))
    keep = (F.col("compound") > F.col("plain")) | ((F.col("compound") == 0) & (F.col("plain") == 0) & F.col("tail").rlike(r"^\p{Lu}"))
    evidence = evidence.select("stem", "tail", F.when(keep, F.concat("stem", F.lit("-"), "tail")).otherwise(F.concat("stem", "tail")).alias("word"))
    return both.join(evidence, ["stem", "tail"]).select(*PAGE, "n", "word"), tails


def misread_words(lines: DataFrame, heads: DataFrame, tails: DataFrame, met: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page_no, h, n, word, right) of every whole word or number with wrong characters. `met` are token_counts; what is wrong
    with a token is found out once for all its places."""
    letters, digits = NUMBER_SIGNS
    mixed = F.col("word").rlike("[0-9]") & F.col("word").rlike(rf"^(?=.*[0-9])(?=.*[{letters}])[0-9{letters}]+([.,][0-9{letters}]+)?$")
    wrong = met.join(bounded(cut_lineage(corrections(words)), 500_000), "word", "left")
    wrong = wrong.select("token", "word", F.when(mixed, F.translate("word", letters, digits)).otherwise(F.col("right")).alias("right")).where("right is not null")
    every = whole_tokens(lines.where("s is not null").select(*PAGE, "n", "s", is_broken(F.col("s")).alias("broken"), is_broken(F.col("before")).alias("after_broken")))
    got = every.select(*PAGE, "n", "token").join(bounded(cut_lineage(wrong), 500_000), "token").select(*PAGE, "n", "word", "right")
    # an anti-join here would be moved below the one with the corrections and shuffle every token
    got = got.join(heads.withColumn("is_head", F.lit(True)), [*PAGE, "n"], "left").where("is_head is null").drop("is_head")
    return got.join(tails, [*PAGE, "n", "word"], "left_anti")


class Noise(NamedTuple):
    """What is wrong with the pages, by (doc_id, page_no, h)."""

    folios: DataFrame  #: n
    heads: DataFrame  #: n
    joined: DataFrame  #: n, word
    tails: DataFrame  #: n, word
    misread: DataFrame  #: n, word, right


def noise_of(pages: DataFrame, lexicon: DataFrame | None) -> Noise:
    """The lines are cut anew where they are needed; only the lines at the edges of pages and those with a broken word are kept, and
    counts of words and pairs."""
    lines = page_lines(pages)
    wanted = F.col("n").isNull() | at_edge() | is_broken(F.col("s"))
    sparse = cut_lineage(lines.where(wanted))
    folios = sparse.where("n is null or i = 0").select(*PAGE, F.explode("folios").alias("n"))
    sparse = sparse.where("n is not null").drop("folios")
    edges = sparse.where(at_edge()).select(*PAGE, "n", "s", (F.col("i") == 0).alias("top"))
    heads = cut_lineage(running_lines(edges, page_lines(different_pages(pages))))
    met = cut_lineage(token_counts(lines))
    words = cut_lineage(word_counts(met, lexicon))
    joined, tails = joined_words(sparse, heads, words)
    return Noise(folios, heads, joined, tails, misread_words(lines, heads, tails, met, words))


def scan_noise(pages: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, line_no, kind, word) of all noise, without repeats; kinds header, folio, hyphen, misread.

    pages(doc_id, page_no, text); lexicon: a table whose first column holds known names. Null and blank pages and an empty table
    give no row; pages of one number with different texts count each for itself. Running lines and page numbers give no other
    row. A word broken before a page that is missing gives none.

    Scale: no document is ever gathered in one place and the corpus is never written again. Pages are split into lines where they are
    read; frequencies of words and word pairs are partial aggregations; a line's neighbour over the page break is found by a join on
    document and page."""
    got = noise_of(pages, lexicon)
    kind = lambda df, name, word: df.select("doc_id", "page_no", F.col("n").alias("line_no"), F.lit(name).alias("kind"), word.alias("word"))
    none = F.lit("")
    out = kind(got.heads, "header", none).unionByName(kind(got.folios, "folio", none)).unionByName(kind(got.joined, "hyphen", F.col("word")))
    return out.unionByName(kind(got.misread, "misread", F.col("right"))).distinct()


def repaired_pages(pages: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, text, goes_on): the readable paragraphs of every page that has any, blank lines between; goes_on tells
    that the last one goes on on the next page. Pages of one number with different texts give a row each.

    Running lines and page numbers are gone, broken words stand whole where they began, misread words are put right. Fixes meet
    their page in a join; a page's lines are the most a row ever holds."""
    got = noise_of(pages, lexicon)
    fix = lambda df, kind, bad, right: df.select(*PAGE, F.struct(F.col("n"), F.lit(kind).alias("kind"), bad.alias("bad"), right.alias("right")).alias("fix"))
    none = F.lit(None).cast("string")
    fixes = fix(got.heads, "gone", none, none).unionByName(fix(got.folios, "gone", none, none)).unionByName(fix(got.joined, "hyphen", none, F.col("word")))
    fixes = fixes.unionByName(fix(got.misread, "misread", F.col("word"), F.col("right"))).unionByName(fix(got.tails, "tail", none, none))
    per_page = fixes.groupBy(*PAGE).agg(F.collect_set("fix").alias("fixes"))
    rows = pages.select(F.col("doc_id").cast("bigint"), F.col("page_no").cast("int"), "text").where(r"doc_id is not null and page_no is not null and text rlike '(?U)\\S'")
    rows = rows.select("doc_id", "page_no", F.xxhash64("text").alias("h"), F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("n"), F.trim(F.regexp_replace(x, r"(?U)\s+", " ")).alias("s"))).alias("ls"))
    rows = rows.join(per_page, PAGE, "left").withColumn("fixes", F.coalesce("fixes", F.array().cast(per_page.schema["fixes"].dataType)))
    of = lambda kind: F.filter("fixes", lambda f: f["kind"] == kind)
    rows = rows.select("doc_id", "page_no", "ls", F.transform(of("gone"), lambda f: f["n"]).alias("gone"), of("hyphen").alias("hyphens"), of("misread").alias("bad"), (F.size(of("tail")) > 0).alias("top_cut"))
    rows = rows.withColumn("ls", F.filter("ls", lambda x: ~F.array_contains("gone", x["n"])))

    def right(x: Column) -> Column:
        mine = F.filter("bad", lambda f: f["n"] == x["n"])
        word = lambda f: F.concat(F.lit(r"(?<![\p{L}\p{N}@])\Q"), f["bad"], F.lit(r"\E(?![\p{L}\p{N}@])"))
        return F.aggregate(mine, x["s"], lambda acc, f: F.regexp_replace(acc, word(f), f["right"]))

    def whole(s: Column, x: Column) -> Column:
        mine = F.filter("hyphens", lambda f: f["n"] == x["n"])
        ending = F.regexp_extract(s, r"(\S*)$", 1)
        front = F.regexp_extract(ending, f"^[{_OUTER}]*", 0)
        return F.when(F.size(mine) > 0, F.concat(F.regexp_replace(s, r"\S+$", ""), front, F.element_at(mine["right"], 1))).otherwise(s)

    fixed = F.transform("ls", lambda x: F.struct(let(right(x), lambda s: whole(s, x)).alias("s"), (F.size(F.filter("hyphens", lambda f: f["n"] == x["n"])) > 0).alias("cut")))
    # the end of a broken word leaves its line, but for the punctuation behind it
    start = F.struct(F.lit("").alias("text"), F.col("top_cut").alias("cut"))

    def step(acc: Column, x: Column) -> Column:
        first = F.regexp_extract(x["s"], r"^\S+", 0)
        behind = F.regexp_extract(first, f"[{_OUTER}]*$", 0)
        rest = F.when(acc["cut"], F.concat(behind, F.regexp_replace(x["s"], r"^\S+", ""))).otherwise(x["s"])
        sep = F.when((acc["text"] == "") | acc["text"].endswith("\n") | (acc["cut"] & (rest.rlike(f"^[{_OUTER}]") | (rest == "") | rest.startswith(" "))), "").otherwise(" ")
        blank = x["s"] == ""
        text = F.when(blank, F.when((acc["text"] == "") | acc["text"].endswith("\n") | acc["cut"], acc["text"]).otherwise(F.concat(acc["text"], F.lit("\n\n")))).otherwise(F.concat(acc["text"], sep, rest))
        return F.struct(text.alias("text"), F.when(blank, acc["cut"]).otherwise(x["cut"]).alias("cut"))

    out = rows.select("doc_id", "page_no", F.aggregate(fixed, start, step, lambda acc: acc["text"]).alias("text")).where(F.trim("text") != "")
    text = F.regexp_replace("text", r"\s+$", "")
    return out.select("doc_id", "page_no", text.alias("text"), (~text.rlike(r"[.!?:;»\"]$")).alias("goes_on")).distinct()
