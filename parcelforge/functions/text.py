"""Text normalisation as Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _one_to_one(first: int, last: int) -> tuple[str, str]:
    """Characters whose compatibility decomposition without marks is one other character, and those characters."""
    pairs = []
    for c in map(chr, range(first, last + 1)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _one_to_many(first: int, last: int) -> dict[str, str]:
    out = {}
    for c in map(chr, range(first, last + 1)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(bare) > 1:
            out[c] = bare
    return out


#: Latin-1 Supplement and Latin Extended-A, built from the Unicode tables.
ACCENTED, BARE = _one_to_one(0x00A0, 0x017F)
EXPANDED = _one_to_many(0x00A0, 0x017F)


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks, exact for U+0000 to U+017F and for already decomposed input.
    Characters beyond stay as they are."""
    out = F.translate(F.regexp_replace(c, r"\p{M}+", ""), ACCENTED, BARE)
    for k, v in EXPANDED.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


#: Every space and line end, for stripping; and line ends as a text editor sees them.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}]"


def stripped(c: Column) -> Column:
    """Without spaces of any kind at the ends."""
    return F.trim(c, F.lit(SPACES))


# Fixed value: characters stripped from the ends of a label.
LABEL_EDGES = " .,:;()[]{}\t\r\n"


def normalize_label(c: Column) -> Column:
    """Spaces collapsed, label edges stripped, no spaces round hyphens, upper case - in this order."""
    s = F.trim(collapse_spaces(c), F.lit(LABEL_EDGES))
    return F.upper(F.regexp_replace(s, r"(?U)\s*-\s*", "-"))


def normalize_match(c: Column) -> Column:
    """A label without accents."""
    return normalize_label(strip_accents(c))


def normalize_commune(c: Column) -> Column:
    """Name without accents, upper case, stripped before apostrophes and hyphens become spaces (so edge spaces may stay)."""
    s = F.trim(F.upper(strip_accents(c)), F.lit(" \t\r\n"))
    return F.regexp_replace(F.regexp_replace(s, r"['-]+", " "), r"(?U)\s+", " ")


def alnum_count(c: Column) -> Column:
    """Number of letters and digits of any script."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def word_sign_count(c: Column) -> Column:
    """Number of letters, digits and underscores."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}_]", ""))


def count_of(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
