"""Fields that pack several values, split into one row per value with position and error flag.

The grammar is a parsing expression grammar: ordered choice, no ambiguity, and a choice that fails gives its input back.

    field     <- piece (separator piece)*
    separator <- [,;|/+] / tab / line break / "et" between spaces
    piece     <- space* (quoted space* &end / part*) space*
    quoted    <- '"' ('""' / !'"' .)* '"'  /  '«' (!'»' .)* '»'
    part      <- number / quoted / bracket / word / char
    number    <- digit [,./+] &digit            # a mark inside a number separates nothing
    bracket   <- '(' (!')' !break .)* ')'  /  '[' (!']' !break .)* ']'
    end       <- separator / end of field

A quote or bracket that never closes fails its alternative; the parser backs up and takes the sign as an ordinary character,
so that the separators after it count, and the piece gets the flag.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = r"[    \r\f\v]"

# Terminals. Each is matched at a position, in the order the grammar names them.
_SKIP = re.compile(rf"{_SPACE}*")
_QUOTED = re.compile(r'"((?:""|[^"])*+)"|«([^»]*+)»')
_BRACKET = re.compile(r"\([^()\n\t]*+\)|\[[^\[\]\n\t]*+\]")
_NUMBER = re.compile(r"[0-9][,./+](?=[0-9])")
_SEPARATOR = re.compile(rf"[,;|/+\t\n]|(?<={_SPACE[:-1]}\"»)\]])et(?={_SPACE}|[«\"]|$)|(?<=[\t\n])et(?={_SPACE}|[«\"])")
_PLAIN = re.compile(r"[^0-9,;|/+\t\n\"«»(\[    \r\f\ve]+|e(?!t)")
_OPENERS = '"«»'

VALUE = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("malformed", T.BooleanType())]))


def _quoted(m: re.Match) -> str:
    return m[1].replace('""', '"') if m[1] is not None else m[2]


def parse_packed(text: str) -> list[tuple[str, bool]]:
    """(value, malformed) of each non-empty piece, in order."""
    out: list[tuple[str, bool]] = []
    at, end = 0, len(text)
    no_quote_after = {'"': end + 1, "«": end + 1}  # from here on a quote is known not to close

    def quote(i: int) -> re.Match | None:
        sign = text[i]
        if sign == "»" or i >= no_quote_after[sign]:
            return None
        m = _QUOTED.match(text, i)
        if m is None:
            no_quote_after[sign] = i
        return m

    while True:
        at = _SKIP.match(text, at).end()
        start, malformed, value = at, False, None
        if at < end and text[at] in '"«' and (m := quote(at)):  # a piece that is one quoted value
            after = _SKIP.match(text, m.end()).end()
            if after == end or _SEPARATOR.match(text, after):
                value, at = _quoted(m).strip(), after
        if value is None:
            while at < end:
                if m := _NUMBER.match(text, at):
                    at = m.end()
                elif _SEPARATOR.match(text, at):
                    break
                elif text[at] in _OPENERS:
                    if m := quote(at):
                        at = m.end()
                    else:
                        at, malformed = at + 1, True
                elif text[at] in "([":
                    if m := _BRACKET.match(text, at):
                        at = m.end()
                    else:
                        at, malformed = at + 1, True
                elif m := _PLAIN.match(text, at):
                    at = m.end()
                else:
                    at += 1
            value = text[start:at].strip()
            if malformed:  # the quote that never closed is no part of the value when it stands at an edge
                value = value.strip('"«»').strip() or value
        if value:
            out.append((value, malformed))
        if at >= end:
            return out
        at = _SEPARATOR.match(text, at).end()


@F.pandas_udf(VALUE)
def packed_values(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: [] if s is None else [{"pos": i, "value": v, "malformed": bad} for i, (v, bad) in enumerate(parse_packed(s), 1)])


def split_packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, value, malformed) of every piece; pos counts from 1 and empty pieces take none.

    Null, empty and blank fields give no row; a repeated row of the input gives its pieces again; other columns of `df` are not
    read, so their names can't clash. No shuffle: each field is parsed where it was read, in one pass over its whole length."""
    rows = df.select(F.col(id_col).alias("_id"), F.explode(packed_values(F.col(text_col))).alias("_v"))
    return rows.select(F.col("_id").alias(id_col), F.col("_v.pos").alias("pos"), F.col("_v.value").alias("value"), F.col("_v.malformed").alias("malformed"))
