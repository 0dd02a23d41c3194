"""Records that differ only in the way they are written, collapsed without building canonical strings.

Characters stream through one lookup table that skips what is only writing (spaces, punctuation, symbols) and folds case. Each
named field gets rolling polynomial hashes of what is left, under two moduli; the record's hash is a sum over its fields, so the
order of the fields has no part in it. Rows that collide are compared with the first rows of their group by two pointers that skip
and fold as they go, so that equality is certain and not just likely. Copies met in one batch collapse before anything is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.session import cut_lineage

# Names of a record's fields.
FIELDS = ("code_insee", "section", "numero", "lieudit", "nature", "contenance")

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PRIME = (1 << 31) - 1
_PBASE = 1_000_003
_POINT = ord(".")

#: Rows whose copies collapse before the shuffle.
SLICE = 4096


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Folded code of every code point: 0 for one that is skipped (neither letter, number nor mark), else its lower case."""
    table = np.zeros(0x110000, np.uint32)
    table[0x20000:0x40000] = np.arange(0x20000, 0x40000)  # ideographs; what lies beyond is no writing of content
    for c in range(0x20000):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LNM":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def key_pattern(fields: tuple[str, ...] = FIELDS) -> re.Pattern:
    """A field's name as a key: before a colon or equals sign, spaces and quotes between; an underscore may be any sign."""
    names = "|".join(rf"({'[^\\w\\n\\0]*_?[^\\w\\n\\0]*'.join(map(re.escape, f.split('_')))})" for f in fields)
    return re.compile(rf"(?<![^\W_])(?:{names})(?=[\s\"'’»”]*[:=])", re.IGNORECASE)


def composed(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def _powers(base: int, n: int, mod: int) -> np.ndarray:
    """base^0 .. base^(n-1), by doubling; mod 2^64 wraps by itself."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = pow(base, done, mod)
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        if mod < 1 << 63:
            out[done : done + take] %= np.uint64(mod)
        done += take
    return out


@lru_cache(maxsize=2)
def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    unprime = pow(_PBASE, -1, _PRIME)
    return _powers(int(_BASE), size, 1 << 64), _powers(int(_UNBASE), size, 1 << 64), _powers(_PBASE, size, _PRIME), _powers(unprime, size, _PRIME)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folded(text: str) -> np.ndarray:
    """Code of each character after the table, a mark between two digits kept as a decimal point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = fold_table()[codes]
    marks = np.flatnonzero((codes == 44) | (codes == 46))
    marks = marks[(marks > 0) & (marks < len(codes) - 1)]
    digit = lambda a: (a >= 48) & (a <= 57)
    out[marks[digit(codes[marks - 1]) & digit(codes[marks + 1])]] = _POINT
    return out


def record_hashes(texts: list[str | None], fields: tuple[str, ...] = FIELDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each record, and whether it is one: null texts and texts with nothing but writing are none."""
    n = len(texts)
    parts = [composed(t) if t else "" for t in texts]
    starts = np.zeros(n + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    whole = "\0".join(parts) + "\0"  # no space, so that no key reaches over a record's end
    code = folded(whole)
    # segments: from the end of a key to the start of the next, and what stands before the first key of a record
    keys = [(m.start(), m.end(), m.lastindex) for m in key_pattern(fields).finditer(whole)]
    k_at = np.array([k[0] for k in keys], np.int64)
    k_to = np.array([k[1] for k in keys], np.int64)
    k_id = np.array([k[2] for k in keys], np.int64)
    begin = np.concatenate([starts[:-1], k_to])
    name = np.concatenate([np.zeros(n, np.int64), k_id])
    order = np.argsort(begin, kind="stable")
    begin, name = begin[order], name[order]
    # a segment stops at the next key or at the end of its record
    next_key = np.append(k_at, len(code))[np.searchsorted(k_at, begin, side="left")]
    stop = np.minimum(next_key, starts[np.searchsorted(starts, begin, side="right")])
    owner = np.searchsorted(starts, begin, side="right") - 1

    kept = code > 0
    index = np.zeros(len(code) + 1, np.int64)
    np.cumsum(kept, out=index[1:])
    size = 1 << max(10, int(index[-1] + 1).bit_length())
    pow64, inv64, powp, invp = _power_tables(size)
    # running sums over all positions: what is skipped has code 0 and leaves the power as it is
    value, power = code.astype(np.uint64), index[:-1]
    sum64 = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(value * pow64[power], out=sum64[1:])
    sump = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(value * powp[power] % np.uint64(_PRIME), out=sump[1:])
    a, b = index[begin], index[stop]
    h64 = (sum64[stop] - sum64[begin]) * inv64[a]
    hp = (sump[stop] - sump[begin]) % np.uint64(_PRIME) * invp[a] % np.uint64(_PRIME)
    filled = b > a
    tag = (name.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + (b - a).astype(np.uint64)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(one, owner[filled], _mix(h64[filled] ^ tag[filled]))
    np.add.at(two, owner[filled], _mix((hp[filled] << np.uint64(32)) ^ h64[filled] ^ (tag[filled] << np.uint64(7))))
    real = np.zeros(n, bool)
    real[owner[filled]] = True
    return one.view(np.int64), two.view(np.int64), real


def _segments(text: str, pattern: re.Pattern) -> list[tuple[int, int, int]]:
    """(field, start, stop) of the non-empty segments, ordered by field and then as they stand."""
    out, at, name = [], 0, 0
    for m in pattern.finditer(text):
        out.append((name, at, m.start()))
        at, name = m.end(), m.lastindex
    out.append((name, at, len(text)))
    return sorted(out, key=lambda s: s[0])


def _next(text: str, i: int, stop: int, table: np.ndarray) -> tuple[int, int]:
    """Folded code of the next character that counts, and the place after it; code 0 at the end."""
    while i < stop:
        c = text[i]
        if c in ",." and 0 < i < len(text) - 1 and "0" <= text[i - 1] <= "9" and "0" <= text[i + 1] <= "9":
            return _POINT, i + 1
        code = int(table[ord(c)])
        i += 1
        if code:
            return code, i
    return 0, stop


#: Runs of what counts, in texts of Latin letters (below _LATIN), where the letters and numbers of a pattern are those of the table.
_RUN = re.compile(r"[^\W_]+|(?<=[0-9])[.,](?=[0-9])")
_LATIN = re.compile("[^\x00-\u012f\u0132-\u024f]")


def _same_value(x: str, i_stop: int, i: int, y: str, j_stop: int, j: int, table: np.ndarray) -> bool:
    """Two pointers over any text, sign by sign."""
    while True:
        c, i = _next(x, i, i_stop, table)
        d, j = _next(y, j, j_stop, table)
        if c != d:
            return False
        if not c:
            return True


def _same_runs(x: str, i_stop: int, i: int, y: str, j_stop: int, j: int) -> bool:
    """Two pointers over lower-case Latin texts, from the end of one run of signs that count to the next."""
    left, right = _RUN.finditer(x, i, i_stop), _RUN.finditer(y, j, j_stop)
    a = b = 0  # what is left of the runs the pointers stand in ends at a_to, b_to
    a_to = b_to = 0
    while True:
        if a == a_to:
            m = next(left, None)
            a, a_to = m.span() if m else (0, 0)
        if b == b_to:
            m = next(right, None)
            b, b_to = m.span() if m else (0, 0)
        n = min(a_to - a, b_to - b)
        if not n:
            return a == a_to and b == b_to
        if n == 1 and x[a] in ",." and y[b] in ",.":
            pass
        elif x[a : a + n] != y[b : b + n]:
            return False
        a, b = a + n, b + n


def same_record(x: str, y: str, pattern: re.Pattern | None = None) -> bool:
    """Whether two texts are one record: two pointers walk the same fields, each skipping what is only writing."""
    if x == y:
        return True
    pattern = pattern or key_pattern()
    table = fold_table()
    x, y = composed(x), composed(y)
    filled = lambda t: [s for s in _segments(t, pattern) if _next(t, s[1], s[2], table)[0]]
    a, b = filled(x), filled(y)
    if [s[0] for s in a] != [s[0] for s in b]:
        return False
    if _LATIN.search(x) or _LATIN.search(y):
        return all(_same_value(x, s[2], s[1], y, t[2], t[1], table) for s, t in zip(a, b, strict=True))
    x, y = x.lower(), y.lower()
    return all(_same_runs(x, s[2], s[1], y, t[2], t[1]) for s, t in zip(a, b, strict=True))


class _Group:
    """Different records of one hash, each with its smallest id."""

    __slots__ = ("firsts",)

    def __init__(self) -> None:
        self.firsts: list[tuple[int, str]] = []

    def keep_id(self, row_id: int, body: str, pattern: re.Pattern) -> int:
        """The id of the record that `body` is a copy of; its own if it is the first."""
        for first_id, first in self.firsts:
            if same_record(first, body, pattern):
                return first_id
        self.firsts.append((row_id, body))
        return row_id


def _collapse_batches(fields: tuple[str, ...]):
    """Rows with their hashes; copies of a record within a slice of a batch name its first row as `rep` and leave their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = key_pattern(fields)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                b = batch.slice(i, SLICE)
                ids, bodies = b.column("id").to_numpy(), b.column("body").to_pylist()
                one, two, real = record_hashes(bodies, fields)
                order = np.lexsort((ids, two, one))
                order = order[real[order]]
                new = np.ones(len(order), bool)  # the first of each hash
                new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
                many = ~new
                many[:-1] |= ~new[1:]
                rep = ids.copy()
                group = _Group()
                for k in np.flatnonzero(many).tolist():
                    if new[k]:
                        group = _Group()
                    at = order[k]
                    rep[at] = group.keep_id(int(ids[at]), bodies[at], pattern)
                first = rep[order] == ids[order]
                texts = [bodies[at] if f else None for at, f in zip(order.tolist(), first.tolist(), strict=True)]
                columns = [pa.array(ids[order]), pa.array(one[order]), pa.array(two[order]), pa.array(rep[order], mask=first), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h1", "h2", "rep", "body"])

    return run


def _stream_groups(fields: tuple[str, ...]):
    """(h1, h2, id, keep_id) of rows that come sorted by h1, h2 and id; only the different records of one hash are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, last, group = key_pattern(fields), None, _Group()
        for batch in batches:
            ids, keys = batch.column("id").to_pylist(), list(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True))
            keep = []
            for k, row_id, body in zip(keys, ids, batch.column("body"), strict=True):
                if k != last:
                    last, group = k, _Group()
                keep.append(group.keep_id(row_id, body.as_py(), pattern))
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), batch.column("id"), pa.array(keep, pa.int64())], ["h1", "h2", "id", "keep_id"])

    return run


def record_groups(df: DataFrame, id_col: str, text_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, keep_id), without repeats, of every record: the smallest id of its group."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("body")).where("id is not null and body is not null")
    met = rows.mapInArrow(_collapse_batches(fields), "id bigint, h1 bigint, h2 bigint, rep bigint, body string")
    firsts = met.where("rep is null").select("h1", "h2", "id", "body").repartition("h1", "h2").sortWithinPartitions("h1", "h2", "id")
    firsts = cut_lineage(firsts.mapInArrow(_stream_groups(fields), "h1 bigint, h2 bigint, id bigint, keep_id bigint"))
    copies = met.where("rep is not null").select("id", "h1", "h2", "rep")
    copies = copies.join(firsts.select("h1", "h2", F.col("id").alias("rep"), "keep_id"), ["h1", "h2", "rep"]).select("id", "keep_id")
    return firsts.select("id", "keep_id").unionByName(copies).distinct()


def record_copies(df: DataFrame, id_col: str = "rec_id", text_col: str = "parcelles", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(keep_id, rec_id): one row for each copy after the first; keep_id is the smallest id of the group.

    Null and blank rows and rows of nothing but punctuation are no records; rows without an id are left out; a row delivered
    again under its id is no copy of itself. A field without content counts as missing. A comma or point between two digits is a
    decimal mark and content, the two being one sign. Only the two columns named are read.

    Scale: copies collapse within slices of SLICE rows where they are read, so that a group with a third of all rows comes to the
    shuffle as one text a slice. The texts left are shuffled and sorted once by their hash and compared in one stream that holds only
    the different records of one hash; rows that collide without being equal become records of their own. The copies of a slice find
    their group in a join on its first row, of which none has more than SLICE."""
    groups = record_groups(df, id_col, text_col, fields)
    return groups.where("id <> keep_id").select("keep_id", F.col("id").alias(id_col))


def copy_counts(df: DataFrame, id_col: str = "rec_id", text_col: str = "parcelles", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(rec_id, n_copies): one row for each distinct record, with the number of times it occurs."""
    groups = record_groups(df, id_col, text_col, fields)
    return groups.groupBy(F.col("keep_id").alias(id_col)).agg(F.count("*").alias("n_copies"))
