"""Parcel keys: commune, section, number, and the identifier (idu) that packs them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed format of an identifier: five digits, one or more ignored digits, one or two letters, three or four digits.
IDU_PATTERN = r"(?i)^([0-9]{5})([0-9]+)([A-Z]{1,2})([0-9]{3,4})$"

#: Spaces of any kind, for trimming.
SPACES = " \t\r\n   "


def trim_all(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def pad_left(c: Column, width: int) -> Column:
    """Zero-pad without cutting longer values (lpad alone would cut them)."""
    return F.lpad(c, F.greatest(F.length(c), F.lit(width)), F.lit("0"))


def norm_section(c: Column) -> Column:
    """Upper case without outer spaces; a single character takes a leading 0."""
    s = F.upper(trim_all(c))
    return F.when(F.length(s) == 1, F.concat(F.lit("0"), s)).otherwise(s)


def norm_numero(c: Column) -> Column:
    return pad_left(trim_all(c), 4)


def norm_insee(c: Column) -> Column:
    return pad_left(F.upper(trim_all(c)), 5)


def parcel_key(code_insee: Column, section: Column, numero: Column) -> Column:
    """`commune|section|number`; null when any part is null."""
    return F.concat(norm_insee(code_insee), F.lit("|"), norm_section(section), F.lit("|"), norm_numero(numero))


def idu_part(idu: Column, group: int) -> Column:
    """Group of the identifier, null when it can't be read."""
    return F.nullif(F.regexp_extract(trim_all(idu), IDU_PATTERN, group), F.lit(""))


def idu_key(idu: Column) -> Column:
    """The same `commune|section|number` key read out of an identifier; null when it can't be read."""
    return parcel_key(idu_part(idu, 1), idu_part(idu, 3), idu_part(idu, 4))
