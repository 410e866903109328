"""String column expressions: participant ids from names, word tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
# Participant id rule: the first run of three digits in a file name.
ID_PATTERN = "[0-9]{3}"
# Word tokens: lower-cased text split on every run of characters that are
# neither letters nor digits (Unicode classes), empty pieces removed --
# equivalently, every maximal run of letters and digits.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
TOKEN_RUN = r"[\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_id(name, pattern: str = ID_PATTERN, mode: str = "strict", dtype: str = "int") -> Column:
    """Integer id taken from the first match of ``pattern`` in ``name``.

    ``mode='strict'`` raises on a non-null name without a match (a missing id
    is an error in the source pipeline); ``mode='null'`` yields NULL instead.
    A NULL name yields NULL in both modes.
    """
    if mode not in ("strict", "null"):
        raise ValueError(f"unknown extract_id mode {mode!r}")
    c = _col(name)
    value = F.regexp_substr(c, F.lit(pattern)).cast(dtype)
    if mode == "null":
        return value
    return F.when(c.isNotNull() & value.isNull(),
                  F.raise_error(F.concat(F.lit("no id matching " + pattern + " in: "), c))).otherwise(value)


def tokens(text) -> Column:
    """Array of lower-case word tokens of ``text`` (whole text, in order).

    Extracting the maximal letter/digit runs gives the same list as
    splitting on the separators and dropping empty pieces, without an array
    lambda, so the expression stays inside whole-stage code generation.
    """
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_RUN), 0)
