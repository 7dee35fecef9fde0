"""Scalar string expressions (JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip()/split() treat Unicode spaces as whitespace; Java regex
# needs the (?U) flag for the same behaviour.
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_label(c) -> Column:
    """``;``, TAB and NL become spaces, strip, empty string -> NULL."""
    x = F.regexp_replace(F.translate(col_(c), ";\t\n", "   "), _EDGE_SPACE, "")
    return F.when(x == "", F.lit(None).cast("string")).otherwise(x)


def last_segment(c) -> Column:
    """C4: ``uri.split('/')[-1]``."""
    return F.substring_index(col_(c), "/", -1)


def numeric_id(c) -> Column:
    """``int(id[1:])`` as a BIGINT sort key."""
    return F.substring(col_(c), 2, 1 << 30).cast("bigint")


def valid_subject(c) -> Column:
    """Not empty and not the string 'None'."""
    x = col_(c)
    return x.isNotNull() & (x != "") & (x != "None")


def find0(haystack, needle) -> Column:
    """Python ``str.find``: 0-based index of the first match, -1 if none."""
    return F.position(col_(needle), col_(haystack)) - 1


def rfind0(haystack, needle) -> Column:
    """Python ``str.rfind``: 0-based index of the last match, -1 if none."""
    h, n = col_(haystack), col_(needle)
    p = F.position(F.reverse(n), F.reverse(h))
    return F.when(p == 0, F.lit(-1)).otherwise(F.length(h) - p - F.length(n) + 1)


def split_rename(c) -> Column:
    """Directory ``valid`` is exposed as split ``validation``."""
    x = col_(c)
    return F.when(x == "valid", F.lit("validation")).otherwise(x)
