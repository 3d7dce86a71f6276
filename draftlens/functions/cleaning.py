"""Clean texts as column expressions: full-width signs, control characters, safe names, trace ids, signed tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms and the plain characters they stand for.
FULL, HALF = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　", "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
# Characters that a cleaned drawing text may hold.
KEPT = " -~一-龥°-¿×ØøΦφ∀-⋿⌀-⏿─-╿■-◿⟀-⟯⨀-⫿′″→←↑↓↗"
# A signed tolerance with blanks after its sign.
SIGNED = r"^([+\-])\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(°?)$"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def half_width(text: Column) -> Column:
    return F.translate(_text(text), FULL, HALF)


def drawing_text(text: Column) -> Column:
    """Half-width, without any character that drawing texts don't use."""
    return F.regexp_replace(half_width(text), f"[^{KEPT}]", "")


def printable(text: Column) -> Column:
    """Half-width, an ideographic stop between digits as a decimal point, without control characters and outer blanks."""
    points = F.regexp_replace(half_width(text), "(?<=[0-9])。(?=[0-9])", ".")
    return _strip(F.regexp_replace(points, r"[\x00-\x1F\x7F]", ""))


def safe_name(name: Column, fallback: str = "drawing") -> Column:
    """A file name of letters, digits, dots, lines and underscores, without dots or underscores at its ends."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(_text(name), r"[^\x00-\x7F]", "")), r"[^A-Za-z0-9._-]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(plain, r"^[._]+|[._]+$", ""), F.lit("")), F.lit(fallback))


def trace_id(content: Column, page: Column) -> Column:
    """An id from a file's bytes and a page from 0; null for an empty file or a negative page."""
    made = F.concat(F.lit("r32v1-"), F.substring(F.sha2(content, 256), 1, 24), F.lit("-p"), F.lpad((page + 1).cast("string"), 4, "0"))
    return F.when((F.octet_length(content) > 0) & (page >= 0), made)


def signed_tolerance(text: Column) -> Column:
    """A signed tolerance without blanks after its sign, O between digits read as 0, with a digit on both sides of its point or no point."""
    raw = F.regexp_replace(F.replace(_strip(_text(text)), F.lit("。"), F.lit(".")), "(?<=[0-9])[Oo](?=[0-9])", "0")
    value = F.regexp_extract(raw, SIGNED, 2)
    value = F.when(value.startswith("."), F.concat(F.lit("0"), value)).otherwise(F.regexp_replace(value, r"\.$", ""))
    return F.when(raw.rlike(SIGNED), F.concat(F.regexp_extract(raw, SIGNED, 1), value, F.regexp_extract(raw, SIGNED, 3))).otherwise(raw)
