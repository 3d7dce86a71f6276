"""Read dimension texts as column expressions: inline tolerances, prefixes, plausibility, and the texts reports show.

Digits are 0-9. A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftlens.functions.binding import let

# Range of plausible nominal values.
LEAST, MOST = 0.001, 99999.0
# Prefix pattern, sign that replaces it (else what was read), kind; the first that fits counts.
PREFIXES = [
    ("^[⌀∅Øφ]", "⌀", "diameter"),
    (r"(?i)^R(?:a|z|max)(?=[0-9.])", None, "surface_rough"),
    (r"^R(?=[0-9.])", "R", "radius"),
    (r"^M(?=[0-9.])", "M", "thread"),
    (r"^C(?=[0-9.])", "C", "chamfer"),
]
REPEAT = r"^[0-9]+\s*[×xX]"
# Patterns of inline tolerances, in order, and the characters that read as digits in them.
DIGITS = "[Oo0-9.]+"
BOTH = rf"[±]\s*({DIGITS})"
PAIR = rf"\+\s*({DIGITS})\s*/?\s*-\s*({DIGITS})"
UNSIGNED_LOWER = rf"\+\s*({DIGITS})\s+(0?\.[0-9]+)(?![0-9])"
UPPER = rf"\+\s*({DIGITS})(?![0-9])"
LOWER = rf"\s-\s*({DIGITS})(?![0-9])"
# Signs that a proper text may hold beside letters and digits.
SAFE = r"±.°⌀∅Ø+\- /"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def inline(text: Column) -> Column:
    """struct(upper, lower): the signed tolerance texts that a dimension text holds, null where there are none."""
    t = _text(text)
    clean = lambda pattern, group: F.translate(F.regexp_extract(t, pattern, group), "Oo ", "00")
    plus, minus = (lambda c: F.concat(F.lit("+"), c)), (lambda c: F.concat(F.lit("-"), c))
    upper = F.when(t.rlike(BOTH), plus(clean(BOTH, 1))).when(t.rlike(PAIR), plus(clean(PAIR, 1))).when(t.rlike(UNSIGNED_LOWER), plus(clean(UNSIGNED_LOWER, 1))).when(t.rlike(UPPER), plus(clean(UPPER, 1)))
    lower = F.when(t.rlike(BOTH), minus(clean(BOTH, 1))).when(t.rlike(PAIR), minus(clean(PAIR, 2))).when(t.rlike(UNSIGNED_LOWER), minus(clean(UNSIGNED_LOWER, 2)))
    lower = lower.when(t.rlike(LOWER) & ~t.rlike(UPPER), minus(clean(LOWER, 1)))
    return F.struct(upper.alias("upper"), lower.alias("lower"))


def _plain_prefix(t: Column) -> Column:
    """struct(rest, prefix, kind) under PREFIXES; null prefix and kind where none fits."""
    rest, sign, kind = t, F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, plain, name in reversed(PREFIXES):
        fits, read = t.rlike(pattern), F.regexp_extract(t, pattern, 0)
        rest = F.when(fits, F.substring(t, F.length(read) + 1, F.length(t))).otherwise(rest)
        sign = F.when(fits, F.lit(plain) if plain else read).otherwise(sign)
        kind = F.when(fits, name).otherwise(kind)
    return F.struct(rest.alias("rest"), sign.alias("prefix"), kind.alias("kind"))


def prefix(text: Column) -> Column:
    """struct(rest, prefix, kind): quantity, diameter, radius, thread, chamfer or roughness prefix; a quantity may precede another."""

    def whole(t: Column) -> Column:
        times = F.regexp_extract(t, REPEAT, 0)
        after = F.substring(t, F.length(times) + 1, F.length(t))
        return F.struct(t.alias("t"), _plain_prefix(t).alias("plain"), times.alias("times"), after.alias("after"), let(F.regexp_replace(after, r"^\s+", ""), _plain_prefix).alias("inner"))

    def pick(m: Column) -> Column:
        repeated, inner = (m["times"] != "") & m["plain"]["kind"].isNull(), m["inner"]["kind"].isNotNull()
        return F.struct(
            F.when(repeated & inner, m["inner"]["rest"]).when(repeated, m["after"]).otherwise(m["plain"]["rest"]).alias("rest"),
            F.when(repeated & inner, F.concat_ws(" ", m["times"], m["inner"]["prefix"])).when(repeated, m["times"]).otherwise(m["plain"]["prefix"]).alias("prefix"),
            F.when(repeated, F.coalesce(m["inner"]["kind"], F.lit("repeat"))).otherwise(F.coalesce(m["plain"]["kind"], F.lit("linear"))).alias("kind"),
        )

    return let(F.regexp_replace(_text(text), r"^\s+|\s+$", ""), lambda t: let(whole(t), pick))


def plausibility(nominal: Column, upper: Column, lower: Column) -> Column:
    """`high`, or `low` for a nominal value out of range or an upper tolerance below the lower one."""
    crossed = (upper != "") & (lower != "") & (upper.try_cast("double") < lower.try_cast("double"))
    return F.when(nominal.isNull() | ~nominal.between(LEAST, MOST) | F.coalesce(crossed, F.lit(False)), "low").otherwise("high")


def mostly_symbols(text: Column) -> Column:
    """Whether a tenth or more of a text of six characters or more is neither letter, digit nor a usual sign."""
    clean = F.regexp_replace(F.regexp_replace(_text(text), r"^[0-9]+X\s*", ""), r"\s", "")
    junk = F.length(F.regexp_replace(clean, rf"[\p{{L}}\p{{N}}{SAFE}]", ""))
    return (F.length(clean) >= 6) & (junk * 10 >= F.length(clean))


def quick_score(text: Column) -> Column:
    """How much a text looks like a dimension: the sum of what its signs are worth."""
    t = F.regexp_replace(_text(text), r"^\s+|\s+$", "")
    # Pattern and worth.
    worth = [("±", 50), ("⌀", 50), ("°", 40), ("(?i)MAX|MIN", 40), (r"[+\-]\s*[0-9]", 45), (r"^[0-9.]+$", 30), (r"^[0-9]+[×xX][0-9.]+", 35), (r"^R[0-9.]+", 35)]
    return sum((F.when(t.rlike(p), w).otherwise(0) for p, w in worth), F.lit(0))


def clean_number(text: Column) -> Column:
    """Trimmed, without leading zeros before a decimal number of more digits."""
    return F.regexp_replace(F.regexp_replace(_text(text), r"^\s+|\s+$", ""), r"\b0+([0-9]+\.[0-9]+)", "$1")


def display(nominal: Column, upper: Column, lower: Column, prefix: Column, kind: Column, unit: Column) -> Column:
    """The text a report shows for a linear dimension: prefix without its quantity, nominal value, ± where both sides agree."""
    head = F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(prefix), r"(?i)^\s*[0-9]+\s*X\s*", ""), r"^\s+|\s+$", ""), "⌀", "Ø")
    degrees = F.regexp_replace(_text(unit), r"^\s+|\s+$", "") == "degree"
    with_unit = lambda c: F.when((c == "") | ~degrees | c.endswith("°"), c).otherwise(F.concat(c, F.lit("°")))
    nom = clean_number(nominal)
    up, low = (F.regexp_replace(_text(c), r"^\s+|\s+$", "") for c in (upper, lower))
    rest = lambda c: F.substring(c, F.lit(2), F.length(c))
    same = up.startswith("+") & low.startswith("-") & (rest(up) == rest(low))
    side = lambda c, sign: F.when(c == "", "").when(c.rlike("^[+-]"), with_unit(c)).otherwise(F.concat(F.lit(sign), with_unit(c)))
    bare = F.regexp_replace(F.concat(head, with_unit(nom)), r"^\s+|\s+$", "")
    return (
        F.when(kind == "surface_rough", F.regexp_replace(F.concat(head, nom), r"^\s+|\s+$", ""))
        .when(upper.isNull() & lower.isNull(), bare)
        .when(same, F.concat(head, with_unit(nom), F.lit("±"), with_unit(rest(up))))
        .otherwise(F.concat(head, with_unit(nom), side(up, "+"), side(low, "-")))
    )


def first_non_blank(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def detail_limits(nominal: Column, upper_tol: Column, lower_tol: Column, upper_limit: Column, lower_limit: Column) -> Column:
    """struct(upper, lower): explicit limits if either is there, else nominal value plus tolerances."""
    given = upper_limit.isNotNull() | lower_limit.isNotNull()
    made = lambda tol: nominal + tol
    return F.struct(F.when(given, upper_limit).otherwise(made(upper_tol)).alias("upper"), F.when(given, lower_limit).otherwise(made(lower_tol)).alias("lower"))


def detail_result(explicit: Column, actuals: Column, upper: Column, lower: Column) -> Column:
    """A report's result: an explicit one wins here, then what the actual values say."""
    said, values = F.upper(F.trim(_text(explicit))), F.filter(F.coalesce(actuals, F.array().cast("array<double>")), lambda v: v.isNotNull())
    inside = F.forall(values, lambda v: (v >= lower) & (v <= upper))
    return (
        F.when(said.isin("OK", "NOK"), said).when(said == "NG", "NOK").when(F.trim(_text(explicit)).isin("未测量", "临界"), F.trim(_text(explicit)))
        .when(F.size(values) == 0, "未测量").when(upper.isNull() | lower.isNull(), "UNKNOWN").when(inside, "OK").otherwise("NOK")
    )


def six_actuals(samples: Column) -> Column:
    """Measured values (array of struct sample, value) in six places; a missing sample number means its own place, the last value of a place counts."""
    placed = F.transform(F.slice(samples, 1, 6), lambda s, i: F.struct(F.coalesce(F.nullif(s["sample"], F.lit(0)), i + 1).alias("place"), s["value"].alias("value")))
    last = lambda k: F.element_at(F.transform(F.filter(placed, lambda p: p["place"] == k), lambda p: p["value"]), -1)
    at = lambda k: F.when(F.exists(placed, lambda p: p["place"] == k), last(k))
    return F.array(*[at(k) for k in range(1, 7)])
