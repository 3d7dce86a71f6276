"""Grammar of dimension texts as column expressions: canonical form, reason, and syntax label.

Digits are 0-9. A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Diameter signs that mean the same, and drop reasons that tell of unread glyphs.
DIAMETERS, UNREAD = "ø⌀∅Φφ", ["unrecognized_slot", "grouped_window_authority_read_failed"]
# Reasons that keep a text from the output.
BLOCKING = ["symbol_only", "long_minus_run", "invalid_tolerance_number"]
# Patterns of the grammar's parts.
QUANTITY = r"^([0-9]+)[*xX×]"
CHAMFER = r"^[+-]?[0-9]{1,3}(\.[0-9]{1,3})?[*xX×][0-9]{1,3}(\.[0-9]{1,3})?°$"
MAIN = r"^[+-]?[0-9]{1,3}(\.[0-9]{1,3})?°?$"
SIDE = r"[0-9](\.[0-9]{1,3})?°?"
TOLERANCE = rf"^(±{SIDE}|[+-]{SIDE}(/?[+-]{SIDE})?)$"
PARTIAL = r"^([0-9]+[xX×])?[ØR]?[+-]?[0-9]+(\.[0-9]+){2,}$"


def canonical(text: Column) -> Column:
    """Without white space, with one diameter sign."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), DIAMETERS, "Ø" * len(DIAMETERS))


def reason(text: Column) -> Column:
    """`ok`, or the first rule that the text breaks."""
    whole = canonical(text)
    qualified = whole.rlike("(MAX|MIN)$")
    body = F.regexp_replace(whole, "(MAX|MIN)$", "")
    quantity = F.regexp_extract(body, QUANTITY, 1)
    rest = F.regexp_replace(F.regexp_replace(body, QUANTITY, ""), "^(Ra|R|Ø)", "")
    main = F.regexp_extract(rest, r"^(.?[^+±-]*)", 1)
    tolerance = F.substring(rest, F.length(main) + 1, F.length(rest))
    return (
        F.when(whole == "", "empty")
        .when(whole.rlike(r"^[.+±/-]+$"), "symbol_only")
        .when(~whole.rlike("[0-9]"), "no_digits")
        .when(whole.contains("---"), "long_minus_run")
        .when(body.rlike(CHAMFER), F.when(qualified, "invalid_qualifier").otherwise("ok"))
        .when((quantity != "") & ((F.length(quantity) > 3) | ~quantity.rlike("[1-9]")), "invalid_quantity")
        .when(main == "", "missing_main")
        .when(tolerance.contains("°") & ~main.endswith("°"), "invalid_degree_unit")
        .when(~main.rlike(MAIN), "invalid_main_number")
        .when((tolerance != "") & ~tolerance.rlike(TOLERANCE), "invalid_tolerance_number")
        .when((tolerance != "") & qualified, "invalid_qualifier")
        .otherwise("ok")
    )


def blocks_output(why: Column) -> Column:
    return why.isin(BLOCKING)


def syntax_label(text: Column, drops: Column | None = None) -> Column:
    """Advisory label; a dropped glyph (`drops`: array of reasons) outweighs the text itself."""
    unread = F.lit(False) if drops is None else F.coalesce(F.arrays_overlap(drops, F.array(*map(F.lit, UNREAD))), F.lit(False))
    return F.when(unread, "unread_glyph_present").when(reason(text) == "ok", "ok").when(text.rlike(PARTIAL), "incomplete_separator").otherwise("invalid_dimension_syntax")
