"""Normalisers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of addresses and the words they stand for, applied in this order.
ABBREVIATIONS = (
    ("rd", "road"), ("st", "street"), ("ave", "avenue"), ("apt", "apartment"), ("fl", "floor"), ("blvd", "boulevard"),
    ("ln", "lane"), ("ct", "court"), ("pl", "place"), ("ste", "suite"), ("sec", "sector"), ("no", "number"),
)
# Shapes of dates and their formats, first that fits wins (day before month).
DATE_FORMATS = ((r"^\d{1,2}-\d{1,2}-\d{4}$", ("d-M-yyyy", "M-d-yyyy")), (r"^\d{4}-\d{1,2}-\d{1,2}$", ("yyyy-M-d",)), (r"^\d{1,2} [A-Za-z]+ \d{4}$", ("d MMM yyyy", "d MMMM yyyy")))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def capitalize(c: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def normalize_string(c: Column) -> Column:
    """Lower case words of letters, digits and underscores, one space apart; null is ''."""
    return squeeze(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\p{L}\p{N}_\s]", " ")))


def normalize_address(c: Column) -> Column:
    """``normalize_string`` with abbreviations written out.

    No expansion makes another abbreviation, so one pass over the words gives
    what replacing one abbreviation after the other gives.
    """
    pairs = [F.lit(x) for pair in ABBREVIATIONS for x in pair]
    words = F.split(normalize_string(c), " ")
    table = F.create_map(*pairs)
    return F.array_join(F.transform(words, lambda w: F.coalesce(table[w], w)), " ")


def clean_spacing(c: Column) -> Column:
    """Spaces between fused words, after care-of marks and house-number marks; squeezed."""
    s = F.coalesce(c, F.lit(""))
    s = F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"(?i)\b([dswc]/o)([a-zA-Z])", "$1 $2")
    s = F.regexp_replace(s, r"(?i)\b(hno|h\.no|house\s*no)([0-9])", "$1 $2")
    return squeeze(s)


def normalize_date(c: Column) -> Column:
    """``yyyy-MM-dd``, or ``yyyy`` for a year alone, or the cleaned text if no format fits."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    clean = F.regexp_replace(F.regexp_replace(bare, r"^[.,;:()]+|[.,;:()]+$", ""), r"[./]", "-")

    def dated(x: Column) -> Column:
        even = F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^(\d{1,2})-([A-Za-z]+)-(\d{4})$", "$1 $2 $3")
        # Java would read a long run of digits as a year: the shape is checked first
        day = lambda y: F.coalesce(*[F.when(y.rlike(shape), F.coalesce(*[F.try_to_date(y, f) for f in formats])) for shape, formats in DATE_FORMATS])
        return F.coalesce(F.date_format(let(even, day), "yyyy-MM-dd"), x)

    return let(clean, dated)


def gender_of_text(c: Column) -> Column:
    """Gender as extraction reads it: by substring."""
    s = F.lower(F.trim(c))
    return F.when(s.rlike("female|^f$"), "Female").when(s.rlike("male|^m$"), "Male").when(s.rlike("trans|^t$"), "Transgender").otherwise(capitalize(F.trim(c)))


def gender_of_form(c: Column) -> Column:
    """Gender as comparison reads it: by whole word."""
    s = F.lower(F.trim(c))
    return F.when(s.rlike(r"\bfemale\b|^f$"), "Female").when(s.rlike(r"\bmale\b|^m$"), "Male").when(s.rlike(r"\btransgender\b|^t$"), "Transgender").otherwise(capitalize(F.trim(c)))


def normalize_id(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))
