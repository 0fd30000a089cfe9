"""Column-level text helpers (built-in expressions only, so they stay in codegen)."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's catalogue rules.
# Colour words checked in this order against the lower-cased product name.
COLOR_WORDS = ["red", "blue", "green", "yellow", "black", "white", "grey", "gray",
               "purple", "orange", "brown", "pink", "silver", "gold", "beige"]
# Season keywords (English and Norwegian) checked as substrings of name and category names.
SEASON_TERMS = {
    "winter": ["winter", "vinter", "snow", "snø", "christmas", "jul"],
    "spring": ["spring", "vår", "easter", "påske"],
    "summer": ["summer", "sommer", "beach", "strand", "pool", "swimming", "swimwear"],
    "fall": ["fall", "autumn", "høst", "halloween"],
}
# Property keys tried in order for colour; attribute keys appended to generated descriptions.
COLOR_PROPERTY_KEYS = ["Color", "Farge", "colour", "Colour", "color"]
DESCRIPTION_ATTRIBUTE_KEYS = ["Material", "Size", "Weight", "Color", "Farge"]
# Age patterns tried in order on the product name (month, Norwegian "år", year).
AGE_PATTERNS = [r"(\d+)-(\d+)\s+month", r"(\d+)-(\d+)\s+år", r"(\d+)-(\d+)\s+year"]


def capitalize(c: Column) -> Column:
    """First character upper, the rest lower (Python ``str.capitalize``)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def slug(c: Column) -> Column:
    """Lower-case and replace spaces with dashes."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def color_from_name(name: Column) -> Column:
    """First colour word contained in the lower-cased name, capitalised; else null."""
    low = F.lower(name)
    expr = F.lit(None).cast("string")
    for word in reversed(COLOR_WORDS):
        expr = F.when(low.contains(word), F.lit(word.capitalize())).otherwise(expr)
    return expr


def seasons_from_text(*texts: Column) -> Column:
    """Sorted distinct seasons whose keywords occur in any of the given texts; null if none."""
    lows = [F.lower(F.coalesce(t, F.lit(""))) for t in texts]
    hits = []
    for season, terms in SEASON_TERMS.items():
        cond = None
        for low in lows:
            for term in terms:
                c = low.contains(term)
                cond = c if cond is None else (cond | c)
        hits.append(F.when(cond, F.lit(season)))
    arr = F.array_sort(F.array_compact(F.array(*hits)))
    return F.when(F.size(arr) > 0, arr)


def season_of_month(ts: Column) -> Column:
    """Meteorological season of a timestamp's month."""
    m = F.month(ts)
    return (F.when(m.between(3, 5), "spring").when(m.between(6, 8), "summer")
            .when(m.between(9, 11), "autumn").otherwise("winter"))


def matches_pattern(c: Column, pattern: str) -> Column:
    """The opt-in raw pattern: case-insensitive beyond ASCII too."""
    return F.coalesce(F.regexp_like(c, F.lit("(?iu)" + pattern)), F.lit(False))


def quote_regex(c: Column) -> Column:
    """Literal regex for a user string (``\\Q..\\E`` quoting, also where it holds ``\\E``)."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def tokens(c: Column) -> Column:
    """Lower-cased Unicode letter/digit runs."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)
