"""Class codes, their numbers and colours, and text fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Class -> (number, colour); any other class is semi-arid in
# number and gray in colour.
CLASS_VALUE = {"H": 3.0, "S": 2.0, "D": 1.0}
CLASS_COLOUR = {"H": "#0798db", "S": "#0a7a18", "D": "#eaf51d"}
OTHER_VALUE = 2.0
OTHER_COLOUR = "gray"
MISSING = "N/A"


def _lookup(code: Column, table: dict, other) -> Column:
    result = F
    for key, out in table.items():
        result = result.when(code == key, F.lit(out))
    return result.otherwise(F.lit(other))


def climate_value(code: Column) -> Column:
    return _lookup(code, CLASS_VALUE, OTHER_VALUE)


def climate_colour(code: Column) -> Column:
    return _lookup(code, CLASS_COLOUR, OTHER_COLOUR)


def climate_code(code: Column) -> Column:
    """Position of the class in CLASS_COLOUR, or one beyond: a number that an
    aggregate keeps in place."""
    return _lookup(code, {key: n for n, key in enumerate(CLASS_COLOUR)}, len(CLASS_COLOUR))


def code_colour(number: Column) -> Column:
    return _lookup(number, dict(enumerate(CLASS_COLOUR.values())), OTHER_COLOUR)


def or_default(text: Column, default: str = MISSING) -> Column:
    """Default for null and empty text."""
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text)


def age_or_default(text: Column, default: str = MISSING) -> Column:
    """As `or_default`, and a numeric zero counts as missing too."""
    return F.when(text.try_cast("double") == 0, F.lit(default)).otherwise(
        or_default(text, default)
    )
