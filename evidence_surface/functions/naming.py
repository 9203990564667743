"""Names, labels and texts of outputs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def age_from_name(name: Column) -> Column:
    """Digits before the first `_<digits>_ma` of a name, else 0."""
    digits = F.regexp_extract(name, r"_(\d+)_ma", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def age_label(age: Column) -> Column:
    return F.concat(age.cast("string"), F.lit(" Ma"))


def title_label(base: Column) -> Column:
    return F.replace(base, F.lit("_"), F.lit(" "))


def params_suffix(power: float, gradient_sharp: float) -> str:
    return f"_power{float(power)}_gradient_sharp{float(gradient_sharp)}"


def output_path(folder: str, base: Column, method: str, suffix: str, ext: str = ".html") -> Column:
    return F.concat(F.lit(f"{folder}/map_"), base, F.lit(f"_{method}{suffix}{ext}"))


def pdf_path(path: Column) -> Column:
    return F.replace(path, F.lit(".html"), F.lit(".pdf"))


def fmt_pct(value: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(value, digits), F.lit("%"))
