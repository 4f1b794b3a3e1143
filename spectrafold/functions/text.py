"""Labels, ids in file names and header cells."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_text(value: Column) -> Column:
    """A number as it reads in a label: 15 significant digits at most, in the shorter notation.

    30 rather than 30.0, 0.3 for the sum of 0.1 and 0.2, 1e-05, 1e+05 but 123456. Where plain and
    exponent notation are equally long the plain one is taken.
    """
    value = value.cast("double")
    return _once(F.format_string("%.14e", F.abs(value)), lambda written: _shorter(value, written))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _shorter(value: Column, written: Column) -> Column:
    """The shorter notation of a number ``written`` with an exponent."""
    power = F.split_part(written, F.lit("e"), F.lit(2)).try_cast("int").alias("power")
    digits = F.replace(F.split_part(written, F.lit("e"), F.lit(1)), F.lit("."), F.lit(""))
    digits = F.regexp_replace(digits, "(?<=.)0+$", "").alias("digits")
    return _once(F.struct(power, digits), lambda parts: _notation(value, parts["power"], parts["digits"]))


def _notation(value: Column, power: Column, digits: Column) -> Column:
    many = F.length(digits)
    first, rest = F.substr(digits, F.lit(1), power + 1), F.substr(digits, power + 2)
    plain = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(many <= power + 1, F.rpad(digits, power + 1, F.lit("0")))
        .otherwise(F.concat(first, F.lit("."), rest))
    )
    mantissa = F.when(many > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2))))
    exponent = F.concat(
        F.coalesce(mantissa, digits), F.lit("e"), F.when(power < 0, "-").otherwise("+"),
        F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"),
    )
    both = F.struct(plain.alias("plain"), exponent.alias("exponent"))
    shorter = _once(
        both, lambda x: F.when(F.length(x["plain"]) <= F.length(x["exponent"]), x["plain"]).otherwise(x["exponent"])
    )
    sign = F.when(value < 0, "-").otherwise("")
    odd = F.when(F.isnan(value), "NaN").when(F.abs(value) == float("inf"), F.concat(sign, F.lit("Inf")))
    return F.coalesce(odd, F.concat(sign, shorter))


def na_text(text: Column) -> Column:
    """Missing text prints as NA."""
    return F.coalesce(text.cast("string"), F.lit("NA"))


def label(df: DataFrame, template: str, name: str = "label") -> DataFrame:
    """Fill ``{column}`` placeholders of ``template`` from the row."""
    pieces: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if piece:
                pieces.append(F.lit(piece))
            continue
        value = F.col(piece)
        if isinstance(df.schema[piece].dataType, T.FractionalType):
            value = number_text(value)
        pieces.append(na_text(value))
    return df.withColumn(name, F.concat(*pieces))


def component_label(components: Mapping[str, Column]) -> Column:
    """Names of the components with a nonzero ratio joined by ``+``.

    An unknown ratio prints NA; a mixture without any component is a single blank.
    """
    parts = [
        F.when(ratio.isNull(), F.lit("NA")).when(ratio != 0, F.lit(name))
        for name, ratio in components.items()
    ]
    joined = F.concat_ws("+", *parts)
    return F.when(joined == "", F.lit(" ")).otherwise(joined)


def remove_literals(text: Column, *literals: str) -> Column:
    """Remove every occurrence of each literal, one literal after the other."""
    for literal in literals:
        text = F.replace(text, F.lit(literal), F.lit(""))
    return text


def sample_code(stem: Column, separator: str = "_-") -> Column:
    """The part of a file stem behind its last separator, as text."""
    return F.regexp_replace(stem, f"^.*[{separator}]", "")


def sample_number(stem: Column, separator: str = "_-") -> Column:
    """The numeric id at the end of a file stem; NULL if it is not a number."""
    return sample_code(stem, separator).try_cast("int")


def bracket_text(text: Column) -> Column:
    """The text in the first pair of parentheses; NULL if there is none."""
    return F.nullif(F.regexp_extract(text, r"\((.+?)\)", 1), F.lit(""))


def trimmed_number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def scan_mode(header: Column) -> Column:
    """Struct ``(exp_type, fixed_wavelength)`` from a scan header cell."""
    parts = F.split(header, ",")
    kind = F.when(F.get(parts, F.lit(0)).contains("Em"), F.lit("emission")).when(
        header.isNotNull(), F.lit("excitation")
    )
    fixed = F.regexp_extract(F.get(parts, F.lit(1)), "([0-9]+)", 1).try_cast("double")
    return F.struct(kind.alias("exp_type"), fixed.alias("fixed_wavelength"))


def category(value: Column, levels: Mapping[str, str]) -> Column:
    """Relabel the known levels; anything else is NULL."""
    pairs = [F.lit(x) for pair in levels.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def category_rank(value: Column, levels: list[str]) -> Column:
    """1-based position of ``value`` among ``levels``; NULL if it is not one of them."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), value), F.lit(0))
