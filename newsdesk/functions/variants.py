"""JSON values of any shape as VARIANT: typed access that takes no value for another type, and JSON as JavaScript prints it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsdesk.functions.text import once


def kind(v: Column) -> Column:
    """string, number, boolean, null, array or object; null where nothing is."""
    of = F.schema_of_variant(v)
    return (
        F.when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").when(of == "VOID", "null").when(F.startswith(of, F.lit("ARRAY")), "array")
        .when(F.startswith(of, F.lit("OBJECT")), "object").when(of.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), "number")
    )


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def string_at(v: Column, path: str) -> Column:
    """The string there; null if there is anything else."""
    return F.when(kind(at(v, path)) == "string", F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    """The number there; null if there is anything else."""
    return F.when(kind(at(v, path)) == "number", F.try_variant_get(v, path, "double"))


def strings_at(v: Column, path: str) -> Column:
    """The strings of the list there, other elements left out; empty if there is no list."""
    found = F.try_variant_get(v, path, "array<variant>")
    return F.coalesce(F.transform(F.filter(found, lambda x: kind(x) == "string"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def number_text(x: Column) -> Column:
    """A double as JavaScript prints it: no exponent from 1e-6 to below 1e21, else one with its sign."""

    def of(s: Column) -> Column:
        sign = F.when(F.startswith(s, F.lit("-")), "-").otherwise("")
        plain = F.regexp_replace(s, "^-", "")
        mantissa = F.regexp_replace(F.regexp_extract(plain, r"^([0-9.]+)", 1), r"\.0+$|(\.\d*?)0+$", "$1")
        power = F.coalesce(F.nullif(F.regexp_extract(plain, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
        whole, part = F.substring_index(mantissa, ".", 1), F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise("")
        digits = F.regexp_replace(F.concat(whole, part), "^0+(?=.)", "")
        # Where the point stands, counted from the first digit that isn't zero.
        point = power + F.length(whole) - (F.length(whole) + F.length(part) - F.length(digits))
        short = F.regexp_replace(digits, "(?<=.)0+$", "")
        n = F.length(short)
        decimal = (
            F.when(point >= n, F.concat(short, F.repeat(F.lit("0"), point - n)))
            .when(point > 0, F.concat(F.substr(short, F.lit(1), point), F.lit("."), F.substr(short, point + 1)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), short))
        )
        exponent = F.concat(F.substr(short, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(short, F.lit(2)))).otherwise(""), F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string"))
        return F.when(short == "0", "0").when((point > -6) & (point <= 21), F.concat(sign, decimal)).otherwise(F.concat(sign, exponent))

    return once(x.cast("string"), of)


def canonical(v: Column) -> Column:
    """JSON with the keys of every object in order, no spaces, numbers as JavaScript prints them, and nulls kept."""
    # Objects keep their fields in order of their names; strings pass whole, what stands between them holds the numbers.
    parts = F.regexp_extract_all(F.to_json(v), F.lit(r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+\-]*+|[^"0-9\-]++'), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^-?[0-9]"), number_text(p.try_cast("double"))).otherwise(p)), "")
