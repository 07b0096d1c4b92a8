"""Canonical JSON as Columns: sorted keys, no spaces, escapes for all that is not ASCII, numbers
as Python writes them. What signatures are made over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: Escapes with a letter of their own, after their units have been written as four digits.
SHORT = (("0008", "b"), ("0009", "t"), ("000a", "n"), ("000c", "f"), ("000d", "r"))


def string(text: Column) -> Column:
    """A JSON string. Runs of characters that need one are escaped by their UTF-16 units."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def escaped(run: Column) -> Column:
        units = F.lower(F.hex(F.encode(run, "UTF-16BE")))
        out = F.regexp_replace(units, "(.{4})", "\\\\u$1")
        for code, letter in SHORT:
            out = F.replace(out, F.lit(f"\\u{code}"), F.lit(f"\\{letter}"))
        return out

    runs = F.regexp_extract_all(plain, F.lit("[ -~]+|[^ -~]+"), 0)
    whole = F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[ -~]"), r).otherwise(escaped(r))), "")
    return F.concat(F.lit('"'), F.when(text.rlike("^[ !#-\\[\\]-~]*$"), text).otherwise(whole), F.lit('"'))


def double(x: Column) -> Column:
    """A number with a fraction or an exponent: plain from 1e-4 up to 1e16. Its digits are those
    that the JVM finds, which for a few numbers before Java 19 are not the fewest."""
    text = x.cast("string")
    power = F.coalesce(F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    sign, mantissa = F.regexp_extract(text, "^(-?)", 1), F.regexp_extract(text, "^-?([0-9.]+)", 1)
    short = F.regexp_replace(mantissa, "\\.0$", "")
    digits = F.replace(short, F.lit("."), F.lit(""))
    point = power + 1
    large = F.when(F.length(digits) <= point, F.concat(F.rpad(digits, point, "0"), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    rest = F.concat(short, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), "0"))
    written = F.when(power.between(1, 15), large).when(power.between(-4, -1), small).otherwise(rest)
    return F.when(text.contains("E"), F.concat(sign, written)).otherwise(text)


def json(value: Column, kind: Y.DataType) -> Column:
    """value as JSON. Null fields of a struct are left out, other nulls written; maps have
    strings for keys."""
    if isinstance(kind, Y.StructType):
        parts = [F.when(value[f.name].isNotNull(), F.concat(string(F.lit(f.name)), F.lit(":"), json(value[f.name], f.dataType))) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, Y.MapType):
        entry = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), F.concat(string(e["key"]), F.lit(":"), json(e["value"], kind.valueType)).alias("text")))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(entry), lambda e: e["text"]), ","), F.lit("}"))
    elif isinstance(kind, Y.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, (Y.DoubleType, Y.FloatType)):
        out = double(value.cast("double"))
    elif isinstance(kind, (Y.BooleanType, Y.IntegralType)):
        out = value.cast("string")
    elif isinstance(kind, Y.StringType):
        out = string(value)
    else:
        raise TypeError(f"no canonical JSON of {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)
