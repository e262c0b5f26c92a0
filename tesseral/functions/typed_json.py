"""Strict types for JSON: a schema compiled into predicates over VARIANT.

from_json turns 1 into "1" and "7" into null without a word. Here a value must have the schema's type as
it stands in the text; each place where it has not gives an error with its path.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERRORS = "array<string>"
#: Bits of the whole numbers.
WHOLE = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
#: What parses as a time or bytes stands in JSON as a string.
IN_STRINGS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _none() -> Column:
    return F.array().cast(ERRORS)


def _told(path: Column, *what: Column | str) -> Column:
    return F.array(F.concat(path, F.lit(": "), *(F.lit(w) if isinstance(w, str) else w for w in what)))


def _unless(fine: Column, path: Column, *what: Column | str) -> Column:
    return F.when(fine, _none()).otherwise(_told(path, *what))


def _atom(value: Column, kind: Column, of: T.DataType, path: Column) -> Column:
    """The error of a value that is neither null nor nested, if it has not the type."""
    name, number = of.simpleString(), kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    expected = ("expected ", name, ", got ", F.lower(F.regexp_replace(kind, "[<(].*", "")))
    if isinstance(of, T.VariantType):
        return _none()
    if type(of) in WHOLE:
        # whole numbers beyond 64 bits parse as decimals of 19 digits or more without places
        large = kind.rlike(r"^DECIMAL\((19|[2-9]\d),0\)")
        bits = WHOLE[type(of)]
        n = F.try_variant_get(value, "$", "bigint")
        within = F.lit(True) if bits == 64 else n.between(-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
        return F.when((kind == "BIGINT") & within, _none()).when((kind == "BIGINT") | large, _told(path, f"out of range for {name}")).otherwise(_told(path, *expected))
    if isinstance(of, T.FractionalType):
        fits = F.try_variant_get(value, "$", name)
        if isinstance(of, T.DecimalType):
            fits = F.when(fits == F.try_variant_get(value, "$", "decimal(38,18)"), fits)
        return F.when(~number, _told(path, *expected)).when(fits.isNull(), _told(path, f"out of range for {name}")).otherwise(_none())
    if isinstance(of, T.BooleanType):
        return _unless(kind == "BOOLEAN", path, *expected)
    if isinstance(of, IN_STRINGS):
        return F.when(kind != "STRING", _told(path, *expected)).otherwise(_unless(F.try_variant_get(value, "$", "string").try_cast(of).isNotNull(), path, f"not a {name}"))
    if isinstance(of, T.StringType):
        return _unless(kind == "STRING", path, *expected)
    raise TypeError(f"no JSON form for {name}")


def _object(value: Column, of: T.StructType, path: Column, place: str, optional: Collection[str], closed: bool) -> Column:
    def fields(entries: Column) -> Column:
        keys, parts = F.map_keys(entries), []
        for f in of.fields:
            inner = f"{place}.{f.name}" if place else f.name
            at = F.concat(path, F.lit(f".{f.name}"))
            gone = _none() if inner in optional else _told(at, "missing")
            own = _errors(F.try_element_at(entries, F.lit(f.name)), f.dataType, at, inner, f.nullable, optional, closed)
            parts.append(F.when(F.array_contains(keys, f.name), own).otherwise(gone))
        if closed:
            more = F.array_sort(F.array_except(keys, F.array(*(F.lit(f.name) for f in of.fields)).cast(ERRORS)))
            parts.append(F.transform(more, lambda k: F.concat(path, F.lit("."), k, F.lit(": not expected"))))
        return F.concat(*parts) if parts else _none()

    return _let(F.try_variant_get(value, "$", "map<string,variant>"), fields)


def _errors(value: Column, of: T.DataType, path: Column, place: str, nullable: bool, optional: Collection[str], closed: bool) -> Column:
    def of_kind(kind: Column) -> Column:
        got = F.lower(F.regexp_replace(kind, "[<(].*", ""))
        if isinstance(of, T.StructType):
            rest = F.when(kind.startswith("OBJECT"), _object(value, of, path, place, optional, closed)).otherwise(_told(path, "expected object, got ", got))
        elif isinstance(of, T.ArrayType):
            each = lambda v, i: _errors(v, of.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), f"{place}[]", of.containsNull, optional, closed)
            every = F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), each))
            rest = F.when(kind.startswith("ARRAY"), every).otherwise(_told(path, "expected array, got ", got))
        elif isinstance(of, T.MapType):
            each = lambda e: _errors(e["value"], of.valueType, F.concat(path, F.lit("."), e["key"]), f"{place}.*", of.valueContainsNull, optional, closed)
            every = F.flatten(F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), each))
            rest = F.when(kind.startswith("OBJECT"), every).otherwise(_told(path, "expected object, got ", got))
        else:
            rest = _atom(value, kind, of, path)
        if isinstance(of, T.VariantType):
            return rest
        return F.when(kind == "VOID", _none() if nullable else _told(path, "null")).otherwise(rest)

    return _let(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), of_kind)


def type_errors(value: Column, schema: T.StructType | str, *, optional: Collection[str] = (), closed: bool = False) -> Column:
    """An array with an error for each place where a VARIANT is not of the schema, in the schema's order.

    Every key must be there unless its place is listed in `optional` (`views[].sha256`: of the objects in
    an array; `.*` of those in a map). Null is of a type only where the schema lets it. With `closed`
    other keys than the schema's are errors. A number is whole if it is written without point and
    exponent; any number is a double; times are strings that Spark reads as such.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return _errors(value, schema, F.lit("$"), "", False, optional, closed)
