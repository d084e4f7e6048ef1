"""Dictionaries as maps, arrays and JSON: typed reading, change, merging and paths, all of it native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(m: Column, key: str) -> Column:
    """Null for a key that isn't there."""
    return F.try_element_at(m, F.lit(key))


def get_int(m: Column, key: str) -> Column:
    """A whole number; null for anything else, rather than an error."""
    return get(m, key).try_cast("long")


def get_real(m: Column, key: str) -> Column:
    return get(m, key).try_cast("double")


def insert(m: Column, key: str, value: Column) -> Column:
    """The map with one entry put or replaced; a new one comes last."""
    return F.when(
        F.map_contains_key(m, key),
        F.transform_values(m, lambda k, v: F.when(k == key, value).otherwise(v)),
    ).otherwise(F.map_concat(m, F.create_map(F.lit(key), value)))


def without(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def contains(m: Column, key: str) -> Column:
    return F.map_contains_key(m, key)


def absorb(a: Column, b: Column) -> Column:
    """Counts of two maps added."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def json_get(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def json_kind(text: Column) -> Column:
    """object, array, string, number, boolean or null; null for what isn't JSON."""
    t = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "VOID", "null")
        .when(t.isNotNull(), "number")
    )


def probe_record(text: Column) -> Column:
    """STRUCT of a probe's record, lines of a key and its values; null unless it is version 1 and ends with done.

    warnings and capabilities repeat; the first of any other key counts.
    """
    lines = F.filter(F.split(text, "\n", -1), lambda x: x != "")
    key = lambda x: F.substring_index(x, " ", 1)
    rest = lambda x: F.regexp_replace(x, r"^\S+ ?", "")
    first = lambda k: F.get(F.transform(F.filter(lines, lambda x: key(x) == k), rest), 0)
    every = lambda k: F.transform(F.filter(lines, lambda x: key(x) == k), rest)
    warns = F.transform(every("warn"), lambda w: F.struct(F.regexp_extract(w, r"^(.*) \d+$", 1), F.regexp_extract(w, r"(\d+)$", 1).try_cast("int")))
    made = F.struct(
        first("file").alias("path"),
        (key(first("opened")) == "yes").alias("opened"),
        F.nullif(F.trim(F.regexp_replace(first("opened"), r"^\S+", "")), F.lit("")).alias("reason"),
        first("pages").try_cast("int").alias("pages"),
        first("rendered").try_cast("int").alias("rendered"),
        every("cap").alias("capabilities"),
        F.map_from_entries(warns).alias("warnings"),
        first("ms").try_cast("long").alias("millis"),
    )
    return F.when((F.element_at(lines, 1) == "probe 1") & (F.element_at(lines, -1) == "done"), made)


def fnv1a(text: Column) -> Column:
    """FNV-1a of 64 bits over UTF-8, as 16 hexadecimal digits.

    The prime is 2**40 + 0x1B3: a product goes by halves of 32 bits, so that no step overflows with an error and none is written
    out twice (sums of shifts, nested, had each the ones before several times over).
    """
    octets = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    left = lambda c, n: F.call_function("shiftleft", c, F.lit(n))

    def step(acc: Column, b: Column) -> Column:
        x = acc.bitwiseXOR(b)
        low = x.bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(0x1B3)
        high = F.shiftrightunsigned(x, 32) * F.lit(0x1B3) + F.shiftrightunsigned(low, 32) + left(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return left(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.lpad(F.lower(F.hex(F.aggregate(octets, F.lit(-3750763034362895579), step))), 16, "0")
