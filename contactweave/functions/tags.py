"""Optional GFA tags ``TAG:TYPE:VALUE`` as a map of typed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# For each type letter the text a value must contain; the first match counts.
VALUE_PATTERNS = {
    "A": r"[!-~]",
    "i": r"[-+]?[0-9]+",
    "f": r"[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?",
    "Z": r"[ !-~]+",
    "H": r"[0-9A-F]+",
    "J": r"[ !-~]+",
    "B": r"[ !-~]+",
}

TAG_VALUE = "struct<type:string,a:string,i:bigint,f:double,h:array<bigint>,z:string>"


def tag_value(field: Column) -> Column:
    """Typed value of one tag field, null if its name, type or value is malformed.

    J and B values are kept as text.
    """
    kind = F.substring(field, 4, 1)
    text = F.substring(field, 6, 1 << 30)
    hit = F.lit(None).cast("string")
    for letter, pattern in VALUE_PATTERNS.items():
        found = F.regexp_extract(text, pattern, 0)
        hit = F.when(kind == letter, F.when(found != "", found)).otherwise(hit)
    digits = F.transform(
        F.split(hit, ""), lambda d: F.conv(d, 16, 10).cast("bigint")
    )
    only = lambda letters, value, type_: F.when(kind.isin(*letters), value).cast(type_)
    value = F.struct(
        kind.alias("type"),
        only("A", hit, "string").alias("a"),
        F.when(kind == "i", hit.try_cast("bigint")).alias("i"),
        F.when(kind == "f", hit.try_cast("double")).alias("f"),
        F.when(kind == "H", digits).alias("h"),
        only("ZJB", hit, "string").alias("z"),
    ).cast(TAG_VALUE)
    named = F.substring(field, 1, 2).rlike("^[A-Za-z][A-Za-z0-9]$")
    fits = hit.isNotNull() & ((kind != "i") | hit.try_cast("bigint").isNotNull())
    return F.when(named & fits, value)


def parse_tags(fields: Column) -> Column:
    """Map of tag name to typed value from an array of tag fields; later names win."""
    entries = F.transform(
        fields,
        lambda f: F.struct(F.substring(f, 1, 2).alias("key"), tag_value(f).alias("value")),
    )
    good = F.filter(entries, lambda e: e["value"].isNotNull())
    # Later entries win without touching the session's duplicate-key setting.
    last = F.filter(
        good,
        lambda e, at: ~F.exists(
            F.slice(good, at + F.lit(2), F.greatest(F.size(good), F.lit(1))),
            lambda later: later["key"] == e["key"],
        ),
    )
    return F.map_from_entries(last)


def show_tag(value: Column) -> Column:
    """``TYPE:VALUE`` text; hex digits in lower case."""
    hexed = F.array_join(F.transform(value["h"], lambda d: F.lower(F.hex(d))), "")
    shown = (
        F.when(value["type"] == "A", value["a"])
        .when(value["type"] == "i", value["i"].cast("string"))
        .when(value["type"] == "f", _plain_double(value["f"]))
        .when(value["type"] == "H", hexed)
        .otherwise(value["z"])
    )
    return F.concat(value["type"], F.lit(":"), shown)


def _plain_double(x: Column) -> Column:
    """Shortest decimal text without an exponent and without a trailing ``.0``."""
    text = x.cast("string")
    parts = r"^-?([0-9]+)\.([0-9]+)E(-?[0-9]+)$"
    whole, after = F.regexp_extract(text, parts, 1), F.regexp_extract(text, parts, 2)
    power = F.regexp_extract(text, parts, 3).try_cast("int")
    after = F.when(after == "0", "").otherwise(after)
    digits = F.concat(whole, after)  # the point stands after ``whole``, one digit
    padded = F.rpad(digits, F.greatest(F.length(digits), power + 1), F.lit("0"))
    large = F.concat(F.substring(padded, F.lit(1), power + 1), F.lit("."), F.substring(padded, power + 2, F.length(padded)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    moved = F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.when(power >= 0, large).otherwise(small))
    return F.regexp_replace(F.when(text.contains("E"), moved).otherwise(text), r"\.0*$", "")


def int_tag(tags: Column, name: str) -> Column:
    """A non-negative integer tag such as LN, RC, FC or KC."""
    return F.try_element_at(tags, F.lit(name))["i"]


def text_tag(tags: Column, name: str) -> Column:
    """A text tag such as the header's VN."""
    held = F.try_element_at(tags, F.lit(name))
    return F.when(held["type"] == "Z", held["z"])
