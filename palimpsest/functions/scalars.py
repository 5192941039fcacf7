"""Scalar functions, all of them expressions that stay in the JVM."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def hex_bytes(b: Column) -> Column:
    """Lower-case hexadecimal digits, two for each byte."""
    return F.lower(F.hex(b))


def hex_clock(micros: Column) -> Column:
    """Sixteen hexadecimal digits."""
    return F.lpad(F.lower(F.hex(micros)), 16, "0")


def bytes_to_long(b: Column) -> Column:
    """The unsigned big-endian number that up to seven bytes hold."""
    return F.conv(F.hex(b), 16, 10).cast("long")


def parse_unsigned(text: Column) -> Column:
    """Decimal, octal (leading 0) or hexadecimal (0x, 0X or #) below 2**63; null for what is none of these."""
    octal = F.regexp_extract(text, "^0([0-7]+)$", 1)
    hexadecimal = F.regexp_extract(text, "^(?:0[xX]|#)([0-9a-fA-F]{1,16})$", 1)
    found = F.when(text.rlike("^(0|[1-9][0-9]*)$"), text.try_cast("decimal(38,0)")).when(octal != "", F.conv(octal, 8, 10).cast("decimal(38,0)")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("decimal(38,0)"))
    return F.when(found <= F.lit(2**63 - 1).cast("decimal(38,0)"), found.cast("long"))


def clock_add(micros: Column, n: int) -> Column:
    return micros + n


def clock_to_timestamp(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def timestamp_to_clock(t: Column) -> Column:
    return F.unix_micros(t)


def http_date(micros: Column) -> Column:
    """As in HTTP headers; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_micros(micros), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def iso_date(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd")


def to_cents(x: Column) -> Column:
    """A double as a decimal with two places: as in SQL engines that round its hundredfold, so 1.005 (which is less) gives 1.00."""
    return (F.round(x * 100).cast("long").cast("decimal(19,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def json_value(document: Column, name: str) -> Column:
    return F.get_json_object(document, f"$.{name}")


def json_path(parent: Column, name: Column) -> Column:
    """A slash between a path and the next name."""
    return F.concat_ws("/", parent, name)


def json_errors(document: Column, rules: dict[str, tuple[str, str | None]]) -> Column:
    """All errors of a document: for each name, its type and a condition on ``x``, with the path of what fails."""
    found = []
    for name, (kind, condition) in rules.items():
        raw = json_value(document, name)
        typed = raw.try_cast(kind)
        bad = F.when(raw.isNull(), F.lit(f"/{name}: required")).when(typed.isNull(), F.lit(f"/{name}: expected {kind}"))
        if condition:
            low, high = condition.split("..")
            bad = bad.when(~typed.between(float(low), float(high)), F.lit(f"/{name}: out of range {condition}"))
        found.append(bad)
    return F.array_compact(F.array(*found))


def array_put(items: Column, item: Column, same) -> Column:
    """``items`` with those that are ``same`` replaced by ``item``; put first where none is."""
    return F.when(F.exists(items, same), F.transform(items, lambda x: F.when(same(x), item).otherwise(x))).otherwise(F.concat(F.array(item), items))


def array_drop(items: Column, same) -> Column:
    return F.filter(items, lambda x: ~same(x))
