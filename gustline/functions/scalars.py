"""Numbers, text and time."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _plain(form: str) -> tuple[str, str]:
    """Characters that a Unicode form takes apart into one ASCII character and marks, and those characters."""
    apart = {c: "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x)) for c in map(chr, [*range(0xA0, 0x2000), *range(0xFF01, 0xFF5F)])}
    single = {c: x for c, x in apart.items() if len(x) == 1 and x.isascii()}
    return "".join(single), "".join(single.values())


#: Letters with marks and what they fold to; the second pair has characters of like use too (raised digits, wide letters).
MARKED, FOLDED = _plain("NFD")
LIKE, PLAIN = _plain("NFKD")


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def local_number(text: Column) -> Column:
    """Text as a number: with a decimal comma, points group thousands; without, it is read as it is; what is no number is null."""
    text = F.trim(text)
    plain = F.when(F.contains(text, F.lit(",")), F.translate(F.replace(text, F.lit("."), F.lit("")), ",", ".")).otherwise(text)
    return finite(plain.try_cast("double"))


def fold(text: Column) -> Column:
    """Without marks, whether they are part of a letter or follow it, in plain characters, upper case, trimmed; characters that stand for several letters stay."""
    return F.upper(F.trim(F.regexp_replace(F.translate(text, LIKE, PLAIN), r"\p{M}+", "")))


def code_root(code: Column) -> Column:
    """A registry code without its last numeric suffix; missing codes are empty."""
    clean = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(clean.isin("", "-"), "").otherwise(F.regexp_replace(clean, r"\.\d+$", ""))


def safe_stem(name: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores."""
    return F.regexp_replace(F.translate(name, MARKED, FOLDED), r"[^A-Za-z0-9._-]+", "_")


def version_normal(version: Column) -> Column:
    """12.03.04 -> 12.3.4"""
    return F.array_join(F.transform(F.split(version, r"\."), lambda x: x.try_cast("int").cast("string")), ".")


def hour_floor(t: Column) -> Column:
    """The full hour, whatever the session's zone."""
    return t - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(t), F.extract(F.lit("SECOND"), t))


def half_hour_floor(t: Column) -> Column:
    return hour_floor(t) + F.make_dt_interval(F.lit(0), F.lit(0), F.when(F.minute(t) >= 30, 30).otherwise(0))


def hour_index(t: Column) -> Column:
    """Hours since 1970-01-01 00:00 of the wall clock."""
    return (F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")) * 24 + F.hour(t)).cast("long")


def month_label(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def apart(x: Column) -> Column:
    """The value, computed once: a projection that asks for the partition's number is one that the optimizer neither merges with the next nor writes into a filter."""
    return F.when(F.spark_partition_id() >= 0, x)


def to_utc_strict(local: Column, zone: str) -> Column:
    """A wall-clock time (no zone) in UTC; null where the zone has no such time or has it twice."""
    utc = F.to_utc_timestamp(local, zone).cast("timestamp_ntz")
    back = lambda u: F.from_utc_timestamp(u, zone).cast("timestamp_ntz")
    hour = F.make_dt_interval(F.lit(0), F.lit(1))
    sure = (back(utc) == local) & (back(utc + hour) != local) & (back(utc - hour) != local)
    return F.when(sure, utc)


def strict_iso_hour(text: Column) -> Column:
    """ISO text with an offset, at a full hour, as a timestamp; else null."""
    t = F.when(F.rlike(text, F.lit(r"(Z|[+-]\d{2}:?\d{2})$")), F.try_to_timestamp(text))
    return F.when((F.minute(t) == 0) & (F.second(t) == 0), t)


def active_at(t: Column, start: Column, end: Column) -> Column:
    """Whether a relation holds at t: from its start, through the whole day of its end; null bounds are open."""
    return (start.isNull() | (start <= t)) & (end.isNull() | (t < end + F.make_dt_interval(F.lit(1))))


def fixed_number(x: Column, width: int, digits: tuple[int, ...] = (3, 2, 1, 0)) -> Column:
    """The number in ``width`` characters, right-aligned, with as many decimals as fit; null if none does, and for null."""
    options = [F.when(x.isNotNull(), F.format_string(f"%.{d}f", x.cast("double"))) for d in digits]
    return F.coalesce(*(F.when(F.length(o) <= width, F.lpad(o, width, " ")) for o in options))


def implied_decimal(text: Column, whole: int) -> Column:
    """Digits with a point implied after the first ``whole`` of them."""
    text = F.trim(text)
    return F.concat(F.substring(text, 1, whole), F.lit("."), F.substring(text, whole + 1, 32)).try_cast("double")


def fingerprint(*columns: Column) -> Column:
    """SHA-256 over the columns as text with separators; null differs from empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns)), 256)


def date_guard(t: Column, first: str, last: str, availability: Column) -> Column:
    """Why a time can't be asked for: before the first day, behind the last, or an availability outside 0 to 1; else ok."""
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return F.when(t < day(first), "too_early").when(t > day(last), "in_future").when(~F.coalesce(availability.between(0, 1), F.lit(False)), "availability").otherwise("ok")


def unmarked(text: Column) -> Column:
    """Without marks on letters, case as it was."""
    return F.translate(text, MARKED, FOLDED)


def plain_number(text: Column) -> Column:
    """Trimmed text as a finite number, else null."""
    return finite(F.trim(text).try_cast("double"))


def implied_number(text: Column, whole: int) -> Column:
    """A field with a point implied after its first ``whole`` characters; with a point or an exponent, and the marks 99999 and -9999, it is read as it is."""
    trimmed = F.trim(text)
    spelt = F.contains(trimmed, F.lit(".")) | F.contains(F.upper(trimmed), F.lit("E")) | trimmed.isin("99999", "-9999")
    implied = F.concat(F.substring(text, 1, whole), F.lit("."), F.substring(text, whole + 1, 32))
    return F.when(trimmed != "", F.when(spelt, plain_number(text)).otherwise(plain_number(implied)))


def year_in(text: Column, pattern: str) -> Column:
    """The first number from 1900 to 2099 that the pattern's first group finds, else null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    return F.get(F.filter(found, lambda x: x.between(1900, 2099)), F.lit(0))


def significant(x: Column, digits: int = 9) -> Column:
    """A number as text with so many significant digits and no zeros at the end (``%.9g`` in C): plain from 0.0001 to below 10^digits, with an exponent elsewhere; minus zero is 0.

    Below 2.3e-308, where doubles lose digits, a number has only the digits that tell it from its neighbours (5e-324 is 4.9e-324).
    """
    x = x.cast("double")
    text = F.format_string(f"%.{digits - 1}e", x)
    cut = lambda s: F.regexp_replace(s, r"\.?0+$", "")
    mantissa, power = F.substring_index(text, "e", 1), F.substring_index(text, "e", -1)
    plain = cut(F.format_string("%s", text.try_cast(f"decimal({2 * digits + 4},{digits + 3})")))
    return F.when(x.isNull(), None).when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(x == 0, "0").when(power.try_cast("int").between(-4, digits - 1), plain).otherwise(F.concat(cut(mantissa), F.lit("e"), power))
