"""Text helpers for request strings and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_decode(text: Column) -> Column:
    """Plus to space and %xx to its byte; %00 is dropped and a stray % is kept."""
    kept = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.regexp_replace(kept, "%00", ""))


def json_escape(text: Column) -> Column:
    """Backslash and quote escaped for JSON."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')


def tokens(text: Column, delimiter: str) -> Column:
    """Split at the delimiter; empty parts are skipped."""
    import re

    return F.filter(F.split(text, re.escape(delimiter)), lambda t: t != "")


def http_date(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def resolve_path(text: Column, prefix: str = "", suffix: str = "") -> Column:
    """Decode, then take out every '../', also those that only appear by taking out others."""
    decoded = url_decode(text)
    # Leftmost removal until stable; each pass removes one, and there are at most length/3 of them.
    rounds = F.sequence(F.lit(0), F.floor(F.length(decoded) / 3).cast("int"))
    first = lambda s: F.when(F.locate("../", s) > 0, F.concat(F.substring(s, F.lit(1), F.locate("../", s) - 1), F.substring(s, F.locate("../", s) + 3, F.length(s)))).otherwise(s)
    clean = F.when(F.locate("../", decoded) > 0, F.aggregate(rounds, decoded, lambda s, _: first(s))).otherwise(decoded)
    return F.concat(F.lit(prefix), clean, F.lit(suffix))


def nine_digits(v: Column) -> Column:
    """A number with at most nine significant digits, as C's %.9g writes it."""
    v = v.cast("double")
    sci = F.format_string("%.8e", v)
    exponent = F.regexp_extract(sci, r"e([+-]\d+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(sci, r"^([^e]+)e", 1), r"\.?0+$", "")
    plain = F.regexp_replace(sci.cast("double").cast("decimal(30,14)").cast("string"), r"\.?0+$", "")
    small = (exponent >= 9) | (exponent < -4)
    return F.when(v == 0, "0").when(small, F.concat(mantissa, F.regexp_extract(sci, r"(e.*)$", 1))).otherwise(plain)
