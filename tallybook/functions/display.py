"""Display and link functions."""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

# What every link starts with and the trackers it lists, in order.
LINK_START = "magnet:?xt=urn:btih:"
TRACKERS = (
    "udp://93.158.213.92:1337/announce",
    "udp://151.242.104.187:80/announce",
    "udp://91.216.110.53:451/announce",
    "udp://185.121.168.96:1337/announce",
    "udp://43.250.54.126:6969/announce",
    "udp://34.66.57.33:80/announce",
    "udp://34.66.57.33:1337/announce",
    "udp://109.201.134.183:80/announce",
    "udp://45.137.199.107:6969/announce",
    "udp://135.125.198.235:1984/announce",
    "udp://211.75.210.221:80/announce",
    "udp://209.141.59.25:6969/announce",
    "udp://211.75.210.221:6969/announce",
    "http://211.75.210.221:6969/announce",
    "udp://83.102.180.21:80/announce",
    "udp://31.56.179.159:6969/announce",
    "udp://65.109.28.17:6969/announce",
    "udp://95.217.80.20:6969/announce",
    "udp://95.217.80.22:6969/announce",
    "udp://65.109.28.33:6969/announce",
)
LINK_END = "".join("&tr=" + quote(t, safe="") for t in TRACKERS)
BYTE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
COUNT_UNITS = ("", "k", "M", "B", "T")


def hex_text(raw: Column) -> Column:
    """Lower-case hexadecimal."""
    return F.lower(F.hex(raw))


def percent_encode(text: Column) -> Column:
    """RFC 3986 percent-encoding: only letters, digits and -._~ stay."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("+", "%20"), ("*", "%2A"), ("%7E", "~")), F.url_encode(text))


def magnet_link(info_hash: Column, name: Column) -> Column:
    """The link of a hash (40 hex digits); a name that is null or empty is left out."""
    named = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("&dn="), percent_encode(name))).otherwise(F.lit(""))
    return F.concat(F.lit(LINK_START), F.lower(info_hash), named, F.lit(LINK_END))


def _one_decimal(x: Column) -> Column:
    """Half up, as a decimal, so that every engine prints the same."""
    return F.round(x.cast("decimal(38,9)"), 1)


def format_bytes(n: Column) -> Column:
    """Steps of 1024; whole bytes, else one decimal. Null is zero."""
    x = F.coalesce(n.cast("double"), F.lit(0.0))
    scaled = [F.when(x < 1024.0 ** (k + 1), F.concat(_one_decimal(x / 1024.0**k).cast("decimal(38,1)").cast("string"), F.lit(f" {u}"))) for k, u in enumerate(BYTE_UNITS[:-1]) if k]
    last = F.concat(_one_decimal(x / 1024.0**6).cast("decimal(38,1)").cast("string"), F.lit(" EiB"))
    return F.coalesce(F.when(x < 1024, F.concat(F.round(x).cast("long").cast("string"), F.lit(" B"))), *scaled, last)


def format_count(n: Column) -> Column:
    """Steps of 1000, one decimal unless zero; a value that rounds up to 1000 takes the next unit."""
    x = F.coalesce(n.cast("double"), F.lit(0.0))
    out = []
    for k, u in enumerate(COUNT_UNITS[1:], 1):
        value = _one_decimal(x / 1000.0**k).cast("decimal(38,1)")
        shown = F.concat(F.regexp_replace(value.cast("string"), r"\.0$", ""), F.lit(u))
        out.append(F.when((F.abs(value) < 1000) | F.lit(k == len(COUNT_UNITS) - 1), shown))
    return F.when(F.abs(F.round(x)) < 1000, F.round(x).cast("long").cast("string")).otherwise(F.coalesce(*out))


def format_full(n: Column) -> Column:
    """Thousands apart by spaces. Null is zero."""
    return F.replace(F.format_number(F.coalesce(n, F.lit(0)), 0), F.lit(","), F.lit(" "))


def full_if_different(n: Column) -> Column:
    """The full form where the short one differs, else null."""
    return F.nullif(format_full(n), format_count(n))


def format_duration(seconds: Column) -> Column:
    """Days, hours, minutes and seconds without leading zero units."""
    s = F.greatest(F.lit(0), F.round(F.coalesce(seconds, F.lit(0)))).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    part = lambda shown, x, unit: F.when(shown, F.concat(x.cast("string"), F.lit(unit))).otherwise(F.lit(""))
    return F.concat(part(d > 0, d, "d "), part((d > 0) | (h > 0), h, "h "), part((d > 0) | (h > 0) | (m > 0), m, "m "), (s % 60).cast("string"), F.lit("s"))


def format_time(unix: Column) -> Column:
    """Time of day in the session's zone, "-" for none."""
    return F.when(F.coalesce(unix, F.lit(0.0)) == 0, F.lit("-")).otherwise(F.date_format(F.timestamp_micros((unix * 1e6).cast("long")), "HH:mm:ss"))
