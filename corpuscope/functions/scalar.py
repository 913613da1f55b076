"""Scalar functions as column expressions; divisions by zero give null, never an error."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def no_nan(c: Column) -> Column:
    """NaN as null: comparisons with it are then not true, sums skip it and sorts put it last."""
    return F.when(~F.isnan(c), c)


def recency(ts_day: Column, now_days: float, decay: float) -> Column:
    return F.exp(F.lit(-float(decay)) * (F.lit(float(now_days)) - ts_day))


def clipped(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def scaled(c: Column, lo: float, hi: float) -> Column:
    """``c`` clipped to [lo, hi] and mapped to [0, 1]; null if the range is empty."""
    return F.try_divide(clipped(c, lo, hi) - F.lit(float(lo)), F.lit(float(hi) - float(lo))) if hi != lo else F.lit(None).cast("double")


def reaches(c: Column, threshold: float) -> Column:
    """1 where ``c`` is at least ``threshold``, 0 elsewhere, nulls and NaN included."""
    return F.coalesce((no_nan(c) >= F.lit(float(threshold))).cast("int"), F.lit(0))


def bucket(c: Column, width: float) -> Column:
    """Floor division (towards minus infinity) as int."""
    return F.floor(F.try_divide(c, F.lit(float(width)))).cast("int")


def log_norm(value: Column, lo: Column, hi: Column) -> Column:
    """ln(max(v - min, 1)) / ln(max - min + 1); 0 where all values are equal."""
    return F.coalesce(F.try_divide(F.ln(F.greatest(value - lo, F.lit(1.0))), F.ln(hi - lo + 1)), F.lit(0.0))


def log_score(score: Column) -> Column:
    return F.ln(F.greatest(score.cast("double"), F.lit(1.0)))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def epoch_days(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(DAY * 1e6)


def bucket_date(group: Column, days: int = 7) -> Column:
    """Start of a bucket of days since the epoch."""
    return F.timestamp_seconds(group.cast("long") * days * DAY)


def cyclic(value: Column, top: Column | float) -> tuple[Column, Column]:
    """Sine and cosine of a value in [0, top] on a circle of top + 1 steps."""
    angle = F.try_divide(F.lit(2 * math.pi) * value, (F.lit(float(top)) if not isinstance(top, Column) else top) + 1)
    return F.sin(angle), F.cos(angle)


def relative_time(ts: Column, start: str = "2005-01-01", end: str = "2035-01-01") -> Column:
    """Where ``ts`` lies between two dates, 0 to 1."""
    a, b = (F.unix_seconds(F.lit(x).cast("timestamp")) for x in (start, end))
    return (F.unix_micros(ts.cast("timestamp")) / F.lit(1e6) - a) / (b - a)


def days_into(ts: Column, unit: str) -> Column:
    """Days since the start of the year or month, or of the week that starts on Sunday."""
    ts = ts.cast("timestamp")
    start = F.date_trunc("day", ts) - F.make_dt_interval(F.dayofweek(ts) - 1) if unit == "week" else F.date_trunc(unit, ts)
    return (F.unix_micros(ts) - F.unix_micros(start)) / F.lit(DAY * 1e6)


def sentiment_sign(pos: Column, neu: Column, neg: Column) -> Column:
    """``pos`` where it beats neutral; else ``-neg`` where that beats both others; else 0."""
    return F.when(pos > neu, pos).when(neg > F.greatest(neu, pos), -neg).otherwise(F.lit(0.0))


def softmax(*parts: Column) -> list[Column]:
    top = F.greatest(*parts)
    exps = [F.exp(p - top) for p in parts]
    return [e / sum(exps[1:], exps[0]) for e in exps]


def point_alpha(score: Column, lo: Column, hi: Column) -> Column:
    """Weight of a map point: ln(score - min) / ln(max - min + 1), at least 0."""
    above = score - lo
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.when(above > 0, F.ln(above)), F.ln(hi - lo + 1)), F.lit(0.0)))


def key_hash(c: Column) -> Column:
    """Multiplicative hash of a non-negative id into [0, 2^32); any SQL engine can compute it."""
    return F.pmod(c * F.lit(2654435761), F.lit(4294967296))


def strip_protocol(url: Column) -> Column:
    return F.regexp_replace(url, "^https?://", "")


#: Bytes that an url without its protocol may have at most.
MOST_URL_BYTES = 3000


def without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..`` (also escaped), the latter with the segment before; one at the end leaves a slash."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    numbered = F.transform(segments, lambda x, i: F.struct(F.regexp_replace(x, "(?i)%2e", ".").alias("plain"), x.alias("x"), (i == F.size(segments) - 1).alias("last")))
    end = lambda s: F.when(s["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    shorter = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    kept = F.aggregate(numbered, F.array().cast("array<string>"), lambda kept, s: F.when(s["plain"] == "..", F.concat(shorter(kept), end(s))).when(s["plain"] == ".", F.concat(kept, end(s))).otherwise(F.concat(kept, F.array(s["x"]))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Protocol and the rest of an url, normalised; both null if it is no http url or the rest is longer than MOST_URL_BYTES.

    The host is lower-cased, a default port and the fragment go, dot segments of the path are taken away, an empty path is a
    slash, percent escapes are upper case, the parts of the query are sorted.
    """
    whole = F.trim(url)
    part = lambda i: F.regexp_extract(whole, r"^(?i:(https?)://)(?:[^/?#@]*@)?([^/?#:]+)(?::(\d+))?([^?#]*)(\?[^#]*)?(?:#.*)?$", i)
    proto, host, port, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4), F.substring(part(5), 2, 1 << 30)
    port = F.when((port == "") | (proto == "http") & (port == "80") | (proto == "https") & (port == "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    asked = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    rest = F.concat(host, port, F.when(path == "", F.lit("/")).otherwise(without_dots(path)), F.when(asked == "", F.lit("")).otherwise(F.concat(F.lit("?"), asked)))
    # split at escapes: what follows each % begins with its two digits
    pieces = F.split(rest, "%")
    rest = F.array_join(F.transform(pieces, lambda x, i: F.when((i > 0) & x.rlike("^[0-9a-fA-F]{2}"), F.concat(F.upper(F.substring(x, 1, 2)), F.substring(x, 3, 1 << 30))).otherwise(x)), "%")
    sound = (host != "") & (F.octet_length(rest) <= MOST_URL_BYTES)
    return F.when(sound, proto), F.when(sound, rest)


def site_of(url: Column) -> Column:
    """What stands before the first slash of an url without its protocol."""
    return F.substring_index(url, "/", 1)


def trimmed(text: Column) -> Column:
    """Without white space of any kind (line ends, no-break spaces and the byte order mark included) at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def clean_title(title: Column, prefix: str = r"(?i)^(Ask|Show) HN:?") -> Column:
    """A title without the prefix that tells its kind; character references are for :func:`corpuscope.functions.html.unescape`."""
    return trimmed(F.regexp_replace(trimmed(title), prefix, ""))


def anchor_links(text: Column) -> Column:
    """A link at the start of a text becomes the bare word http."""
    return F.regexp_replace(text, r"^https?://\S+", "http")


def kv_id(key: Column) -> Column:
    """The id in a key of the form entity/id/field."""
    return F.try_element_at(F.split(key, "/"), F.lit(2)).try_cast("long")


def is_html_type(content_type: Column) -> Column:
    return content_type.isNull() | F.lower(content_type).rlike("^(application/xhtml|text/html|text/xhtml)")


def rfc3339(c: Column) -> Column:
    """A timestamp, or null where the text is none."""
    return F.try_to_timestamp(c)


def snippet_of(description: Column, snippet: Column) -> Column:
    return F.trim(F.coalesce(F.nullif(description, F.lit("")), snippet))


def hundredths(threshold: Column) -> Column:
    """A threshold in hundredths, rounded up, as queries ask for it."""
    return F.ceil(threshold * 100).cast("int")


def title_bytes(title: Column) -> Column:
    return F.coalesce(F.octet_length(title), F.lit(0)).cast("int")
