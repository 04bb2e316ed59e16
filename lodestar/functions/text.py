"""String, date, hash and rate expressions; each takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs with the Unicode property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A text that begins and ends with a visible ASCII sign.
VISIBLE = r"(?s)^[!-~](?:.*[!-~])?$"
#: Service names in the order in which they are looked for (fixed values).
SERVICES = [
    ("wmts", "web map tile service"),
    ("wms", "web map service"),
    ("wfs", "web feature service"),
    ("wcs", "web coverage service"),
    ("csw", "catalogue service"),
    ("sos", "sensor observation service"),
]


def trimmed(value: Column) -> Column:
    """The text without Unicode white space at its ends."""
    return F.btrim(value, F.lit(WHITE))


def non_blank(value: Column) -> Column:
    """The trimmed text, null if nothing is left; most texts begin and end with a visible sign and need no trimming."""
    return F.when(value.rlike(VISIBLE), value).otherwise(F.nullif(trimmed(value), F.lit("")))


def without_trailing_slashes(url: Column) -> Column:
    """X3."""
    return F.regexp_replace(url, "/+$", "")


def portal_name(url: Column) -> Column:
    """The host with dots as hyphens."""
    host = F.split_part(F.regexp_replace(url, "^https?://", ""), F.lit("/"), F.lit(1))
    return F.replace(host, F.lit("."), F.lit("-"))


def file_name(name: Column) -> Column:
    """Lower case, any sign but a-z, 0-9 and hyphen as a hyphen."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9-]", "-")


def short_format(value: Column) -> Column:
    """The last non-empty segment of a format that is a URI; others as they are."""
    last = last_segment(value)
    return F.when(F.contains(value, F.lit("://")), last).otherwise(value)


def last_segment(uri: Column) -> Column:
    """What follows the last slash, trailing slashes aside."""
    return F.element_at(F.split(F.regexp_replace(uri, "/+$", ""), "/"), -1)


def _is_mime(protocol: Column) -> Column:
    return F.contains(protocol, F.lit("/")) & ~F.contains(protocol, F.lit("://"))


def protocol_format(protocol: Column) -> Column:
    """The OGC service that a protocol names, upper case; null for others and for MIME types."""
    low = F.lower(protocol)
    out = F.lit(None).cast("string")
    for code, spelled in reversed(SERVICES):
        out = F.when(F.contains(low, F.lit(code)) | F.contains(low, F.lit(spelled)), F.lit(code.upper())).otherwise(out)
    return F.when(~_is_mime(protocol), out)


def protocol_media_type(protocol: Column) -> Column:
    """What stands before a semicolon of a protocol with a slash; URIs have none."""
    return F.when(_is_mime(protocol), trimmed(F.split_part(protocol, F.lit(";"), F.lit(1))))


def filled_template(template: Column, values: dict[str, Column]) -> Column:
    """{name} replaced by its value, for each name."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def urn_part(urn: Column, part: str) -> Column:
    """Agency, id or version of urn:...=AGENCY:ID(VERSION); null if it isn't one."""
    group = {"agency": 1, "id": 2, "version": 3}[part]
    return F.nullif(F.regexp_extract(urn, r"=([^:]+):([^(]+)\(([^)]+)\)", group), F.lit(""))


def is_four_by_four(value: Column) -> Column:
    """X11."""
    return value.rlike("^[a-z0-9]{4}-[a-z0-9]{4}$")


def url_scheme(url: Column) -> Column:
    """X11: http or https, https for others."""
    return F.when(F.startswith(url, F.lit("http://")), F.lit("http")).otherwise(F.lit("https"))


def is_safe_iri(iri: Column) -> Column:
    """An http(s) IRI without white space, quotes, brackets, backslashes and the like."""
    return iri.rlike(r"^https?://[^\x20\x09\x0A\x0C\x0D<>\"{}|^`\\]*$")


def lowered(value: Column) -> Column:
    """X15."""
    return F.lower(value)


def is_url(value: Column) -> Column:
    """Whether the text parses as an absolute URL."""
    return F.try_parse_url(value, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(value, F.lit("HOST")).isNotNull()


def parsed_date(value: Column, *, bare_offset: bool = False) -> Column:
    """RFC 3339 or a date at midnight (UTC), else null; D2 also takes an offset without a colon."""
    rfc = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    bare = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)([+-]\d{2})(\d{2})$"
    if bare_offset:
        value = F.regexp_replace(value, bare, "$1$2:$3")
    stamp = F.when(value.rlike(rfc), F.try_to_timestamp(F.upper(value)))
    day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(value, F.lit("T00:00:00Z"))))
    return F.coalesce(stamp, day)


def from_millis(value: Column) -> Column:
    """D3."""
    return F.timestamp_millis(value)


def _utc(value: Column, form: str) -> Column:
    """A timestamp's UTC time in a form, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(value, F.current_timezone()), form)


def rfc3339(value: Column) -> Column:
    """A timestamp as RFC 3339 text with its offset; milli- or microseconds only where there are any."""
    micros = F.pmod(F.unix_micros(value), F.lit(1_000_000))
    form = lambda fraction: _utc(value, f"yyyy-MM-dd'T'HH:mm:ss{fraction}'+00:00'")
    return F.when(micros == 0, form("")).when(micros % 1000 == 0, form(".SSS")).otherwise(form(".SSSSSS"))


def csv_time(value: Column) -> Column:
    """A timestamp as CSV exports have it."""
    return _utc(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def content_hash(title: Column, description: Column, language: Column | None = None) -> Column:
    """SHA-256 of language (if given), title and description on lines of their own."""
    parts = [title, F.coalesce(description, F.lit(""))]
    return F.sha2(F.concat_ws("\n", *([language] if language is not None else []), *parts), 256)


def rate(part: Column, whole: Column) -> Column:
    """M5: the share, rounded to four decimals; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part.cast("double") / F.nullif(whole, F.lit(0)), 4))
