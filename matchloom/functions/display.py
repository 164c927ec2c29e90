"""Display formats and request helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts, limits and paths that results depend on.
NO_PRICE = "Price unavailable"
UNKNOWN_RARITY = "Unknown"
REQUEST_ID_LENGTH = 80


def format_usd(amount: Column) -> Column:
    """en-US dollars with two digits, halves away from zero."""
    shown = F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.round(F.abs(amount), 2), 2))
    return F.coalesce(shown, F.lit(NO_PRICE))


def format_number(value: Column, total: Column) -> Column:
    """number/total, or the number alone."""
    return F.concat_ws("/", value, F.nullif(total, F.lit("")))


def percent(confidence: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(confidence * 100 + 0.5).cast("int")


def rarity(x: Column) -> Column:
    return F.coalesce(x, F.lit(UNKNOWN_RARITY))


def short_date(ts: Column) -> Column:
    """en-US date; null stays null."""
    return F.date_format(ts, "M/d/yyyy")


def request_id(header: Column, otherwise: Column) -> Column:
    """The caller's id, cut to its allowed length, or another."""
    return F.substring(F.coalesce(header, otherwise), 1, REQUEST_ID_LENGTH)


def iso_instant(text: Column, zone: str = "UTC") -> Column:
    """The instant that ISO text names (I17): with an offset that moment, without one the time as clocks of ``zone`` show it; null for other text.

    The session's time zone plays no part.
    """
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)
    timed = F.when(dated.contains("T"), dated).otherwise(F.concat(dated, F.lit("T00:00:00")))
    offset = timed.rlike(r"(?:Z|[+-]\d{2}(?::?\d{2})?)$")
    return F.try_to_timestamp(F.when(offset, timed).otherwise(F.concat(timed, F.lit(" "), F.lit(zone))))


def name_uuid(*parts: Column) -> Column:
    """A UUID that the parts decide (I18): of version 8, whose bits are the maker's own, here from a SHA-256 of the parts and their lengths."""
    told = F.concat(*[F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts])
    h = F.sha2(told, 256)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def percent_decode(x: Column) -> Column:
    """Percent decoding; null where malformed; a plus is a plus."""
    return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def percent_encode(x: Column) -> Column:
    """Percent encoding with %20 for spaces."""
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def without_slash(url: Column) -> Column:
    """Without one slash at the end."""
    return F.regexp_replace(url, "/$", "")


def display_name(full_name: Column, encoded: Column, email: Column) -> Column:
    """Full name (decoded where flagged) or e-mail address; null without an address."""
    name = F.when(encoded, percent_decode(full_name)).otherwise(full_name)
    return F.when(F.coalesce(email, F.lit("")) != "", F.coalesce(F.nullif(name, F.lit("")), email))


def resolved(path: Column) -> Column:
    """A path with its dot segments, plain or percent-encoded, taken out as browsers do; backslashes are slashes."""
    segments = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    folded = lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit("."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), none,
        lambda done, s: F.when(folded(s) == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(folded(s) == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    # A dot segment at the end leaves a folder.
    last = F.when(folded(F.element_at(segments, -1)).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, last), "/"))


def safe_path(value: Column, reserved: tuple[str, ...] = ()) -> Column:
    """A path of this site with its query and fragment, else / (C17).

    Tabs and line ends are dropped and dot segments resolved before anything is judged, so neither a second slash nor a
    reserved path can hide behind them.  Characters that are not allowed in paths make it /.
    """
    clean = F.regexp_replace(value, r"[\t\n\r]", "")
    head, tail = F.regexp_extract(clean, r"^[^?#]*", 0), F.regexp_replace(clean, r"^[^?#]*", "")
    slashes = F.replace(head, F.lit("\\"), F.lit("/"))
    path = resolved(head)
    parsed = F.try_parse_url(F.concat(F.lit("https://local.invalid"), path), F.lit("HOST"))
    good = value.startswith("/") & ~value.startswith("//") & slashes.startswith("/") & ~slashes.startswith("//") & parsed.isNotNull()
    if reserved:
        good = good & ~path.isin(*reserved)
    return F.when(good, F.concat(path, tail)).otherwise("/")


def cacheable(method: Column, path: Column) -> Column:
    """Whether a shell cache answers a request."""
    return (method == "GET") & ~path.startswith("/api/")
