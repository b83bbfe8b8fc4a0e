"""Folding, matching and masking of names, titles, captions and parameters."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lower-case Latin letters with marks, and the letters they fold to, place by place: those that Unicode decomposes.
_LATIN = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, (*range(0xE0, 0x250), *range(0x1E00, 0x1F00)))]
MARKED = "".join(c for c, d in _LATIN if c == c.lower() and len(d) > 1 and "a" <= d[0] <= "z" and all(map(unicodedata.combining, d[1:])))
PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in MARKED)
# Months, weekdays and ticketing terms of the caption markers.
MONTHS = ("janeiro", "fevereiro", "março", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
WEEKDAYS = ("segunda", "terça", "terca", "quarta", "quinta", "sexta", "sábado", "sabado", "domingo")
TICKET_TERMS = ("ingressos", "ingresso", "line-up", "lineup", "open bar", "sympla", "shotgun", "pré-venda", "pre-venda", "pista", "camarote")
# Forms of dates and of times after weekdays in captions.
CAPTION_DATE = r"\b\d{1,2}[/.\-]\d{1,2}(?:[/.\-]\d{2,4})?\b|\b\d{1,2}\s*(?:de)?\s*(?:" + "|".join(MONTHS) + r")\b"
CAPTION_TIME = r"(?U)\b(?:" + "|".join(WEEKDAYS) + r")\b[\w\-,.!\s]{0,40}?\d{1,2}[:h]\d{0,2}\b"
# Parameter names that are secret, the shapes of secret values, and the mask.
SECRET_NAMES = ("api_key", "api_key_private", "api_key_public", "apikey", "access_token", "key", "password", "secret", "token")
SECRET_SHAPES = (r"\bpri_[0-9a-fA-F]{16,}\b", r"\bpub_[0-9a-fA-F]{16,}\b", r"\bAIza[0-9A-Za-z_\-]{20,}\b")
MASK = "***REDACTED***"


def unmark(text: Column) -> Column:
    """Lower case without the marks of Latin letters, in either form; ß counts as ss."""
    return F.translate(F.replace(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), F.lit("ß"), F.lit("ss")), MARKED, PLAIN)


def _plain(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


def _fold(text: str) -> str:
    return _plain(text).casefold()


def _fold_title(text: str) -> str:
    return _plain(text.casefold())


def _by_slices(texts: pa.Array, fold, rows: int = 64) -> pa.Array:
    """fold of each text; a few at a time are Python's, all others stay packed."""
    parts = [pa.array([None if t is None else fold(t) for t in texts.slice(at, rows).to_pylist()], pa.string()) for at in range(0, len(texts), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def _folded(texts: pa.Array) -> pa.Array:
    return _by_slices(texts, _fold)


@F.arrow_udf(T.StringType())
def _folded_title(texts: pa.Array) -> pa.Array:
    return _by_slices(texts, _fold_title)


def _fold_exactly(text: Column, fold) -> Column:
    """Case folded and without the marks of any letters (NFKD); only texts beyond ASCII go to Python."""
    return F.coalesce(fold(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


def fold_text(text: Column) -> Column:
    """Unmarked, everything but letters and digits a blank, blanks squeezed. Null is empty."""
    return F.trim(F.regexp_replace(_fold_exactly(F.coalesce(text, F.lit("")), _folded), r"[^\p{L}\p{N}]+", " "))


def normalize_title(title: Column) -> Column:
    """Unmarked, trimmed, blanks squeezed; punctuation stays. Null is empty."""
    return F.regexp_replace(F.trim(_fold_exactly(F.coalesce(title, F.lit("")), _folded_title)), r"\s+", " ")


def fold_ascii(text: Column) -> Column:
    """Only a-z and 0-9 of the unmarked text."""
    return F.regexp_replace(_fold_exactly(F.coalesce(text, F.lit("")), _folded), "[^a-z0-9]", "")


def names_match(a: Column, b: Column, least: int = 5) -> Column:
    """Folded names are equal, or the shorter one has `least` characters and is within the other."""
    inside = (F.contains(a, b) | F.contains(b, a)) & (F.least(F.char_length(a), F.char_length(b)) >= least)
    return (a != "") & (b != "") & ((a == b) | inside)


def title_tokens(title: Column) -> Column:
    """The different tokens of a normalised title, in order of appearance."""
    return F.array_distinct(F.filter(F.split(normalize_title(title), "[^0-9a-z]+"), lambda t: t != ""))


def distinctive_tokens(title: Column, venue_name: Column, generic: Column, stop: Column) -> Column:
    """Tokens that are no stop word, generic word or part of the venue's name; one character only if a digit."""
    rest = F.array_except(F.array_except(F.array_except(title_tokens(title), stop), generic), title_tokens(venue_name))
    return F.array_sort(F.filter(rest, lambda t: (F.char_length(t) >= 2) | t.rlike("^[0-9]$")))


def normalize_handle(handle: Column) -> Column:
    """Lower case, without a leading @ and anything from ? or # on; empty is null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(handle)), "^@+", ""), "[?#/].*$", ""), F.lit(""))


def mentions(caption: Column) -> Column:
    """The different handles after an @ that no word character or dot precedes, in order of appearance."""
    found = F.regexp_extract_all(F.lower(F.coalesce(caption, F.lit(""))), F.lit(r"(?:^|[^\w.])@([a-z0-9_.]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda h: F.regexp_replace(h, r"\.+$", "")), lambda h: h != ""))


def event_markers(caption: Column) -> Column:
    """Labels of what makes a caption look like an event: date, weekday_time, term:*."""
    text = F.lower(F.coalesce(caption, F.lit("")))
    return F.array_compact(F.array(F.when(text.rlike(CAPTION_DATE), "date"), F.when(text.rlike(CAPTION_TIME), "weekday_time"), *(F.when(F.contains(text, F.lit(t)), f"term:{t}") for t in TICKET_TERMS)))


def redact(params: Column) -> Column:
    """A map of parameters without secret names, and with secret-shaped values masked."""
    named = F.map_filter(params, lambda k, v: ~F.lower(k).isin(*SECRET_NAMES))
    shaped = lambda v: F.coalesce(v.rlike("|".join(SECRET_SHAPES)), F.lit(False))
    return F.transform_values(named, lambda k, v: F.when(shaped(v), MASK).otherwise(v))


def hmac_sha256(secret: str, text: Column) -> Column:
    """HMAC-SHA256 as hex, of two nested hashes over the padded key."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "utf-8")), 256))), 256)
