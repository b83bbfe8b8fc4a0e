"""Small rules on one row: labels, ids, handles, prices, counters, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora_spark.functions.text import normalize_handle, unmark

# Hosts that only forward links, and first parts of paths that are no profiles.
SHIM_HOSTS = ("l.instagram.com", "lm.instagram.com")
NO_PROFILES = ("p", "reel", "reels", "explore", "stories", "tv", "s", "accounts", "direct")
# Words of addresses that say nothing, and what a local business' following is worth.
ADDRESS_STOP_WORDS = ("r", "rua", "av", "avenida", "n", "no", "de", "do", "da", "dos", "das", "s/n", "pe", "brazil", "brasil")
FOLLOWERS = ((50, 0.2), (200, 0.5), (100_001, 1.0), (500_001, 0.7))
# Words of a summary that speak for an inclusive place.
INCLUSIVE = ("lgbtq", "lgbt", "gay", "lesbian", "queer", "pride", "drag", "inclusive", "welcoming to all", "diverse crowd", "rainbow")
WEIGHTS = {"name": 0.30, "address": 0.20, "type": 0.10, "business": 0.10, "category": 0.10, "url": 0.10, "followers": 0.10}


def sticky_price(old_level: Column, old_source: Column, level: Column, source: Column) -> Column:
    """struct<level, source>: a known level that came from the map service outlives a refresh."""
    stays = old_source.isin("google_range", "google_enum") & (old_level > 0)
    return F.struct(F.when(stays, old_level).otherwise(level).alias("level"), F.when(stays, old_source).otherwise(source).alias("source"))


def confident(label: Column, confidence: Column, vocabulary: list[str], least: float, otherwise: str = "not_classified") -> Column:
    """A label of the vocabulary that is sure enough, else the mark for none."""
    return F.when(label.isin(vocabulary) & (confidence >= least), label).otherwise(otherwise)


def within_vocabulary(labels: Column, vocabulary: list[str], most: int) -> Column:
    """The first `most` labels that the vocabulary has (the rule's own limit)."""
    return F.slice(F.filter(labels, lambda x: x.isin(vocabulary)), 1, most)


def true_labels(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, in order."""
    return F.array_compact(F.array(*(F.when(flag, name) for name, flag in flags.items())))


def canonical_spelling(raw: Column, vocabulary: list[str]) -> Column:
    """The vocabulary's spelling of a text, whatever its case and blanks; other texts with blanks squeezed, null if blank."""
    text = F.nullif(F.regexp_replace(F.trim(raw), r"\s+", " "), F.lit(""))
    known = reduce(lambda a, w: a.when(F.lower(text) == w.lower(), w), vocabulary, F.when(F.lit(False), ""))
    return F.coalesce(known, text)


def post_kind(raw: Column) -> Column:
    """Trimmed and in lower case, as it is; event if blank."""
    return F.coalesce(F.nullif(F.lower(F.trim(raw)), F.lit("")), F.lit("event"))


def photo_id(own: Column, name: Column, url: Column) -> Column:
    """The source's own id, else 16 hex digits of a hash of the photo's name or of its URL before the size."""
    token = F.substring_index(F.coalesce(url, F.lit("")), "=", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.left(F.sha2(F.coalesce(F.nullif(name, F.lit("")), token), 256), F.lit(16)))


def handle_of(url: Column) -> Column:
    """struct<handle, rejected> of a profile's URL: exactly one is set."""
    text = F.trim(F.coalesce(url, F.lit("")))
    whole = F.when(F.contains(text, F.lit("//")), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(F.lower(F.regexp_extract(whole, r"//([^/?#:]*)", 1)), r"^www\.", "")
    first = F.regexp_extract(whole, r"//[^/?#]*/+([^/?#]+)", 1)
    rejected = F.when(text == "", "empty").when(host.isin(*SHIM_HOSTS), "link_shim").when(~F.contains(host, F.lit("instagram.com")), "not_instagram").when(first == "", "empty").when(F.lower(first).isin(*NO_PROFILES), "non_profile_path").when(normalize_handle(first).isNull(), "malformed")
    return F.struct(F.when(rejected.isNull(), normalize_handle(first)).alias("handle"), rejected.alias("rejected"))


def handle_as_words(handle: Column) -> Column:
    return F.translate(handle, "._", "  ")


def inclusive(summary: Column) -> Column:
    """Whether a summary holds one of the words."""
    low = F.lower(F.coalesce(summary, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in INCLUSIVE))


def run_status(aborted: Column, *undelivered: Column) -> Column:
    """error, partial or success of a run's counters."""
    return F.when(F.coalesce(aborted, F.lit(False)), "error").when(reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0)) for x in undelivered)) > 0, "partial").otherwise("success")


def budget_left(quota: Column, reserve: Column, used: Column) -> Column:
    return F.greatest(quota - reserve - used, F.lit(0))


def escalate(overall: Column, labels: Column, contradictions: list[tuple[str, str]], whole: float = 0.80, part: float = 0.50) -> Column:
    """The reasons to ask again about an array<struct<category, label, confidence>>: unsure over all, unsure of a category, or labels that exclude each other."""
    unsure = F.array_sort(F.array_distinct(F.transform(F.filter(labels, lambda x: x["confidence"] < part), lambda x: F.concat(F.lit("unsure:"), x["category"]))))
    names = F.transform(labels, lambda x: x["label"])
    both = [F.when(F.array_contains(names, a) & F.array_contains(names, b), f"{a}+{b}") for a, b in contradictions]
    return F.concat(F.array_compact(F.array(F.when(overall < whole, "unsure"))), unsure, F.array_compact(F.array(*both)))


def _plain(text: Column) -> Column:
    return F.trim(unmark(F.coalesce(text, F.lit(""))))


def _tokens(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.filter(F.split(_plain(text), pattern), lambda t: t != ""))


def _share(tokens: Column, hit) -> Column:
    """The share of the tokens that hit; 0 of none."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, hit)) / F.size(tokens)).otherwise(0.0)


def profile_score(name: Column, address: Column, username: Column, full_name: Column, bio: Column, business: Column, same_type: Column, same_category: Column, url: Column, followers: Column, cities: list[str]) -> Column:
    """struct<confidence, signals> of a profile as a venue's own; seven signals of 0 to 1 in fixed weights.

    same_type and same_category: shares of the venue type's words in the bio, and whether the business category has one.
    """
    venue = _tokens(name, r"[\s\-_&/]+")
    joined = _plain(F.regexp_replace(username, "[._]", ""))
    user, full = _tokens(F.translate(username, "._", "  "), r"\s+"), _tokens(F.coalesce(full_name, F.lit("")), r"[\s\-_&/]+")
    named = F.greatest(_share(venue, lambda t: F.array_contains(user, t)), _share(venue, lambda t: F.contains(joined, t)), _share(venue, lambda t: F.array_contains(full, t)))
    told = _plain(bio)
    parts = F.filter(_tokens(address, r"[\s,.\-/]+"), lambda t: (F.char_length(t) > 2) & ~t.isin(*ADDRESS_STOP_WORDS))
    city = F.when(reduce(lambda a, b: a | b, (F.contains(told, F.lit(c)) for c in cities), F.lit(False)), 0.3).otherwise(0.0)
    placed = F.when(told == "", 0.0).otherwise(F.least(_share(parts, lambda t: F.contains(told, t)) + city, F.lit(1.0)))
    link = _plain(url)
    major = F.filter(_tokens(name, r"[\s\-_]+"), lambda t: F.char_length(t) > 2)
    linked = F.when(link == "", 0.0).when(F.contains(link, F.replace(_plain(name), F.lit(" "), F.lit(""))), 1.0).otherwise(_share(major, lambda t: F.contains(link, t)))
    follow = reduce(lambda a, b: a.when(followers < b[0], b[1]), FOLLOWERS, F.when(followers.isNull(), 0.5)).otherwise(0.3)
    signals = {"name": named, "address": placed, "type": same_type, "business": F.when(business, 1.0).otherwise(0.0), "category": same_category, "url": linked, "followers": follow}
    total = reduce(lambda a, b: a + b, (signals[k] * w for k, w in WEIGHTS.items()))
    return F.struct(F.round(total, 4).alias("confidence"), F.struct(*(F.round(v, 4).alias(k) for k, v in signals.items())).alias("signals"))
