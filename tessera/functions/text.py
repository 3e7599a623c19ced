"""Keys, identities, similarities and title rules of tracks and creators."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _folded(x: str | None) -> str | None:
    if x is None:
        return None
    kept = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    return " ".join(kept.casefold().split())


@F.pandas_udf(T.StringType())
def _norm_any(s: pd.Series) -> pd.Series:
    return s.map(_folded, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _norm_every(s: pd.Series) -> pd.Series:
    return pd.Series([None if names is None else [_folded(x) for x in names] for names in s])


def _ascii(col: Column) -> Column:
    return F.coalesce(col.rlike(r"^[\x00-\x7f]*\z"), F.lit(True))


def _ascii_norm(col: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(col, r"[\s\x1c-\x1f]+", " ")))


def norm(col: Column) -> Column:
    """Compatibility decomposition without marks, case folded, white space collapsed; Python sees null for plain ASCII, which the JVM folds."""
    return F.when(_ascii(col), _ascii_norm(col)).otherwise(_norm_any(F.when(~_ascii(col), col)))


def norm_each(names: Column) -> Column:
    """norm() of each member of an array; arrays of plain ASCII are folded by the JVM."""
    plain = F.forall(names, _ascii)
    return F.when(plain, F.transform(names, _ascii_norm)).otherwise(_norm_every(F.when(~plain, names)))


def normalize(col: Column) -> Column:
    """norm() with every run of other characters than a-z and 0-9 as one blank."""
    return F.trim(F.regexp_replace(norm(col), r"[^a-z0-9]+", " "))


def text_key(artist: Column, title: Column) -> Column:
    return F.concat(F.lit("text:"), norm(artist), F.lit("\0"), norm(title))


def mbid_key(mbid: Column) -> Column:
    """Null where there is no mbid."""
    return F.when(F.trim(mbid) != "", F.concat(F.lit("mbid:"), F.lower(F.trim(mbid))))


def track_key(artist: Column, title: Column, mbid: Column) -> Column:
    return F.coalesce(mbid_key(mbid), text_key(artist, title))


def candidate_id(key: Column, prefix: str = "v2_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 20))


def identity_keys(artist: Column, title: Column, mbid: Column) -> Column:
    """Both keys of a row, without nulls."""
    return F.array_compact(F.array(mbid_key(mbid), text_key(artist, title)))


def union_keys(*names: Column) -> Column:
    """Distinct normalised names of several arrays, blank ones left out, sorted."""
    every = F.concat(*[F.coalesce(n, F.array().cast("array<string>")) for n in names])
    return F.array_sort(F.array_distinct(F.filter(norm_each(every), lambda x: x != "")))


def first_keys(*names: Column) -> Column:
    """The distinct normalised names of the first array that has any."""
    out = F.array().cast("array<string>")
    for n in reversed(names):
        found = union_keys(n)
        out = F.when(F.size(found) > 0, found).otherwise(out)
    return out


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of normalised texts; 0 if either has none."""
    x, y = (F.filter(F.split(t, " "), lambda w: w != "") for t in (a, b))
    both = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / both)


def token_hashes(a: Column) -> Column:
    """The set of a normalised text's words as 64-bit hashes, to compare many texts with."""
    return F.array_distinct(F.transform(F.filter(F.split(a, " "), lambda w: w != ""), lambda w: F.xxhash64(w)))


def set_similarity(x: Column, y: Column) -> Column:
    """Jaccard similarity of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def containment(a: Column, b: Column) -> Column:
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = (short >= 4) & (F.contains(a, b) | F.contains(b, a))
    return F.when(inside, F.lit(0.9) + F.lit(0.1) * (short / long)).otherwise(F.lit(0.0))


def _ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of normalised texts."""
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def flexible_similarity(a: Column, b: Column) -> Column:
    """The largest of sequence, word and containment similarity of normalised texts."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.greatest(sequence_similarity(F.when(a != b, a), F.when(a != b, b)), token_similarity(a, b), containment(a, b)))


# The words and forms by which titles carry credits, decorations and versions.
CREDIT = r"(?i)(?:\s*[(\[{]\s*(?:feat(?:uring)?|ft)\.?\s+[^)\]}]+[)\]}]|\s+(?:feat(?:uring)?|ft)\.?\s+.+$)"
BRACKETED = r"(?i)[(\[{]\s*(?:official\s+(?:music\s+)?video|official\s+audio|official\s+visualizer|music\s+video|lyrics?\s+video|lyrics?|visualizer|audio|hd|4k)\s*[)\]}]"
TRAILING = r"(?i)\s*[-|:]\s*(?:official\s+(?:music\s+)?video|official\s+audio|official\s+visualizer|music\s+video|lyrics?\s+video|visualizer|audio)\s*$"
COLLABORATION = r"(?i)\s+(?:feat(?:uring)?\.?|ft\.?|vs\.?|versus|x)\s+|\s*&\s*|\s*,\s*"
REMIX_NAME = r"(?i)(?:\(|\[|-)\s*([^()\[\]-]*?)\s+remix(?:\)|\]|$)"
VERSION_SUFFIXES = (
    r"(?i)\s*[(\[][^)\]]*remix[)\]]\s*$",
    r"(?i)\s*-\s*[^-]*remix\s*$",
    r"(?i)\s*[(\[]\s*original\s+mix\s*[)\]]\s*$",
    r"(?i)\s*-\s*original\s+mix\s*$",
    r"(?i)\s*[(\[]\s*radio\s+(?:edit|mix)\s*[)\]]\s*$",
    r"(?i)\s*-\s*radio\s+(?:edit|mix)\s*$",
    r"(?i)\s*[(\[]\s*extended\s+(?:mix|version)\s*[)\]]\s*$",
    r"(?i)\s*-\s*extended\s+(?:mix|version)\s*$",
    r"(?i)\s*[(\[]\s*(?:vip|instrumental|acoustic|live)\s*[)\]]\s*$",
)
VERSION_FLAGS = {
    "remix": ("remix",),
    "original_mix": ("original mix",),
    "radio": ("radio edit", "radio mix"),
    "extended": ("extended mix", "extended version"),
    "live": ("live",),
    "acoustic": ("acoustic",),
    "instrumental": ("instrumental",),
    "vip": ("vip",),
    "bootleg": ("bootleg",),
    "mashup": ("mashup",),
}
BAD_VIDEO_TERMS = (
    "karaoke", "reaction", "tutorial", "drum cover", "piano cover", "guitar cover", "vocal cover", "dance cover", "fan made", "fanmade", "nightcore",
    "sped up", "slowed reverb", "slowed + reverb", "slowed and reverb", "8d audio", "1 hour", "10 hours", "full album", "dj set", "live set", "festival set",
)
ERRORS = (
    ("terminal", "age_restricted", r"age[- ]?restricted|confirm your age|age restriction"),
    ("terminal", "private", r"private video|video is private"),
    ("terminal", "members_only", r"members[- ]only"),
    ("terminal", "deleted", r"video (?:has been )?removed|deleted video"),
    ("terminal", "region_blocked", r"not available in your country|geo restriction"),
    ("terminal", "authentication_required", r"sign in to view|authentication required|login required"),
    ("global", "youtube_rate_limit", r"sign in to confirm you(?:'|’)re not a bot|this content isn(?:'|’)t available, try again later|http error 429|too many requests|rate limit"),
    ("transient", "transient_download_error", r"http error 403|connection (?:reset|aborted|refused)|timed? out|timeout|fragment .* (?:unavailable|error)|remote end closed connection|temporary failure|temporarily unavailable"),
    ("terminal", "unavailable", r"(?:this )?video (?:is )?unavailable"),
)


def strip_credit(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, CREDIT, ""))


def strip_decorations(title: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(title, BRACKETED, ""), TRAILING, "")
    return F.btrim(F.regexp_replace(plain, r"\s+", " "), F.lit(" -|:[](){}"))


def bare_title(title: Column) -> Column:
    return strip_decorations(strip_credit(title))


def unversioned(title: Column) -> Column:
    """The title without credits, decorations and version suffixes."""
    out = bare_title(title)
    for suffix in VERSION_SUFFIXES:
        out = F.regexp_replace(out, suffix, "")
    return out


def base_title(title: Column) -> Column:
    return normalize(unversioned(title))


def remix_name(title: Column) -> Column:
    return F.regexp_extract(bare_title(title), REMIX_NAME, 1)


def version(title: Column) -> Column:
    """A struct of the version flags (substrings of the normalised title) and the remix's name."""
    return version_of(normalize(bare_title(title)), normalize(remix_name(title)))


def version_of(text: Column, name: Column) -> Column:
    """The same from the normalised bare title and remix name, for titles taken apart before."""

    def has(words: tuple[str, ...]) -> Column:
        out = F.contains(text, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(text, F.lit(w))
        return out

    return F.struct(*[has(w).alias(flag) for flag, w in VERSION_FLAGS.items()], F.when(name != "", name).alias("remix_name"))


def compatibility(a: Column, b: Column, remix_like: Column) -> Column:
    """Struct (ok, penalty, reason) of two versions, as version() gives them, and the similarity of their remix names."""
    rules = [(a["remix"] != b["remix"], 0.40, "remix_original_mismatch"), (a["remix"] & b["remix"] & F.coalesce(remix_like < 0.55, F.lit(False)), 0.40, "different_remix")]
    rules += [(a[flag] != b[flag], 0.35, f"{flag}_mismatch") for flag in ("live", "acoustic", "instrumental", "vip", "bootleg", "mashup")]
    rules += [(a[one] & b[two], 0.30, f"{one}_{two}_mismatch") for one, two in (("radio", "extended"), ("extended", "radio"))]
    radio, extended = a["radio"] != b["radio"], a["extended"] != b["extended"]
    result = lambda ok, penalty, reason: F.struct(F.lit(ok).alias("ok"), F.lit(penalty).alias("penalty"), F.lit(reason).cast("string").alias("reason"))
    out = F.when(rules[0][0], result(False, *rules[0][1:]))
    for test, penalty, reason in rules[1:]:
        out = out.when(test, result(False, penalty, reason))
    out = out.when(radio & extended, result(True, 0.14, "extended_qualification_difference"))
    out = out.when(radio, result(True, 0.06, "radio_qualification_difference")).when(extended, result(True, 0.08, "extended_qualification_difference"))
    return out.otherwise(result(True, 0.0, None))


def artist_parts(artist: Column) -> Column:
    """Credited artists of a line, split at collaboration words and normalised."""
    return artists_parts(F.array(artist))


def artists_parts(artists: Column) -> Column:
    """The same of all lines of an array."""
    parts = F.flatten(F.transform(F.filter(artists, lambda a: a.isNotNull()), lambda a: F.split(a, COLLABORATION)))
    return F.filter(F.transform(norm_each(parts), lambda x: F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " "))), lambda x: x != "")


def bad_video(source: Column, target: Column, missing: Column) -> Column:
    """Why a video isn't a recording of a title, both normalised; null if it may be one."""
    out = F.when(missing, F.lit("missing_video_title"))
    for term in BAD_VIDEO_TERMS:
        plain = " ".join(re.findall(r"[a-z0-9]+", term))
        out = out.when(F.contains(target, F.lit(plain)) & ~F.contains(source, F.lit(plain)), F.lit("video_" + plain.replace(" ", "_")))
    for word, reason in (("live", "video_live_mismatch"), ("cover", "video_cover")):
        out = out.when(F.array_contains(F.split(target, " "), word) & ~F.array_contains(F.split(source, " "), word), F.lit(reason))
    return out


def error_class(message: Column) -> Column:
    """Struct (kind, code) of a download error: the first family that matches."""
    out = None
    for kind, code, pattern in ERRORS:
        test, value = message.rlike("(?i)" + pattern), F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit("transient").alias("kind"), F.lit("unclassified_download_error").alias("code")))


def duration_seconds(seconds: Column, clock: Column) -> Column:
    """Whole seconds of a number or digits, else of mm:ss or hh:mm:ss; else null."""
    p = F.split(clock, ":")
    part = lambda i: F.try_to_number(F.get(p, F.lit(i)), F.lit("999999999")).cast("int")
    two = part(0) * 60 + part(1)
    three = part(0) * 3600 + part(1) * 60 + part(2)
    return F.when(seconds.rlike(r"^[0-9]+$"), seconds.cast("int")).when(F.size(p) == 2, two).when(F.size(p) == 3, three)


def strip_accents_sql(x: str) -> str:
    """SQL that equals norm() on Latin text, for oracles."""
    return f"trim(regexp_replace(replace(lower(strip_accents({x})), 'ß', 'ss'), '\\s+', ' ', 'g'))"
