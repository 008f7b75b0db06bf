"""Do two names mean one agent? Column expressions over name keys, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import name_key

#: Words that tell no agent from another, for canonical names, for listings and for scores.
COMMON = "the and of for us usa american united states national international global world new bank banks central federal government department ministry market markets stock stocks shares share price prices index sector industry group company companies inc corp officials policy policies economy economic financial finance institutions".split()
LISTED = "and the inc corp company group holdings holding international global american national united financial capital bank banks technologies technology systems industries energy resources partners management fund funds trust etf shares index ishares spdr invesco vanguard proshares select sector first new general china chinese usa north south east west plc ltd limited corporation incorporated services service solutions communications pharmaceuticals therapeutics health healthcare insurance investment investments asset assets securities markets market equity stock stocks oil gas motor motors airlines air petroleum mining gold".split()
LEGAL = "inc corp corporation co company companies ltd limited plc sa ag nv se group holdings holding the and of class common stock shares ordinary adr ads american depositary new".split()
STRONG_EVIDENCE = ("the entity name contains", "same company name", "the name is this ticker")


def _words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def _telling(key: Column, common: list[str], least: int) -> Column:
    return F.array_distinct(F.filter(_words(key), lambda w: (F.length(w) >= least) & ~w.isin(common)))


def _joined(key: Column) -> Column:
    return F.replace(key, F.lit(" "), F.lit(""))


def _initials(words: Column, without: list[str]) -> Column:
    return F.array_join(F.transform(F.filter(words, lambda w: ~w.isin(without)), lambda w: F.substring(w, 1, 1)), "")


def _contains(a: Column, b: Column, least: int = 4) -> Column:
    """Whether the shorter of two strings, of ``least`` letters or more, lies in the longer."""
    first = F.length(a) <= F.length(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    return (F.length(short) >= least) & F.contains(long, short)


def compatible(name: Column, canonical: Column) -> Column:
    """Whether a canonical name may stand for a name: a telling word in common, a word that begins one of the
    other's, its initials, or one within the other."""
    a, b = name_key(name), name_key(canonical)
    left = F.filter(_words(a), lambda w: (F.length(w) >= 3) & ~w.isin(COMMON))
    begins = F.exists(left, lambda w: F.exists(_words(b), lambda x: F.startswith(x, w)))
    initials = a.rlike("^[a-z]{2,6}$") & (a == _initials(_words(b), ["and", "of", "the", "us"]))
    shared = F.arrays_overlap(_telling(a, COMMON, 3), _telling(b, COMMON, 3))
    return (b == "") | (a == b) | shared | begins | initials | _contains(_joined(a), _joined(b))


def same_listing(name: Column, listed: Column) -> Column:
    """Whether a name and a listing's name have something telling in common."""
    a, b = name_key(name), name_key(listed)
    raw = F.regexp_extract_all(F.lower(listed), F.lit("[a-z0-9]+"), F.lit(0))
    acronym = a.rlike("^[a-z]{3,6}$") & (a == F.substring(_initials(raw, ["and", "of", "the"]), F.lit(1), F.length(a)))
    x, y = _telling(a, LISTED, 3), _telling(b, LISTED, 3)
    long = lambda w: F.filter(w, lambda v: F.length(v) >= 5)
    stem = F.exists(long(x), lambda v: F.exists(long(y), lambda w: F.startswith(v, w) | F.startswith(w, v)))
    return acronym | F.arrays_overlap(x, y) | stem | _contains(_joined(a), _joined(b))


def check_ticker(name: Column, listed: Column, evidence: Column) -> Column:
    """Why a chosen ticker is accepted: 'name', 'evidence' or null. Null inputs accept nothing."""
    strong = F.lit(False)
    for begin in STRONG_EVIDENCE:
        strong = strong | F.startswith(evidence, F.lit(begin))
    return F.when(same_listing(name, listed), "name").when(strong, "evidence")


def name_score(a: Column, b: Column) -> Column:
    """1 for equal names, 0.9 if one begins the other and is 60 % of it, else the share of telling words."""
    x, y = name_key(a), name_key(b)
    stem = lambda key: F.transform(F.filter(_words(key), lambda w: ~w.isin(LEGAL)), lambda w: F.regexp_replace(w, "(?<=..)s$", ""))
    bare_x, bare_y = F.array_join(stem(x), ""), F.array_join(stem(y), "")
    first = F.length(bare_x) <= F.length(bare_y)
    short, long = F.when(first, bare_x).otherwise(bare_y), F.when(first, bare_y).otherwise(bare_x)
    begins = (F.length(short) >= 4) & F.startswith(long, short) & (F.length(short) >= 0.6 * F.length(long))
    tokens = lambda key: F.array_distinct(F.transform(F.filter(_words(key), lambda w: (F.length(w) > 1) & ~w.isin(LEGAL)), lambda w: F.regexp_replace(w, "(?<=..)s$", "")))
    p, q = tokens(x), tokens(y)
    jaccard = F.when((F.size(p) > 0) & (F.size(q) > 0), F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))).otherwise(0.0)
    return F.when((x == y) | ((bare_x != "") & (bare_x == bare_y)), 1.0).when(begins, 0.9).otherwise(jaccard)


def masked(text: Column, names: dict[str, str], date_mask: str = "[DATE]") -> Column:
    """A text with names (longest first, whole words, any case) and dates replaced."""
    import re

    out = text
    for name in sorted(names, key=lambda n: (-len(n), n)):
        out = F.regexp_replace(out, rf"(?i)\b{re.escape(name)}\b", names[name])
    return F.regexp_replace(out, r"\b\d{4}-\d{2}-\d{2}\b", date_mask)


UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def readable_bytes(n: Column, largest: str = UNITS[-1]) -> Column:
    """1536 as 1.5 KiB; sizes past the ``largest`` unit stay in it."""
    out = F.lit(None).cast("string")
    for power, unit in enumerate(UNITS[: UNITS.index(largest) + 1]):
        value = F.format_string("%.1f " + unit, F.round(n.cast("double") / 1024.0**power, 1))
        out = F.when(n >= 1024**power, value).otherwise(out)
    return F.when(n < 1, F.format_string("%.1f B", n.cast("double"))).otherwise(out)
