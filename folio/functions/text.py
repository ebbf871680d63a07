"""Text scoring as column expressions: vocabulary, markers, legibility, shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SUBJECT_PREFIXES = ("slave", "lynch", "klux")
NEGRO_PREFIXES = ("negro", "negre")
PERSON_PREFIXES = ("negro", "negre", "slave", "wench", "mulatto")
SALE_PREFIXES = ("sale", "sold", "sell", "auction", "vendue", "hire", "runaway", "reward")
MIN_PREFIX_TOKEN = 4
PRICE = r"\$\d|\b\d+[\s-]?c(ts|ents?)?\b|¢"
PUNCTUATION = ".,;:!?()[]\"'“”‘’-"


def once(value: Column, use) -> Column:
    """use(value), the value worked out once: named inside a lambda, it would be worked out again for each item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def norm(t: Column) -> Column:
    """The longest run of a-z in the lower-cased text, the first of equals; '' if there is none."""
    return F.aggregate(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("([a-z]+)"), 1), F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("([a-z]+)"), 1)


def blanks(t: Column) -> Column:
    """What stands between white space."""
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"(\S+)"), 1)


def hits(t: Column, prefixes: tuple[str, ...], words: Column | None = None) -> Column:
    """The prefixes that some token of at least four letters starts with; ``words``: the text's tokens, where a column has them."""
    long = F.filter(F.array_distinct(tokens(t) if words is None else words), lambda w: F.length(w) >= MIN_PREFIX_TOKEN)
    return once(long, lambda words: F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.exists(words, lambda w: F.startswith(w, p))))


def ad_markers(t: Column, words: tuple[str, ...], own: Column | None = None) -> Column:
    """The advertising words among the tokens, and '$' for a price; sorted. ``own``: the text's tokens, where a column has them."""
    found = F.array_intersect(tokens(t) if own is None else own, F.array(*map(F.lit, words)))
    return F.sort_array(F.when(F.regexp_like(F.coalesce(t, F.lit("")), F.lit(PRICE)), F.concat(found, F.array(F.lit("$")))).otherwise(found))


def letters(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"\P{L}", ""))


def wordlike(t: Column) -> Column:
    bare = F.btrim(t, F.lit(PUNCTUATION))
    return (F.length(bare) >= 2) & (letters(bare) * 5 >= 4 * F.length(bare))


def share(items: Column, test, least: int = 1) -> Column:
    """The share of items that pass; 0 for fewer than ``least`` of them."""
    return F.when(F.size(items) >= least, F.size(F.filter(items, test)) / F.size(items)).otherwise(0.0)


def legibility(t: Column) -> Column:
    return share(blanks(t), wordlike, 6)


def tabular(t: Column) -> Column:
    return share(blanks(t), lambda w: F.regexp_like(w, F.lit(r"\d")) & (letters(w) <= 2))


def looks_described(t: Column) -> Column:
    words = F.filter(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit("([A-Za-z][A-Za-z'’]*)"), 1), lambda w: F.length(w) > 1)
    lower = F.size(F.filter(words, lambda w: F.regexp_like(w, F.lit("^[a-z]"))))
    return (F.size(words) >= 6) & (lower / F.greatest(F.size(words), F.lit(1)) > 0.45)


def cut_band(t: Column, limit: int = 300) -> Column:
    """Whole if it fits; else cut at the last '. ' of the second half, else the last blank, else hard; then an ellipsis."""
    head = F.substring(t, 1, limit)
    last = lambda mark: F.when(F.contains(head, F.lit(mark)), F.length(head) - F.instr(F.reverse(head), mark[::-1]) - len(mark) + 1).otherwise(-1)
    stop, blank = last(". "), last(" ")
    at = F.when(stop >= limit // 2, stop).when(blank > 0, blank).otherwise(limit)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.regexp_replace(F.substring(head, F.lit(1), at), r"\s+$", ""), r"\.+$", ""), F.lit("…")))


def slug(t: Column) -> Column:
    return F.right(F.regexp_replace(t, "[^A-Za-z0-9]+", "_"), F.lit(160))


def town_tag(t: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(t, F.lit("([A-Za-z]+)"), 1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))
    return F.when(F.size(parts) > 0, F.array_join(parts, ""))


def decade(iso: Column) -> Column:
    return F.concat(F.substring(iso, 1, 3), F.lit("0s"))
