"""Transcribed replies and archive metadata as column expressions: cleaning, parsing, refusals, titles, dates, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import ad_markers, hits, once, tokens

# Fixed values.
AD_WORDS = (
    "sale", "sold", "sell", "sells", "selling", "buy", "price", "prices", "cheap", "cheapest", "druggist", "druggists", "dealer",
    "dealers", "guaranteed", "cure", "cures", "cured", "remedy", "manufactured", "manufacturers", "wholesale", "retail", "goods",
    "groceries", "wanted", "apply", "agent", "agents", "bros", "warranted", "trial", "bottle", "bottles", "store", "stock", "bargain",
    "bargains", "millinery", "clothing", "hardware", "furniture", "pills", "liver", "tonic", "offerings", "merchant", "merchants",
    "advertisement", "advertisements", "customers", "trade", "shoes", "hats", "dry", "orders", "terms",
)
STRONG_AD = (
    "remedy", "remedies", "cure", "cures", "druggist", "druggists", "pills", "tonic", "dyspepsia", "candies", "candy", "cigars",
    "tobacco", "whiskey", "whiskies", "sarsaparilla", "bargain", "bargains", "millinery", "castoria", "liniment", "bitters",
    "ointment", "cordial", "dealers", "wholesale",
)
KINDS = (
    "editorial-cartoon", "comic-strip", "sports-cartoon", "humorous-drawing", "illustration", "photograph", "engraving",
    "advertisement", "map", "diagram", "ornament", "text-only", "other",
)
CONFIDENT_REASONS = (
    "rule", "display-boundary", "row-count-cap", "cap", "border", "different-item", "boundary", "tier", "height-cap",
    "iteration-cap", "indent", "reach", "walked",
)
REVIEW_WORDS = (
    "arrest", "arrested", "apprehension", "apprehended", "fugitive", "escaped", "runaway", "jail", "sheriff", "convict",
    "convicted", "chain gang", "col.", "mulatto", "description",
)
REVIEW_PERSON = r"\bcolou?red (man|woman|boy|girl|men|women|person|people|fellow|preacher|servant|cook)\b"
SMALL_WORDS = ("a", "an", "and", "the", "of", "for", "on", "in", "at", "to", "by", "or", "&", "de", "la")
DAYS = "(?:MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY|SATURDAY|SUNDAY)"
MONTHS = "(?:JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)"
DATELINE = rf"(?i)\bGA\.?,?\s+{DAYS}\b|\b{DAYS}\s*(?:MORNING|EVENING)?,?\s+{MONTHS}\b"
MONTH = r"(?:Jan|Feb|Mar|Apr|Aug|Sept?|Oct|Nov|Dec)\.?|(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DASH = r"\s*[.,]?\s*(?:[—–]|--?)"
PLACE = r"[A-Z][A-Za-z'’.]+(?:[ -][A-Z][A-Za-z'’.]+){0,2}"
STORY_DATED = rf"\b{PLACE}(?:\s*\([^)]{{2,30}}\))?,(?:\s*[A-Z][A-Za-z.]{{1,12}},)?\s*(?:{MONTH})\s*\d{{1,2}}{DASH}"
STORY_STATE = rf"\b{PLACE},\s*[A-Z][a-z]{{1,5}}\.?\s*(?:[—–]|--)"
STORY_BARE = rf'(?:^|[.!?”"]\s+){PLACE}{DASH}\s*[A-Z“"]'
STORY_WIRE = (
    r"(?i)\b(?:By|\(By)\s+(?:the\s+)?(?:Associated|United)\s+Press\b|\((?:UP|AP|INS|A\.\s?P\.|U\.\s?P\.)\)"
    r"|\bInternational News Service\b|\bSpecial\s+(?:to|Dispatch)\b|\(Special\.?\)"
)
TOOL_TALK = r"(?i)\bthis tool\b|\bzoom\b|\bas an ai\b|\bi(?:'|’)?m (?:unable|not able|sorry)\b"
COMMENTARY = (
    TOOL_TALK + r"|\bi am (?:unable|not able|sorry)\b"
    r"|\bi (?:can(?:no|'|’)t|cannot|could not|couldn(?:'|’)t) (?:zoom|read|make out|see|access|open|view)\b"
    r"|\bthe (?:image|file|clipping|scan) (?:is|does|doesn(?:'|’)?t|appears|shows|contains)\b"
    r"|\bhere(?:'|’)?s? (?:is |are )?(?:the |my |a )?transcription\b|\btranscription:|\bvisible text\b"
    r"|\bis clearly\b|\bin bold(?: display)? type\b|\bin (?:large|small|bold) (?:display )?type\b"
    r"|\bflanking\b|\bappears to (?:read|be|say)\b|\breads as follows\b"
    r"|\bthe (?:masthead|dateline|nameplate|headline|banner) (?:line|text|reads|is|appears)\b"
    r"|\bthe (?:large|small|main|bold) (?:display |body )?(?:text|type|headline|dateline)\b"
    r"|\bset in (?:large|small|bold|display|body)\b|\bpresent the transcription\b|\bthe transcription as printed\b"
    r"|\bclearly renders\b|\bin the original type\b|\brather than a fully illegible\b"
)
LCCN = r"^(?:[a-z]{2}\d{8,10}|\d{10})$"
ISO = r"^\d{4}-\d{2}-\d{2}$"
SHOWN = r"/lccn/([^/]+)/(\d{4}-\d{2}-\d{2})/ed-(\d+)"
RECORD_ID = r"^dlg_ghn_(.+?)-(\d{4}-\d{2}-\d{2})-ed-(\d+)$"

def _some(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def _strip(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def strip_fences(t: Column) -> Column:
    return _strip(F.regexp_replace(_strip(_some(t)), r"^```[a-z]*\n?|\n?```$", ""))


def _line(t: Column) -> Column:
    """One line: white space collapsed, quotation marks around it gone."""
    return F.trim(F.btrim(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit('"')))


def clean(t: Column) -> Column:
    return _line(strip_fences(t))


def _filled(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def items_of(t: Column) -> Column:
    """The reply's lines, each cleaned; empty ones are dropped."""
    return _filled(F.transform(F.split(strip_fences(t), "\n"), _line))


def join_items(items: Column) -> Column:
    """One string; an item ends in a period unless it ends in other final punctuation."""
    ended = F.transform(_filled(F.transform(items, _strip)), lambda x: F.when(F.regexp_like(x, F.lit("[.!?…]$")), x).otherwise(F.concat(x, F.lit("."))))
    return F.array_join(ended, " ")


def _broken(a: Column, b: Column) -> Column:
    return a.endswith("-") & F.regexp_like(b, F.lit(r"^\p{Ll}"))


def _without_last(t: Column) -> Column:
    return F.substring(t, F.lit(1), F.length(t) - 1)


def blocks_of(t: Column) -> Column:
    """Items between blank lines (or the lines, if there are none), with words broken at a line's or item's end rejoined."""
    whole = strip_fences(t)
    parts = F.filter(F.split(whole, r"\n\s*\n"), lambda b: _strip(b) != "")
    parts = F.when(F.size(parts) == 1, F.split(whole, "\n")).otherwise(parts)
    on = lambda a, b: F.when(_broken(a, b), F.concat(_without_last(a), b)).otherwise(F.trim(F.concat(a, F.lit(" "), b)))
    block = lambda b: F.aggregate(_filled(F.transform(F.split(F.replace(b, F.lit("­"), F.lit("-")), "\n"), _line)), F.lit(""), on)

    def merge(done: Column, item: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(F.coalesce(_broken(last, item), F.lit(False)), F.concat(head, F.array(F.concat(_without_last(last), item)))).otherwise(F.concat(done, F.array(item)))

    return F.aggregate(_filled(F.transform(parts, block)), F.array().cast("array<string>"), merge)


def join_broken_words(t: Column) -> Column:
    return F.regexp_replace(t, "(?<=[A-Za-z])- (?=[A-Za-z])", "")


def curl(t: Column) -> Column:
    """Quotation marks curled by position: opening at the start, after white space and opening brackets."""
    for mark, opening, closing in (('"', "“", "”"), ("'", "‘", "’")):
        t = F.replace(F.regexp_replace(_some(t), rf"(^|[\s(\[]){mark}", f"$1{opening}"), F.lit(mark), F.lit(closing))
    return t


def is_commentary(t: Column) -> Column:
    return F.regexp_like(_some(t), F.lit(COMMENTARY))


def tool_talk(t: Column) -> Column:
    return F.regexp_like(_some(t), F.lit(TOOL_TALK))


def unsupported_claims(t: Column) -> Column:
    """The claims marked ABSENT; an empty array if all were found, null if there is no verdict line at all."""
    absent = F.regexp_extract_all(t, F.lit(r"(?m)^\s*ABSENT\s*\|\s*(.+?)\s*(?:\||$)"), 1)
    return F.when((F.size(absent) > 0) | F.regexp_like(t, F.lit(r"(?m)^\s*FOUND\s*\|")), absent)


def _field(t: Column, name: str) -> Column:
    """A label's last value, trimmed; null if the label is missing."""
    return F.try_element_at(F.regexp_extract_all(t, F.lit(rf"(?im)^\s*{name}[ \t]*:[ \t]*(.*?)\s*$"), 1), F.lit(-1))


def _named(t: Column) -> Column:
    t = _strip(_some(t))
    return F.when(F.upper(t).isin("NONE", "N/A", ""), "").otherwise(F.btrim(t, F.lit('"“”')))


def parse_reply(t: Column) -> Column:
    """struct(kind, title, words, picture, caricature); null if kind or picture is missing or the kind is unknown."""
    kind, picture = _field(t, "KIND"), _field(t, "PICTURE")
    first = F.regexp_replace(F.lower(F.try_element_at(F.split(kind, r"\s+"), F.lit(1))), "[^a-z-]", "")
    folded = F.replace(F.lower(kind), F.lit(" "), F.lit("-"))
    kinds = F.array(*map(F.lit, KINDS))
    known = F.when(F.array_contains(kinds, first), first).otherwise(F.try_element_at(F.filter(kinds, lambda k: F.startswith(folded, k)), F.lit(1)))
    words = join_items(F.transform(F.split(_named(_field(t, "WORDS")), r"\|"), _strip))
    fields = F.struct(known.alias("kind"), _named(_field(t, "TITLE")).alias("title"), words.alias("words"), picture.alias("picture"), F.coalesce(F.lower(_field(t, "CARICATURE")).startswith("y"), F.lit(False)).alias("caricature"))
    return F.when(known.isNotNull() & picture.isNotNull() & ~F.contains(t, F.lit("CANNOT_READ")), fields)


def fold(t: Column) -> Column:
    return F.regexp_replace(F.lower(_some(t)), "[^a-z]", "")


def pairs(words: Column) -> Column:
    """Neighbouring words; none for fewer than two. Zipped, as an array named inside a lambda is worked out again for each item."""
    met = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.filter(met, lambda p: p["b"].isNotNull())


def _title_pairs(title: Column) -> Column:
    return F.filter(pairs(F.filter(tokens(title), lambda w: w != "the")), lambda p: F.length(p["a"]) + F.length(p["b"]) >= 6)


def own_title(t: Column, title: Column, words: Column | None = None) -> Column:
    """Why the words are the page's own furniture: 'title', 'part of the title' or 'dateline'; null if they are not. ``words``: the text's tokens, where a column has them."""
    whole = (F.length(fold(title)) >= 6) & F.contains(fold(t), fold(title))
    return F.when(whole, "title").when(F.arrays_overlap(_title_pairs(title), pairs(tokens(t) if words is None else words)), "part of the title").when(F.regexp_like(_some(t), F.lit(DATELINE)), "dateline")


def drop_furniture(t: Column, title: Column) -> Column:
    """The sentences that carry neither a dateline nor two neighbouring words of the title."""
    sentences = F.split(_strip(_some(t)), r"(?<=[.!?”])\s+")
    kept = lambda own: F.filter(sentences, lambda s: ~F.regexp_like(s, F.lit(DATELINE)) & ~F.arrays_overlap(own, pairs(tokens(s))))
    return _strip(F.array_join(once(_title_pairs(title), kept), " "))


def story_shape(t: Column, words: Column | None = None) -> Column:
    """Null for the shape of a news story; else 'two datelines' or 'no dateline'. ``words``: the text's tokens, where a column has them."""
    t = _some(t)
    dated = F.regexp_extract_all(t, F.lit(f"({STORY_DATED})"), 1)
    states = F.regexp_extract_all(t, F.lit(f"({STORY_STATE})"), 1)
    count = lambda found: F.size(found) + F.size(F.filter(states, lambda m: ~F.exists(found, lambda d: F.contains(d, m) | F.contains(m, d))))
    bare = F.regexp_like(t, F.lit(STORY_BARE)) & (F.size(ad_markers(t, AD_WORDS, words)) == 0)
    shape = lambda n: F.when(n > 1, "two datelines").when((n == 1) | F.regexp_like(t, F.lit(STORY_WIRE)) | bare, F.lit(None).cast("string")).otherwise("no dateline")
    return once(once(dated, count), shape)


def check_transcription(t: Column, headline: bool, ad_limit: int, prefixes: tuple[str, ...], own: Column | None = None) -> Column:
    """struct(refusal, hits): the first reason to refuse, or null; the vocabulary hits. ``own``: the text's tokens, where a column has them."""
    marks = F.regexp_count(_some(t), F.lit(r"\[illegible\]"))

    def refusal(words: Column) -> Column:
        n, strong = F.size(F.array_remove(words, "illegible")), F.arrays_overlap(words, F.array(*map(F.lit, STRONG_AD)))
        out = F.when((n < 3) | (F.size(F.filter(words, lambda w: (F.length(w) >= 4) & (w != "illegible"))) < 3), "too short").when(marks > F.floor(n / 2), "mostly illegible")
        if headline:
            out = out.when(marks > 0, "unread word")
        return out.when((F.size(ad_markers(t, AD_WORDS, own)) >= ad_limit) | strong, "advertisement")

    return F.struct(once(tokens(t) if own is None else own, refusal).alias("refusal"), hits(t, prefixes, own).alias("hits"))


def review_words(t: Column) -> Column:
    """Words that call for a person's decision on a notice, and the person pattern's finding."""
    text = F.concat(F.lit(" "), F.lower(_some(t)), F.lit(" "))
    listed = lambda s: F.filter(F.array(*map(F.lit, REVIEW_WORDS)), lambda w: F.contains(s, F.concat(F.lit(" "), w, F.lit(" "))) | F.contains(s, F.concat(F.lit(" "), w, F.lit(","))))
    found, person = once(text, listed), F.regexp_substr(F.lower(_some(t)), F.lit(REVIEW_PERSON))
    return once(person, lambda p: F.when(p.isNotNull(), F.concat(found, F.array(p))).otherwise(found))


def display_title(t: Column) -> Column:
    """A catalogue title as readers expect it: capitals but for small words after the first, inner capitals kept."""
    words = F.split(F.trim(F.rtrim(F.trim(_some(t)), F.lit("."))), " ")
    upper = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))
    cased = F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(F.array_join(F.transform(F.split(w, "-"), upper), "-")))
    return F.replace(F.array_join(_filled(cased), " "), F.lit("'"), F.lit("’"))


def post_date(iso: Column) -> Column:
    return F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "MMMM d, yyyy")


def citation(title: Column, city: Column, iso: Column) -> Column:
    where = F.when(F.trim(_some(city)) != "", F.concat(F.trim(city), F.lit(", Georgia"))).otherwise("Georgia")
    return F.concat(F.lit("“"), display_title(title), F.lit(",” "), where, F.lit(", "), post_date(iso), F.lit("."))


def valid_ident(lccn: Column, date: Column) -> Column:
    return F.coalesce(F.regexp_like(lccn, F.lit(LCCN)) & F.regexp_like(date, F.lit(ISO)), F.lit(False))


def identify(record_id: Column, shown: Column) -> Column:
    """struct(lccn, date, ed) from the first address that carries one, else from the identifier; null without either."""
    url = F.try_element_at(F.filter(shown, lambda u: F.regexp_like(u, F.lit(SHOWN))), F.lit(1))
    take = lambda s, p: F.struct(F.regexp_extract(s, p, 1).alias("lccn"), F.regexp_extract(s, p, 2).alias("date"), F.regexp_extract(s, p, 3).cast("int").alias("ed"))
    return F.when(url.isNotNull(), take(url, SHOWN)).when(F.regexp_like(record_id, F.lit(RECORD_ID)), take(record_id, RECORD_ID))


def compact_date(ymd: Column) -> Column:
    """YYYYMMDD to ISO; null for any other length."""
    return F.when(F.length(ymd) == 8, F.concat_ws("-", F.substring(ymd, 1, 4), F.substring(ymd, 5, 2), F.substring(ymd, 7, 2)))


def item_key(lccn: Column, date: Column, lane: Column) -> Column:
    return F.concat_ws(":", lccn, date, F.coalesce(lane, F.lit("nameplate")))


def braces(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def parse_skips(spec: Column, count: Column) -> Column:
    """The set of numbers that a list such as '1, 2 & 4-6' names, sorted; empty for 'none'; null for what cannot be read."""
    t = F.regexp_replace(F.regexp_replace(F.replace(F.lower(_strip(spec)), F.lit("–"), F.lit("-")), r"\band\b|[,&]", " "), r"\s*-\s*", "-")
    parts = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    low = lambda x: F.regexp_extract(x, r"^(\d+)", 1).try_cast("int")
    high = lambda x: F.coalesce(F.regexp_extract(x, r"-(\d+)$", 1).try_cast("int"), low(x))
    right = F.forall(parts, lambda x: F.regexp_like(x, F.lit(r"^\d+(?:-\d+)?$")) & (low(x) <= high(x)) & (low(x) >= 1) & (high(x) <= count))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda x: F.sequence(low(x), high(x))))))
    none = F.array().cast("array<int>")
    return F.when(F.lower(_strip(spec)).isin("none", "0"), none).when((F.size(parts) > 0) & F.coalesce(right, F.lit(False)), numbers)


def flags(margins: Column, floor: float = 0.15) -> Column:
    """The sides of map<side, struct(reason, ratio, text)> whose stop is neither confident nor clear by ``floor``."""
    doubtful = lambda e: e["value"].isNotNull() & ~e["value"]["reason"].isin(*CONFIDENT_REASONS) & (e["value"]["ratio"].isNull() | (e["value"]["ratio"] < floor))
    return F.transform(F.filter(F.map_entries(margins), doubtful), lambda e: e["key"])
