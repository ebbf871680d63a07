"""Alternative texts of clips: what was cut, from where, and the words read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.replies import post_date

# The label of words that a model read, the longest text, and each lane's noun.
TRANSCRIBED, MOST = "A.I.-transcribed", 1900
NOUNS = (("headline", "headline"), ("article", "article"), ("ad", "advertisement"), ("market", "market report"), ("classified", "classified advertisements"))


def _shorten(t: Column, end: str) -> Column:
    kept = F.regexp_replace(F.substring(t, 1, MOST - len(end)), r"(?U)\s+$", "")
    return F.when(F.length(t) > MOST, F.concat(kept, F.lit(end))).otherwise(t)


def place(city: Column, region: str) -> Column:
    bare = F.trim(F.coalesce(city, F.lit("")))
    return F.when(bare != "", F.concat(bare, F.lit(f", {region}"))).otherwise(region)


def alt_text(lane: Column, alt: Column, words: Column, title: Column, city: Column, region: str, date: Column, seq: Column, context: Column, spread: Column, generated: Column, tail: Column) -> Column:
    """A clip's alternative text, of at most 1,900 characters.

    A cartoon's is its own; a nameplate's gains the band beneath where ``context`` and words are given; others
    name the title, place, date and page and quote the words, with a picture's ``tail`` after (null: none).
    Without words a clip keeps its ``alt``, cut off.
    """
    some = F.coalesce(words, F.lit("")) != ""
    yes = lambda c: F.coalesce(c, F.lit(False))
    band = F.concat(F.rtrim(alt, F.lit(".")), F.lit(f", with the top of the page beneath it. {TRANSCRIBED}, the band beneath reads: “"), words, F.lit("”"))
    noun = F.when(yes(spread), "headlines").otherwise(F.element_at(F.create_map(*[F.lit(v) for p in NOUNS for v in p]), lane))
    lead = F.when(yes(generated), F.concat(F.lit(f"{TRANSCRIBED} "), noun)).otherwise(F.concat(F.upper(F.substring(noun, 1, 1)), F.substring(noun, 2, 100)))
    full = F.concat(lead, F.lit(" from “"), title, F.lit(",” "), place(city, region), F.lit(", "), post_date(date), F.lit(", page "), seq.cast("string"), F.lit(", reading: “"), words, F.lit("”"))
    return (
        F.when(lane == "cartoon", _shorten(alt, "…")).when(lane == "nameplate", _shorten(F.when(yes(context) & some, band).otherwise(alt), "…”"))
        .when(~some, F.substring(alt, 1, MOST)).when(tail.isNotNull(), _shorten(F.concat(full, tail), "…")).otherwise(_shorten(full, "…”"))
    )
