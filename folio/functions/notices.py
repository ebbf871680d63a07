"""Classified notices: rows that open one, headings over one, and a heading's words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that may open a notice, and the shape of its first row.
LEADS = tuple(
    """
    for to or and sale rent let lease exchange trade wanted want lost found strayed stolen
    stray estray taken up room rooms board boarders boarding house houses home homes
    cottage cottages apartment apartments flat flats furnished unfurnished help
    situation situations position positions male female money loan loans land lands
    farm farms lot lots acres horse horses mule mules cow cows cattle hog hogs
    chickens eggs dog dogs seed hay wood coal automobile automobiles auto car cars
    piano typewriter furniture bargain bargains offer offered cheap free reward
    """.split()
)
LEAD = r"""^((?:[A-Za-z][A-Za-z.']*\s+){0,3}[A-Za-z][A-Za-z.']*)[.,:]?\s?([—–-]*)\s*[A-Z0-9$“"]"""
LOOSE = r"^[A-Z][A-Z .']{1,20}[—–-]"
NOISE = r"""^(?:[a-z|!¡;:,.'"]\s+)+"""
HEAD_WORDS = 4


def _list() -> Column:
    return F.array(*map(F.lit, LEADS))


def opens_notice(row: Column, loose: bool = False) -> Column:
    """Whether a row's text opens a notice: one to four list words, then a dash, which a lead in capitals may lack, then a capital or figure.

    ``loose``: capitals and a dash count too. A null row opens none.
    """
    text = F.regexp_replace(F.coalesce(row, F.lit("")), NOISE, "")
    lead, dash = F.regexp_extract(text, LEAD, 1), F.regexp_extract(text, LEAD, 2)
    words = F.filter(F.split(F.lower(lead), r"[\s.']+"), lambda w: w != "")
    found = (F.size(words) > 0) & (F.size(F.array_except(words, _list())) == 0) & ((dash != "") | (lead == F.upper(lead)))
    return found | F.regexp_like(text, F.lit(LOOSE)) if loose else found


def _letters(words: Column) -> Column:
    return F.filter(F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")), lambda w: w != "")


def _longest(word: Column) -> Column:
    """The longest list word of four letters or more that the word begins with; null if it begins with none."""
    order = sorted((w for w in LEADS if len(w) >= 4), key=len, reverse=True)
    return F.try_element_at(F.filter(F.array(*map(F.lit, order)), lambda k: F.startswith(word, k)), F.lit(1))


def notice_heading(words: Column) -> Column:
    """Whether a row's words are a notice's heading: at most ``HEAD_WORDS``, a list word among them, the others beginning with one."""
    plain = _letters(words)
    other = F.array_except(plain, _list())
    listed = F.size(F.array_intersect(plain, _list())) > 0
    return F.coalesce((F.size(plain) <= HEAD_WORDS) & listed & F.forall(other, lambda w: _longest(w).isNotNull()), F.lit(False))


def heading_text(words: Column) -> Column:
    """A heading's words as the list words that they begin with, in capitals; a word that begins with none stays as read."""
    return F.upper(F.array_join(F.transform(_letters(words), lambda w: F.when(F.array_contains(_list(), w), w).otherwise(F.coalesce(_longest(w), w))), " "))
