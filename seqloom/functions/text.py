"""Dates and words: heuristic date parsing, tokens, stop words and the Porter stemmer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def parse_date(text: Column) -> Column:
    """A date out of text in many orders. A month name decides; else a part above 31 is the year and one above 12 the day. Parts between
    slashes are American (month first), parts between dots, commas or blanks European (day first), and between dashes American too if the
    year is last and the first part isn't above 12, or year-month-day if it is first. A year alone is its first day. Null where no date is found."""
    low = F.lower(F.trim(text))
    name = F.regexp_extract(low, "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", 1)
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), name).cast("int")
    n = F.transform(F.regexp_extract_all(low, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
    a, b, c = (F.get(n, i) for i in range(3))
    year_of = lambda x, y: F.when(x > 31, x).otherwise(y)
    day_of = lambda x, y: F.when(x > 31, y).otherwise(x)
    make = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    named = F.when(F.size(n) >= 2, make(year_of(a, b), month, day_of(a, b)))
    first = make(a, b, c)
    american, european = make(c, a, b), make(c, b, a)
    numbers = (
        F.when(F.size(n) == 1, F.when(a > 31, make(a, F.lit(1), F.lit(1))))
        .when(a > 31, first)
        .when(a > 12, european)
        .when(b > 12, american)
        .when(low.rlike("[/-]"), american)
        .otherwise(european)
    )
    return F.when(name != "", named).otherwise(numbers)


def letters_tokens(text: Column) -> Column:
    """Runs of A-Z and a-z."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))


def visible_text(html: Column) -> Column:
    """HTML less comments, scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


STOP_WORDS = sorted(
    "able about above after again also although always among another because been before being below between both cannot could does doing down during each either "
    "else ever every from further have having hence here hers herself himself into itself just less like made make many more most much must myself neither never next "
    "none nothing once only other otherwise ours over perhaps quite rather same several shall should since some still such than that their them then there these they "
    "this those though through thus together under until upon very were what when where whether which while whom whose will with within without would your yours".split()
)

_VOWELS = set("aeiou")
_SHAPE = str.maketrans({c: "v" if c in _VOWELS else "c" for c in "abcdefghijklmnopqrstuvwxyz"})


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    plain = "y" not in w and w.isascii() and w.isalpha()
    shape = w.translate(_SHAPE) if plain else "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return shape.count("vc")


def _cvc(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# the longest ending first
_STEP2, _STEP3 = (sorted(table, key=lambda x: -len(x[0])) for table in (_STEP2, _STEP3))
_STEP4 = sorted(_STEP4, key=len, reverse=True)


def porter_stem(word: str) -> str:
    """Porter's algorithm of 1980, in lower case."""
    w = word.lower()
    if len(w) <= 2:
        return w
    has_vowel = lambda x: any(not _consonant(x, i) for i in range(len(x)))
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in table:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in _STEP4:
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for words in batches:
        if len(known) > 300_000:
            known.clear()
        known.update((w, porter_stem(w)) for w in words.dropna().unique() if w not in known)
        yield words.map(known.get, na_action="ignore")


def wrapped(text: Column, width: int) -> Column:
    """The lines of text broken at blanks to at most width characters; a longer word is a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def place(lines: Column, w: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        fits = (F.size(lines) > 0) & (F.length(F.coalesce(last, F.lit(""))) + 1 + F.length(w) <= width)
        return F.when(fits, F.concat(F.slice(lines, F.lit(1), F.greatest(F.lit(0), F.size(lines) - 1)), F.array(F.concat_ws(" ", last, w)))).otherwise(F.concat(lines, F.array(w)))

    return F.aggregate(words, F.array().cast("array<string>"), place)


def chomp(text: Column) -> Column:
    """text without line ends at its end."""
    return F.regexp_replace(text, "[\r\n]+$", "")


def tag_attributes(tag: Column) -> Column:
    """The attributes of a tag with double quotes, as a map. Names must not come again, as in XML."""
    names, values = (F.regexp_extract_all(tag, F.lit(r'([A-Za-z_][A-Za-z0-9_.:-]*)\s*=\s*"([^"]*)"'), F.lit(i)) for i in (1, 2))
    return F.map_from_arrays(names, values)
