"""Column functions on text: cleaning, canonical text, tokens. All but arbitrary HTML and stems stay in the JVM."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it, for Java's patterns.
SPACES = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: Spellings of "nothing".
NOTHING = ("", "na", "n/a", "none", "null")
#: Words that carry no meaning in the catalogue.
STOPWORDS = tuple(
    "a an and are as at be been being buy by for from has have he her hers him his i in into is it its of on or our ours product products she that the their theirs them they this those to use using was we were what when where which who will with you your yours".split()
)
TOKEN = r"[a-z0-9]+(?:'[a-z0-9]+)?"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_whitespace(c: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(col(c), SPACES, " "))


def normalize_value(c: Column | str) -> Column:
    """White space normalised; null and every spelling of "nothing" become the empty string."""
    x = F.coalesce(normalize_whitespace(col(c).cast("string")), F.lit(""))
    return F.when(F.lower(x).isin(*NOTHING), F.lit("")).otherwise(x)


def safe_slug(c: Column | str) -> Column:
    """Lower case, runs of other characters as one hyphen; ``unknown`` if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("unknown")).otherwise(x)


def something(values: Column) -> Column:
    """The items of an array, white space normalised once each, without those that mean nothing."""
    clean = F.transform(values, lambda x: F.coalesce(normalize_whitespace(x), F.lit("")))
    return F.filter(clean, lambda x: ~F.lower(x).isin(*NOTHING))


def _flat(c: Column | str) -> Column:
    pairs = F.flatten(F.transform(F.map_entries(col(c)), lambda e: F.array(e["key"].cast("string"), e["value"].cast("string"))))
    return F.coalesce(pairs, F.array().cast("array<string>"))


def flatten_attributes(c: Column | str) -> Column:
    """Keys and values of a map in order, each normalised, empties left out; null gives an empty array."""
    return something(_flat(c))


def canonical_text(parts: Iterable[Column | str], attributes: Column | str | None = None) -> Column:
    """All parts normalised, empties left out, joined by blanks."""
    values = F.array(*[col(p).cast("string") for p in parts])
    return F.array_join(something(values if attributes is None else F.concat(values, _flat(attributes))), " ")


def category_map(columns: dict[str, Column | str]) -> Column:
    """A map of the values that are something; the others have no key."""
    pairs = [x for name, c in columns.items() for x in (F.lit(name), normalize_value(c))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v != "")


class _Pieces(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []

    def handle_data(self, data: str) -> None:
        if piece := " ".join(data.split()):
            self.pieces.append(piece)


def strip_markup(text: str) -> str:
    """Entities resolved, then tags and comments dropped; the text of any element stays, script and style too."""
    parser = _Pieces()
    parser.feed(html.unescape(text))
    parser.close()
    return " ".join(parser.pieces)


@F.pandas_udf(StringType())
def _strip_markup(texts: pd.Series) -> pd.Series:
    return texts.map(strip_markup, na_action="ignore")


def clean_html(c: Column | str) -> Column:
    """Text without markup. Only texts with a tag or an entity go to Python; null gives the empty string."""
    x = col(c)
    marked = F.when(x.rlike("[<&]"), x)
    return F.coalesce(_strip_markup(marked), normalize_whitespace(x), F.lit(""))


def tokens(c: Column | str, lowercase: bool = True) -> Column:
    """Runs of a-z and 0-9 with at most one apostrophe inside; null gives an empty array."""
    x = F.coalesce(col(c), F.lit(""))
    return F.regexp_extract_all(F.lower(x) if lowercase else x, F.lit(TOKEN), F.lit(0))


def without_stopwords(c: Column | str, words: Iterable[str] = STOPWORDS) -> Column:
    return F.filter(col(c), lambda t: ~t.isin(*words))


def split_words(c: Column | str) -> Column:
    """The words between white space; empty and null texts have none."""
    x = normalize_whitespace(F.coalesce(col(c), F.lit("")))
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " "))


_VOWELS = "aeiou"


def _measure(stem: str) -> int:
    """How many vowel-consonant sequences a stem has."""
    return len(re.findall("vc", re.sub("(.)\\1+", "\\1", _shape(stem))))


def _shape(word: str) -> str:
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in _VOWELS or c == "y" and k and out[k - 1] == "c" else "c"
    return out


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


#: Suffix pairs of steps 2 and 3, and suffixes dropped in step 4, of Porter's algorithm (1980).
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """The stem of an English word by Porter's algorithm of 1980; words of up to two letters stay."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    trimmed = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        trimmed = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        trimmed = w[:-3]
    if trimmed is not None:
        w = trimmed
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_end(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        fit = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if fit and _measure(w[: -len(fit[0])]) > 0:
            w = w[: -len(fit[0])] + fit[1]
    suffix = max((s for s in _STEP4 if w.endswith(s)), key=len, default="")
    if suffix and _measure(w[: -len(suffix)]) > 1 and (suffix != "ion" or w[: -len(suffix)].endswith(("s", "t"))):
        w = w[: -len(suffix)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    """Stems of distinct words; apply it to a column of terms after they are made distinct."""
    return words.map(porter, na_action="ignore")


#: Spellings of the three splits.
SPLITS = {"train": "train", "training": "train", "validation": "validation", "valid": "validation", "val": "validation", "dev": "validation", "eval": "validation", "test": "test", "testing": "test"}


def split_name(c: Column | str) -> Column:
    """train, validation or test, whatever its case and blanks; null for anything else."""
    return F.create_map(*[F.lit(x) for pair in SPLITS.items() for x in pair])[F.lower(normalize_whitespace(col(c)))]


def chunk_product(c: Column | str) -> Column:
    """The product id within a chunk id (modality:product:position); null where there is none."""
    return F.try_element_at(F.split(col(c), ":"), F.lit(2)).try_cast("long")


def digest(c: Column | str) -> Column:
    """The 64 hexadecimal digits in a text, lower case; null where there are none."""
    found = F.regexp_extract(F.lower(col(c)), r"(?<![0-9a-f])([0-9a-f]{64})(?![0-9a-f])", 1)
    return F.when(found != "", found)
