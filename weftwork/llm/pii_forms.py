"""Forms of personal information, and labelled spans to train on.

The forms are general spellings. They serve twice: on a bounded sample of the corpus they label spans, and after decoding
they trim a found span to its exact bounds. What is personal information and what not is the tagger's decision alone.

No sentence, cue phrase or look-alike is written down here. Contexts come from the sample: a labelled span is replaced,
where it stands, by invented values of its kind in many spellings, so that the tagger sees the corpus's own sentences
around far more names, streets and numbers than a sample holds. Names are first labelled by the list of given names and by
titles; contexts in which several of those stand label further names; a pair that comes again and again, one of whose
words also stands alone in small letters, is a fixed phrase, not a person.
"""

from __future__ import annotations

import random
import re

I = re.IGNORECASE

# White space within a form never crosses a line.
_AT = r"(?:[^\S\n]?[@＠][^\S\n]?|[^\S\n]?[\[({<][^\S\n]?(?:at|@)[^\S\n]?[\])}>][^\S\n]?|[^\S\n]+at[^\S\n]+)"
_DOT = r"(?:[^\S\n]?[\[({<][^\S\n]?(?:dot|\.)[^\S\n]?[\])}>][^\S\n]?|[^\S\n]+dot[^\S\n]+|\.)"
EMAIL = re.compile(rf"\w(?:[\w.+%'-]*\w)?{_AT}\w(?:[\w-]*\w)?(?:{_DOT}\w(?:[\w-]*\w)?)*{_DOT}[^\W\d_]{{2,}}(?!\w)", I)

PHONE = re.compile(
    r"(?<![\w.+-])(?:"
    r"\(?\+[^\S\n]?\d{1,3}\)?(?:(?:[^\S\n]|[.\-/])*\(?\d{1,5}\)?){2,6}"  # international with plus
    r"|00[^\S\n]?[1-9]\d(?:(?:[^\S\n]|[.\-/])*\(?\d{1,5}\)?){2,6}"  # international with zeros
    r"|\(0\d{1,4}\)(?:[^\S\n]|[.\-/])*\d{2,5}(?:(?:[^\S\n]|[.\-/])*\d{2,6}){0,3}"
    r"|\(\d{3}\)(?:[^\S\n]|[.\-])*\d{3}(?:[^\S\n]|[.\-])?\d{4}"
    r"|1(?:[^\S\n]|[.\-])\d{3}(?:[^\S\n]|[.\-])\d{3}(?:[^\S\n]|[.\-])\d{4}"
    r"|\d{3}(?P<gap>[^\S\n]|[.\-])\d{3}(?P=gap)\d{4}|\d{10}"
    r"|\d{3}-\d{4}"
    r"|0\d{2,4}(?:[^\S\n]|[.\-/])?\d{3,5}(?:(?:[^\S\n]|[.\-])?\d{3,5}){0,2}"
    r"|0\d(?:(?:[^\S\n]|[.\-])?\d{2}){4}"
    r"|\d{3}(?:(?:[^\S\n]|[.\-])\d{2}){3}|\d{3}(?:(?:[^\S\n]|[.\-])\d{3}){2}"
    r"|[1-9]\d{8}"
    r")(?![\w-]*\d)"
)
#: Words for a telephone and for an identity document in four languages; bare runs of digits are labelled only near one.
_CALL = re.compile(r"\b(?:tel|tél|téléphone|telefon|teléfono|phone|mobile|móvil|portable|cell|handy|whatsapp|fax|call|ring|text|sms|llame|llamar|llámeme|appel\w*|rappel\w*|joindre|joignable|anrufen|rückruf|erreichbar)\b[^\d\n]{0,14}$", I)
_IDENTITY = re.compile(r"\b(?:ssn|social security|insurance|national|passport|passeport|pasaporte|pass|id|identity|identité|identidad|identifi\w*|ausweis|personalausweis|steuer\w*|tax|fiscal|dni|nie|nif|sécu\w*|seguridad|nir|document|documento|carte|licen[cs]e)\b[^\d\n]{0,14}$", I)
ID_NUMBER = re.compile(
    r"(?<![\w+-])(?:"
    r"\d{3}-\d{2}-\d{4}|\d{3}[^\S\n]\d{2}[^\S\n]\d{4}"
    r"|[A-Z]{2}(?:[^\S\n]|-)?\d{2}(?:[^\S\n]|-)?\d{2}(?:[^\S\n]|-)?\d{2}(?:[^\S\n]|-)?[A-Z]"
    r"|[A-Z]{1,2}\d{7,8}"
    r"|\d{2}\.?\d{3}\.?\d{3}(?:[^\S\n]|-)?[A-Z]"
    r"|[XYZ](?:[^\S\n]|-)?\d{7}(?:[^\S\n]|-)?[A-Z]"
    r"|\d{2}[^\S\n]\d{3}[^\S\n]\d{3}[^\S\n]\d{3}|\d{11}"
    r"|[12][^\S\n]?\d{2}[^\S\n]?\d{2}[^\S\n]?\d{2}[^\S\n]?\d{3}[^\S\n]?\d{3}(?:[^\S\n]?\d{2})?"
    r")(?!\w|[-.]\d)",
    I,
)
_UNIT = r"(?:(?:Flat|Unit|Apt|Suite|Apartment)[^\S\n]\w{1,4}(?:,[^\S\n]|/|[^\S\n]))?"
_WORD = r"[^\W\d_][\w'’-]*"
STREET_WORDS = ("Road", "Rd", "Street", "St", "Avenue", "Ave", "Lane", "Ln", "Drive", "Dr", "Close", "Court", "Ct", "Terrace", "Ter", "Way", "Place", "Path", "Crescent", "Grove", "Square", "Row", "Hill", "Gardens", "Mews", "Boulevard", "Blvd", "Parkway")


def address_form(strict: bool) -> re.Pattern:
    """Street and house number with flat or unit, in four languages. Strict: the English form needs capitals."""
    word = r"(?-i:[A-ZÀ-Ý])[\w'’-]+" if strict else _WORD
    cased = r"(?-i:[A-ZÀ-Ý])" if strict else ""
    street = "|".join([w for s in STREET_WORDS for w in (s, s.upper())])
    street = f"(?-i:{street})" if strict else f"(?:{street})"
    return re.compile(
        r"(?<![\w-])(?<!\d[.,])(?:"
        rf"{_UNIT}\d{{1,4}}[A-Za-z]?[^\S\n](?:[NSEW]\.[^\S\n])?{word}(?:[^\S\n]{word})?[^\S\n]{street}\b(?:,[^\S\n](?:Apt|Flat|Unit|Suite|Apartment)[^\S\n]\w{{1,4}})?"
        rf"|(?:C/|Calle|C\.|Avda\.?|Av\.|Avenida|Plaza|Pza\.|Paseo|Camino|Ronda|Carrera)[^\S\n]?(?:de[^\S\n](?:la[^\S\n]|los[^\S\n]|las[^\S\n])?|del[^\S\n])?{_WORD}(?:[^\S\n]{_WORD})?,?[^\S\n](?:n[º°.][^\S\n]?|núm\.[^\S\n]?)?\d{{1,4}}(?:,?[^\S\n]\d{{1,2}}[^\S\n]?[º°ª][^\S\n]?(?:[A-Z]|izq|dcha)?\b)?"
        rf"|\d{{1,4}}(?:[^\S\n](?:bis|ter))?,?[^\S\n](?:rue|avenue|av\.|bd|boulevard|place|chemin|impasse|allée|quai|cours)[^\S\n](?:de[^\S\n](?:la[^\S\n]|l['’])?|des[^\S\n]|du[^\S\n]|d['’])?{cased}{_WORD}"
        rf"|(?:{cased}{_WORD}(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|ring|damm)|(?:Am|An[^\S\n]der|Im|Zum|Zur)[^\S\n]{_WORD})[^\S\n]\d{{1,4}}[a-z]?\b"
        r")",
        I,
    )


ADDRESS = address_form(False)
ADDRESS_STRICT = address_form(True)
_CAP = r"[^\W\d_a-zà-ÿ][^\W\d_]+"
#: Small words within names.
_PARTICLE = r"(?:de[^\S\n](?:la|los|las)|del|de|la|von[^\S\n](?:der|den)|von|van[^\S\n](?:der|den|de)|van|du|di)"
PARTICLES = re.compile(rf"(?<![\w'’-]){_PARTICLE}(?![\w'’-])")
_FAMILY = rf"(?:{_PARTICLE}[^\S\n])?{_CAP}(?:-{_CAP})?"
_FIRST = rf"(?:{_CAP}(?:-{_CAP})?|[^\W\d_a-zà-ÿ]\.)"
_PERSON = rf"(?:{_FIRST}(?:\s[A-Z]\.)?\s{_FAMILY}|{_FAMILY},\s{_FIRST}(?:\s[A-Z]\.)?(?!\s{_CAP}))"
NAME = re.compile(rf"(?<!\w){_PERSON}(?!\w)")

FORMS = {"email": EMAIL, "phone": PHONE, "id_number": ID_NUMBER, "address": ADDRESS, "name": NAME}

#: Titles before a person's name in four languages.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Madam", "Herr", "Frau", "Señor", "Señora", "Sr.", "Sra.", "Srta.", "Don", "Doña", "Monsieur", "Madame", "Mme", "Mlle", "M.")
_TITLE = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, TITLES))})(?=\.?[^\S\n])", I)
_PAIR = re.compile(rf"(?<!\w)(?P<n>{_PERSON})(?!\w)")
_WORDS = re.compile(r"[^\W\d_]+")


def _bare(number: str) -> bool:
    """A run of digits without any separator, sign or letter."""
    return number.isdigit()


def formed(text: str) -> list[tuple[int, int, str]]:
    """Spans of the kinds that have a form; a bare run of digits counts only after a word for it. They don't overlap."""
    out: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))
    for kind in ("email", "address", "id_number", "phone"):
        for m in (ADDRESS_STRICT if kind == "address" else FORMS[kind]).finditer(text):
            a, b = m.span()
            lead = text[max(0, a - 40) : a]
            if _bare(m.group()) and not (_CALL if kind == "phone" else _IDENTITY).search(lead):
                continue
            while b > a and text[b - 1] in ".,;: ":
                b -= 1
            if kind == "phone" and sum(c.isdigit() for c in text[a:b]) < 7:
                continue
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((a, b, kind))
    return sorted(out)


def people(texts: list[str], given: frozenset[str], least: int = 3) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """For each text the spans that are most likely persons' names, and those that may be; learned from the texts together.

    A pair of capitalised words one of which is a listed given name, or that follows a title, is a candidate; not so if
    its other words stand in small letters as often as not, or if the pair stands ``least``
    times and is a fixed phrase: one of its words stands in small letters away from a listed name, or what it always goes
    on with mostly follows repeated pairs. What stands around at least ``least`` different candidates, two words on one side, one on each, or one
    with a comma or colon before, is a context, and other capitalised pairs in a context are names too.
    """
    count: dict[str, int] = {}
    free: set[str] = set()  # words that stand in small letters, not only behind a listed name
    for t in texts:
        before = ""
        for w in _WORDS.findall(EMAIL.sub(" ", t)):  # addresses have names in small letters
            count[w.lower()] = count.get(w.lower(), 0) + (1 if w.islower() else -1)
            if w.islower() and before not in given:
                free.add(w)
            before = w.lower()
    small = {w for w, n in count.items() if n > 0} | {w.lower() for w in STREET_WORDS}

    def around(t: str, a: int, b: int) -> list[tuple]:
        before, after = re.findall(r"\S+", t[max(0, a - 60) : a])[-2:], re.findall(r"\S+", t[b : b + 60])[:2]
        out = [("before", *before)] if len(before) == 2 else []
        out += [("after", *after)] if len(after) == 2 else []
        out += [("beside", before[-1], after[0])] if before and after else []
        out += [("lead", before[-1])] if before and before[-1][-1] in ",:" and not any(c.isdigit() for c in before[-1]) else []
        return out

    street = {w.lower() for w in STREET_WORDS}
    found: list[tuple[int, int, int, bool]] = []
    follow: dict[str, list] = {}
    for k, t in enumerate(texts):
        titles = {m.end() for m in _TITLE.finditer(t)}
        for m in _PAIR.finditer(_TITLE.sub(lambda x: x.group().lower(), t)):
            a, b = m.span("n")
            words = _WORDS.findall(PARTICLES.sub("", m.group("n")))
            listed = [w for w in words if w.lower() in given]
            others = [w for w in words if w.lower() not in given and len(w) > 1]
            likely = any(t[e:a].strip(" .") == "" for e in range(max(0, a - 3), a) if e in titles) or (bool(listed) and bool(others) and not any(w.lower() in small for w in others))
            found.append((k, a, b, likely))
            nxt = re.match(r"[^\S\n]*([^\W\d_]+)", t[b : b + 40])
            follow.setdefault(m.group("n").lower(), []).append(nxt.group(1).lower() if nxt else "")
    repeated = {n for n, after in follow.items() if len(after) >= least}
    led: dict[str, set] = {}
    for n, after in follow.items():
        for w in after:
            led.setdefault(w, set()).add(n)
    always = {n for n in repeated if len(set(follow[n])) == 1 and follow[n][0] and 2 * len(led[follow[n][0]] & repeated) >= len(led[follow[n][0]])}
    fixed = always | {n for n in repeated if any(w in free or w in street for w in _WORDS.findall(n) if w not in given)}
    contexts: dict[tuple, set] = {}
    for k, a, b, likely in found:
        if likely and texts[k][a:b].lower() not in fixed:
            for c in around(texts[k], a, b):
                contexts.setdefault(c, set()).add(texts[k][a:b].lower())
    known = {c for c, names in contexts.items() if len(names) >= least}
    # A context must hold candidates more often than other pairs.
    other: dict[tuple, set] = {}
    for k, a, b, likely in found:
        if not likely:
            for c in around(texts[k], a, b):
                if c in known and all(w.lower() in small for w in _WORDS.findall(texts[k][a:b])):
                    other.setdefault(c, set()).add(texts[k][a:b].lower())
    known = {c for c in known if len(other.get(c, ())) < len(contexts[c])}
    # A word that stands in several pairs none of which looks like a name is an ordinary word too.
    pairs: dict[str, set] = {}
    named: set[str] = set()
    rows = []
    for k, a, b, likely in found:
        name = texts[k][a:b]
        words = [w.lower() for w in _WORDS.findall(PARTICLES.sub("", name)) if len(w) > 1]
        placed = any(c in known for c in around(texts[k], a, b))
        rows.append((k, a, b, likely, placed, name.lower(), words))
        for w in words:
            pairs.setdefault(w, set()).add(name.lower())
            if likely or placed:
                named.add(w)
    plain = {w for w, n in pairs.items() if len(n) >= least and w not in named}
    sure: list[list[tuple[int, int]]] = [[] for _ in texts]
    open_: list[list[tuple[int, int]]] = [[] for _ in texts]
    for k, a, b, likely, placed, name, words in rows:
        if name in fixed:
            continue
        ordinary = [w in small or w in plain for w in words if w not in given]
        if likely or (placed and not all(ordinary or [True])):
            sure[k].append((a, b))
        elif not any(ordinary) and "," not in name:  # two unlisted words with a comma between are most often none
            open_[k].append((a, b))
    return sure, open_


def label(texts: list[str], given: frozenset[str]) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int]]]]:
    """For each text its spans (begin, end, kind), sorted and apart, and what may or may not be a name: to be left out."""
    out = []
    for t, sure, open_ in zip(texts, *people(texts, given)):
        spans = formed(t)
        apart = lambda a, b: not any(x < b and a < y for x, y, _ in spans)  # noqa: B023, E731
        spans += [(a, b, "name") for a, b in sure if apart(a, b)]
        out.append((sorted(spans), [(a, b) for a, b in open_ if apart(a, b)]))
    return out


class Maker:
    """Invented personal information in many spellings."""

    #: Syllables by rule: an opening, a vowel, an end; common endings of family names in several languages; common given
    #: names beside those of the list.
    SYLLABLES = tuple(o + v + e for o in ("", *"bcdfghjklmnprstvwz", "br", "cl", "dr", "fr", "gr", "kr", "pl", "qu", "sch", "st", "th", "tr") for v in "aeiou" for e in ("", "l", "n", "r", "s", "x"))
    ENDS = ("son", "sen", "berg", "stein", "mann", "man", "ski", "ov", "ova", "ez", "ado", "ero", "ini", "elli", "etti", "ier", "eau", "ford", "ton", "ley", "by", "ham", "well", "wood", "more", "er", "ard", "ing")
    GIVEN = ("Maria", "Anna", "Peter", "Jean", "Luis", "Hans", "David", "Laura", "Michael", "Sarah", "Thomas", "Julia", "Carlos", "Sophie", "Paul", "Elena", "Jürgen", "René", "Inés", "José", "Karim", "Mei", "Amina", "Olga")
    SMALL = ("de", "de la", "del", "la", "von", "von der", "van", "van der", "du", "di")
    STREETS = ("Road", "Rd", "Street", "St", "Avenue", "Ave", "Lane", "Drive", "Close", "Terrace", "Court", "Way", "Place")
    def __init__(self, seed: int, given: list[str]):
        self.r = random.Random(seed)
        self.given = [*given, *self.GIVEN]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self, least: int = 2, most: int = 3) -> str:
        return "".join(self.r.choice(self.SYLLABLES) for _ in range(self.r.randint(least, most))).capitalize()

    def family(self) -> str:
        one = lambda: (self.r.choice(self.SYLLABLES) + (self.r.choice(self.SYLLABLES) if self.r.random() < 0.2 else "") + self.r.choice(self.ENDS)).capitalize()
        return one() + (f"-{one()}" if self.r.random() < 0.12 else "")

    def name(self) -> str:
        r = self.r
        first = r.choice(self.given) if r.random() < 0.85 else self.word(1, 2)
        kind = r.random()
        middle = f" {r.choice('ABCDEFGHJKLMNPRSTVW')}." if r.random() < 0.2 else ""
        family = f"{r.choice(self.SMALL)} {self.family()}" if r.random() < 0.06 else self.family()
        full = f"{first}{middle} {family}" if kind < 0.68 else f"{family}, {first}" if kind < 0.84 else f"{first[0]}. {family}"
        case = r.random()
        return full.lower() if case < 0.05 else full.upper() if case < 0.11 else full

    def email(self) -> str:
        r = self.r
        first, last = r.choice(self.given).lower(), self.family().lower()
        local = r.choice((f"{first}.{last}", f"{first}_{last}{self.digits(2)}", f"{first[0]}{last}", f"{first}+{r.choice(('news', 'shop', 'returns'))}", f"{first}{self.digits(r.randint(2, 4))}", r.choice(("info", "hello", "contact", "sales", "support", "service", "orders", "kontakt", "contacto")), last))
        domain = [r.choice(("example", self.word().lower(), f"{self.word().lower()}-{self.word(1, 1).lower()}", f"mail.{self.word().lower()}", f"{self.word(1, 1).lower()}.{self.word().lower()}")), r.choice(("example", "test", "invalid", "com", "org", "net", "de", "es", "fr", "co.example"))]
        full = ".".join(domain)
        style = r.random()
        if style < 0.62:
            out = f"{local}@{full}"
        elif style < 0.72:
            out = f"{local} @ {full}"
        elif style < 0.78:
            out = f"{local} at {full}"
        else:
            a = r.choice((" [at] ", " (at) ", "(at)", "[at]", " at "))
            dot = r.choice((" [dot] ", " (dot) ", " dot ", ".") if a != " at " else (" dot ", "."))
            out = local + a + full.replace(".", dot)
        return out.upper() if r.random() < 0.05 else out.title() if r.random() < 0.03 else out

    def phone(self) -> str:
        d, r = self.digits, self.r
        us, last, one = d(3), d(4), r.choice("123456789")
        return r.choice((
            f"({us}) {d(3)}-{last}", f"{d(3)}-{last}", f"1-{us}-{d(3)}-{last}", f"+1 {us} {d(3)} {last}", f"+1-{us}-{d(3)}-{last}", f"+1.{us}.{d(3)}.{last}", f"{us} {d(3)} {last}", f"{us}{d(7)}", f"+1-{us}{d(7)}", f"{us}-{d(3)}-{last}", f"{us}.{d(3)}.{last}",
            f"+44 (0){d(4)} {d(6)}", f"+44 20 {d(4)} {last}", f"+44 {d(4)} {d(3)} {d(3)}", f"0044 {d(4)} {d(3)} {d(3)}", f"0{d(4)} {d(3)} {d(3)}", f"0{d(10)}", f"0{d(2)} {d(4)} {last}", f"(0{d(2)}) {d(4)} {last}",
            f"{one}{d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {one}{d(2)} {d(2)} {d(2)} {d(2)}", f"(+34) {one}{d(2)}-{d(2)}-{d(2)}-{d(2)}", f"0034{one}{d(8)}", f"{one}{d(2)} {d(3)} {d(3)}", f"+34{one}{d(8)}", f"{one}{d(2)}-{d(2)}-{d(2)}-{d(2)}", f"{one}{d(8)}", f"{one}{d(8)}",
            f"+33 {one} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 (0){one} {d(2)} {d(2)} {d(2)} {d(2)}", f"0033{one}{d(2)} {d(2)}{d(4)}", f"0{one} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{one}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+33{one}{d(8)}",
            f"0{d(2)} {d(5)} {d(3)}", f"0{d(2)}/{d(8)}", f"(0{d(2)}) {d(5)}-{d(3)}", f"0{d(2)}.{d(5)}.{d(3)}", f"0049 {d(2)} {d(5)} {d(3)}", f"+49 {d(2)} {d(8)}", f"0{d(2)}-{d(8)}", f"+49 (0){d(2)} {d(5)} {d(3)}",
        ))

    def id_number(self) -> str:
        d, r = self.digits, self.r
        a, letter, last = d(3), r.choice("ABCDEFGHJKLMNPQRSTVWXYZ"), r.choice("ABCD")
        pair = "".join(r.choices("ABCDEFGHJKLMNPQRSTVWXYZ", k=2))
        return r.choice((
            f"{a}-{d(2)}-{d(4)}", f"{a}-{d(2)}-{d(4)}", f"{a} {d(2)} {d(4)}", f"{pair}-{d(2)}-{d(2)}-{d(2)}-{last}", f"{pair} {d(2)} {d(2)} {d(2)} {last}", f"{pair}{d(6)}{last}", f"{pair}{d(7)}", f"{letter}{d(8)}",
            f"{d(8)}-{letter}", f"{d(8)}{letter}", f"{d(2)}.{d(3)}.{d(3)}-{letter}", f"{d(2)}.{d(3)}.{d(3)}{letter}", f"{r.choice('XYZ')}-{d(7)}-{letter}", f"{r.choice('XYZ')}{d(7)}{letter}",
            f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(11)}", f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{r.choice('12')}{d(14)}",
        ))

    def address(self) -> str:
        r, w = self.r, self.word
        n = f"{r.randint(1, 250)}{r.choice(('', '', '', '', 'B', 'b', 'a'))}"
        flat = f"{r.randint(1, 9)}{r.choice('ABCD')}" if r.random() < 0.5 else f"{r.randint(1, 12)}"
        out = r.choice((
            f"{n} {w()} {r.choice(self.STREETS)}", f"{n} {w()} {r.choice(self.STREETS)}, Apt {flat}", f"{n} {r.choice('NSEW')}. {w()} {r.choice(self.STREETS)}", f"Unit {r.randint(1, 9)}/{n} {w()} {r.choice(self.STREETS)}", f"Flat {flat}, {n} {w()} {r.choice(self.STREETS)}",
            f"C/ {w()} nº {n}", f"Calle {w()} {n}, {r.randint(1, 6)}º {r.choice('ABCD')}", f"Avda. de {w()}, {n}", f"Plaza {w()} {n}", f"Calle de {w()}, {n}", f"C/ {w()} {n}",
            f"{n} rue {w()}", f"{n} bis, avenue de {w()}", f"{n}, bd {w()}", f"{n} impasse des {w()}s", f"{n}, rue de {w()}", f"{n} avenue {w()}",
            f"{w()}straße {n}", f"{w()}str. {n}", f"{w()}gasse {n}", f"{w()}weg {n}", f"Am {w()} {n}", f"{w()}allee {n}",
        ))
        return out.upper() if r.random() < 0.12 else out

    #: Carriers where the sample has no context of a kind.
    PLAIN = ("{}", "{}.", "{},", "({})", "- {}")

    def value(self, kind: str) -> str:
        return getattr(self, kind)()

    def line(self, kind: str) -> tuple[str, list[tuple[int, int, str]]]:
        """A line of nothing but a value."""
        head, tail = self.r.choice(self.PLAIN).split("{}")
        value = self.value(kind)
        return head + value + tail, [(len(head), len(head) + len(value), kind)]

    def replaced(self, text: str, spans: list[tuple[int, int, str]], share: float = 0.85) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with most of its spans replaced by invented values; some texts in one case throughout.

        Spans of kind ``open`` stay as they are.
        """
        out, found, at = [], [], 0
        for a, b, kind in sorted(spans):
            old = text[a:b]
            new = self.value(kind) if kind != "open" and self.r.random() < share else old
            if old.isupper() and any(c.isalpha() for c in old):
                new = new.upper()
            out += [text[at:a], new]
            begin = sum(map(len, out[:-1]))
            found.append((begin, begin + len(new), kind))
            at = b
        whole = "".join([*out, text[at:]])
        draw = self.r.random()
        turned = whole.upper() if draw < 0.07 else whole.lower() if draw < 0.14 else whole
        return (turned if len(turned) == len(whole) else whole), found
