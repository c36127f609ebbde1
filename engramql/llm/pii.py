"""Personal information in free text, found by a semi-Markov conditional random field.

Candidate segments of bounded length come from broad patterns and from runs of
capitalised or known words; each has whole-span features (shape of the digits,
case, how many of its words the name table has and how the others are spelled,
street words, what stands before and after it).  Transition features tie a
segment to the one before it where they lie close.  The weights are trained by
likelihood over segmentations (``pii_training``); dynamic programming over the
candidates then chooses boundaries and types of all mentions of a text
together, so overlapping readings compete.  Text outside segments scores 0.

The name table is incomplete: words that it lacks take part by their case, by
the likeness of their spelling to the table's words, and by their context.

Kinds: EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME.  ``found`` is a mention's
letters and digits in order, lower-cased.

Defined results: null and empty texts have no mentions and stay as they are; a
text of any length is read whole; repeated mentions give equal rows, which
``mentions`` returns once.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.json")
#: A name table above this is no lexicon that a task should hold.
MAX_NAME_PARTS = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]{2,})?")
_GAP = r"[ \t\u00a0]+"
_DOTTED = r"[a-z0-9-]+(?:(?:\.|[ \t]*[\[({][ \t]*(?:dot|\.)[ \t]*[\])}][ \t]*|[ \t]+dot[ \t]+)[a-z0-9-]*[a-z0-9])+"
_MAIL = (
    re.compile(rf"(?<![\w.+%-])(?=([\w.+%-]*\w(?:@|[ \t]*[\[({{][ \t]*(?:at|@)[ \t]*[\])}}][ \t]*){_DOTTED}))", re.IGNORECASE),
    re.compile(rf"(?<![\w.+%-])(?=([\w.+%-]*\w[ \t]+at[ \t]+{_DOTTED}))", re.IGNORECASE),
)
#: What a text must have for each of them to be tried.
_AT_BRACKET, _AT_WORD = re.compile(r"at[ \t]*[\])}]"), re.compile(r"[ \t]at[ \t]")
_DIGITS = re.compile(r"(?<![\w.+@/-])(?:\+|\()?\d(?:(?:[ .\-/\u00a0]|\)[ -]?|[ ]?\()?\d){5,20}(?!\w)")
_DATE = re.compile(r"\d{4}[-./]\d\d[-./]\d\d|\d{6,7}|\d{13,}")
_ID = re.compile(r"(?<![\w.+@/-])(?:\d{3}[- ]\d\d[- ]\d{4}|[A-Za-z]{1,2}\d{6,9}|\d{8}[- ]?[A-Za-z]|[A-Za-z][- ]?\d{7}[- ]?[A-Za-z]|\d{6}[-+]\d{4}|\d\d ?\d{3} ?\d{3} ?\d{3}|\d{9,12})(?![\w])")
_EN = "street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|way|boulevard|blvd|place|pl|square|sq|terrace|close|crescent|parkway|pkwy|row|gardens|grove"
_DE = "straße|strasse|str|weg|gasse|allee|platz|ring|damm|ufer|steig|chaussee"
_FR = "rue|avenue|boulevard|impasse|chemin|place|quai|allée|route|cours|passage|square|sentier"
_ES = "calle|avenida|avda|paseo|plaza|camino|carrera|ronda|travesía|callejón|glorieta"
_UNIT = rf"(?:,?{_GAP}(?:apt|unit|suite|ste|flat|apartment|room|no|nr|piso|puerta|appt|whg)\b\.?{_GAP}?#?\w{{1,4}}\b|,?{_GAP}#[ ]?\w{{1,4}}\b)?"
_ADDRESS = (
    ("en", re.compile(rf"(?<![\w.,/-])\d{{1,5}}[a-z]?,?{_GAP}(?:[nsew]{{1,2}}\.?{_GAP})?(?:[^\W\d_][\w'’-]*{_GAP}){{1,3}}?(?:{_EN})\b\.?{_UNIT}", re.IGNORECASE)),
    ("de", re.compile(rf"(?<![\w-])[^\W\d_]+(?:-[^\W\d_]+){{0,3}}?-?(?:{_DE})\b\.?{_GAP}\d{{1,4}}(?:[ ]?[a-h]\b)?{_UNIT}(?!\w)", re.IGNORECASE)),
    ("de2", re.compile(rf"(?<![\w-])(?:[^\W\d_]+{_GAP}){{1,2}}?(?:{_DE})\b\.?{_GAP}\d{{1,4}}(?:[ ]?[a-h]\b)?{_UNIT}(?!\w)", re.IGNORECASE)),
    ("deam", re.compile(rf"(?<![\w-])(?:am|im|zum|zur|an{_GAP}de[rn]|auf{_GAP}de[rm]|in{_GAP}de[rn]|unter{_GAP}den){_GAP}[^\W\d_]{{3,}}{_GAP}\d{{1,4}}(?:[ ]?[a-h]\b)?{_UNIT}(?!\w)", re.IGNORECASE)),
    ("fr", re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?:[ ]?(?:bis|ter|quater)\b)?,?{_GAP}(?:{_FR})(?:{_GAP}(?:de{_GAP}la|du|des|de|d['’]|de{_GAP}l['’]))?{_GAP}?[^\W\d_]{{3,}}(?:-[^\W\d_]+)*", re.IGNORECASE)),
    ("es", re.compile(rf"(?<![\w-])(?:{_ES})\b\.?(?:{_GAP}(?:del|de{_GAP}las?|de{_GAP}los|de))?{_GAP}[^\W\d_]{{3,}}(?:{_GAP}[^\W\d_]{{3,}})?,?{_GAP}(?:n[º°.]{_GAP}?)?\d{{1,4}}(?:[ ]?[a-h]\b|[ ]bis\b)?{_UNIT}(?!\w)", re.IGNORECASE)),
)
_STREET_WORDS = {*_EN.split("|"), *_DE.split("|"), *_FR.split("|"), *_ES.split("|"), "am", "im", "zum", "zur", "der", "den", "dem"}
_STREET_ENDS = tuple(_DE.split("|"))
_BETWEEN = re.compile(r"[ \t\u00a0]+|,[ \t\u00a0]*|-|\.[ \t\u00a0]+|\.")
_CUE_WORD = re.compile(r"[^\W\d_]+|[^\w\s]|\d+")

_INNER_CAPITAL = re.compile(r"(?:Mc|Mac|O|De|Di|Le|La|Van)[A-Z][^\W\d_]+")
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "herr", "herrn", "frau", "mme", "mlle", "monsieur", "madame", "m", "sr", "sra", "señor", "señora", "don", "doña", "docteur", "doctor"}
_WITH_PEOPLE = set(
    "with by from to for ask contact call and or cc met tell told via invite see thanks hi hello dear mit von bei an und für durch avec de par à et pour chez con por para y e a según signed owner author reviewer attendee regards sincerely".split()
)
_WITH_PLACES = set("in at on near via using use uses into onto within under inside im am auf aus beim dans sur sous en sobre hacia".split())
_DETERMINERS = set("the a an this that these those our your their its his her my each every no any some all der die das den dem des ein eine einen einem einer le la les l un une des ce cette el los las una unos".split())
#: What people do: verbs that often follow a name.
_OF_PEOPLE = set(
    "will would can could should is was has had and or said says wrote writes called calls joined joins agreed asked asks left moved lives works knows wants likes thinks starts started sent sends presented reviewed approved signed met hat ist war wird und a est sera et es fue y llama".split()
)
#: Function words and greetings of four languages: never a part of a name, whatever their case.
_NO_NAME = set(
    "the this that these those there here then when where what which who why how if is are was were be been has have had do does did not no yes and or but so as at by for from in into of on to with we you they he she it its our your their his her my i me us them all any each every some many few one two three first last next new old please thanks hello hi dear ask call mail ping send see note set run since only after before about over under "
    "der die das den dem des ein eine einen einem einer und oder aber nicht kein keine ist sind war waren wird werden hat haben mit von bei für auf aus nach zu zum zur im am an als wie wenn dass ich du er sie es wir ihr man bitte danke hallo seit nur auch noch schon "
    "le la les un une des du de au aux et ou mais ne pas est sont était avec pour par sur dans ce cette ces il elle nous vous ils je tu on merci bonjour depuis "
    "el los las una unos unas y o pero no es son fue con para por en del al este esta estos se yo tú él ella nosotros ustedes hay desde gracias hola que qué como cuando".split()
)

_GENERIC_TLD = {"com", "org", "net", "edu", "gov", "io", "info", "biz", "example", "test", "de", "fr", "es", "uk", "us", "eu", "ch", "at", "it", "nl"}
_ID_CUES = re.compile(
    r"(ssn|social(?: security)?(?: no| number)?(?: is)?|passport(?: no| number)?|reisepass(?:nr|nummer)?|pasaporte|passeport|steuer-?id|tax(?: ?id| number| no)?|tin|nif|nie|dni|national id|personal number|personnummer|id no|id number|ausweis(?:nr|nummer)?)[.:#\s]*(?:is|no|number|nr)?[.:\s]*$",
    re.IGNORECASE,
)
_PHONE_CUES = re.compile(r"(call|tel|phone|mobile|mobil|cell|desk|dial-in|dial|fax|ring|number|anrufen|unter|numéro|téléphone|handy|text|reach (?:me|us) at|or|call me at)[.:\s]*$", re.IGNORECASE)


class Likeness:
    """How much a word is spelled like the words of the name table: the share of its letter triples that names have.

    Triples of two names or more count, with the edges of the word as letters,
    so the measure follows whatever table is given and knows no word by heart.
    """

    def __init__(self, known: set[str]):
        n = Counter(t for w in known for t in set(self.triples(w)))
        self.seen = frozenset(t for t, k in n.items() if k >= 2)
        self.of = lru_cache(maxsize=1 << 16)(self._of)

    @staticmethod
    def triples(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def _of(self, word: str) -> int:
        """0 (unlike) to 4 (every triple is known)."""
        t = self.triples(word)
        share = sum(x in self.seen for x in t) / len(t) if t and len(word) >= 3 else 0.0
        return 4 if share == 1 else 3 if share >= 0.8 else 2 if share >= 0.6 else 1 if share >= 0.35 else 0


class Lexicon:
    """Words of the name table, 'G' given or 'F' family (lower-cased keys), and the likeness of others to them."""

    def __init__(self, words: dict[str, str]):
        self.words = words
        self.likeness = Likeness(set(words))

    @staticmethod
    def from_parts(given: set[str], family: set[str]) -> Lexicon:
        return Lexicon({**dict.fromkeys(given, "G"), **dict.fromkeys(family, "F")})


@dataclass
class Segment:
    start: int
    end: int
    kind: str
    features: list[str]


def _before(text: str, start: int) -> list[str]:
    return [x.lower() for x in _CUE_WORD.findall(text[max(0, start - 28) : start])[-3:]]


def _after(text: str, end: int) -> list[str]:
    return [x.lower() for x in _CUE_WORD.findall(text[end : end + 24])[:2]]


def _context(text: str, s: int, e: int, kind: str) -> list[str]:
    b, a = _before(text, s), _after(text, e)
    out = [f"{kind}|b1={b[-1] if b else '^'}", f"{kind}|a1={a[0] if a else '$'}"]
    if len(b) > 1:
        out.append(f"{kind}|b2={b[-2]}")
    edge = (text[s - 1 : s] or " ")[-1]
    if edge.isalnum() or edge in "@/\\_=":
        out.append(f"{kind}|stuck_left={'@/=_'[('@/=_').find(edge)] if edge in '@/=_' else 'w'}")
    nxt = text[e : e + 1] or " "
    if nxt.isalnum() or nxt in "@/\\_=":
        out.append(f"{kind}|stuck_right")
    return out


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]", "x", re.sub(r"\d+", lambda m: str(len(m.group())), s.replace(" ", " ")))


def _mail_segments(text: str) -> Iterator[Segment]:
    low_text = text.lower()
    hints = "@" in low_text or _AT_BRACKET.search(low_text), _AT_WORD.search(low_text)
    found = [m for p, hint in zip(_MAIL, hints) if hint for m in p.finditer(text)]
    for m in found:
        s, e = m.span(1)
        body = m.group(1)
        low = body.lower()
        sign = "@" if "@" in low else "bracket" if re.search(r"[\[({]\s*at", low) else "word"
        dots = "bracket" if re.search(r"[\[({]\s*dot", low) else "word" if re.search(r"\sdot\s", low) else "plain"
        last = re.split(r"[^a-z0-9]+", low)[-1]
        tld = "known" if last in _GENERIC_TLD else "alpha" if last.isalpha() and 2 <= len(last) <= 6 else "odd"
        local = re.split(r"@|\s|[\[({]", body)[0]
        yield Segment(s, e, "EMAIL", ["EMAIL", f"EMAIL|{sign}-{dots}-{tld}", f"EMAIL|sign={sign}", f"EMAIL|tld={tld}", f"EMAIL|local={'joined' if re.search(r'[._+0-9]', local) else 'word'}", *_context(text, s, e, "EMAIL")])


def _digit_segments(text: str) -> Iterator[Segment]:
    for m in _DIGITS.finditer(text):
        run = m.group()
        if _DATE.fullmatch(run):
            continue
        groups = [g.span() for g in re.finditer(r"\d+", run)]
        for i in range(len(groups)):
            total = 0
            for j in range(i, min(len(groups), i + 9)):
                total += groups[j][1] - groups[j][0]
                if total > 15:
                    break
                if total < 7:
                    continue
                a, b = groups[i][0], groups[j][1]
                lead = run[:a][-1:] if i else run[: groups[0][0]]
                if lead in ("+", "("):
                    a -= 1
                s, e = m.start() + a, m.start() + b
                body = text[s:e]
                if body[0] == "(" and ")" not in body:  # the bracket is around the number
                    s, body = s + 1, body[1:]
                if body.count("(") != body.count(")"):
                    continue
                digits = re.sub(r"\D", "", body)
                start = "+" if body[0] == "+" else "(" if body[0] == "(" else "00" if digits[:2] == "00" else "0" if digits[0] == "0" else "d"
                whole = (i == 0) and (j == len(groups) - 1)
                cue = bool(_PHONE_CUES.search(text[max(0, s - 24) : s]))
                shape = _shape(body)
                yield Segment(s, e, "PHONE", ["PHONE", f"PHONE|start={start}", f"PHONE|n={len(digits)}", f"PHONE|whole={whole}", f"PHONE|cue={cue}", f"PHONE|shape={shape}", f"PHONE|start={start}&whole={whole}&cue={cue}", *_context(text, s, e, "PHONE")])


def _id_segments(text: str) -> Iterator[Segment]:
    for m in _ID.finditer(text):
        if _DATE.fullmatch(m.group()):
            continue
        s, e = m.span()
        cue = bool(_ID_CUES.search(text[max(0, s - 40) : s]))
        shape = _shape(m.group())
        yield Segment(s, e, "ID_NUMBER", ["ID_NUMBER", f"ID_NUMBER|cue={cue}", f"ID_NUMBER|shape={shape}", f"ID_NUMBER|cue={cue}&shape={shape}", *_context(text, s, e, "ID_NUMBER")])


def _address_segments(text: str) -> Iterator[Segment]:
    seen = set()
    for form, pattern in _ADDRESS:
        at = 0
        while m := pattern.search(text, at):
            at = m.start() + 1
            s, e = m.span()
            body = m.group()
            if body.endswith(".") and not re.search(r"(?:^|\s)(?:st|rd|ave|ln|dr|ct|blvd|pl|sq|str)\.$", body, re.IGNORECASE):
                e -= 1
            # after a street word at the end of a sentence the stop is not a letter or digit anyway
            if (s, e, form) in seen:
                continue
            seen.add((s, e, form))
            words = _WORD.findall(body)
            if form == "de2" and words[0].islower() and words[0] in _NO_NAME and words[1][0].isupper():
                continue  # a small preposition before the street's own name
            named = [w for w in words if len(w) > 2]
            case = "title" if all(w[0].isupper() for w in named[:1]) else "lower"
            caps = sum(w[0].isupper() for w in named)
            yield Segment(s, e, "ADDRESS", ["ADDRESS", f"ADDRESS|form={form}", f"ADDRESS|form={form}&case={case}", f"ADDRESS|words={min(len(words), 6)}", f"ADDRESS|form={form}&first={'function' if words[0].lower() in _NO_NAME else 'other'}", f"ADDRESS|form={form}&caps={min(caps, 3)}of{min(len(named), 4)}", *_context(text, s, e, "ADDRESS")])


def _word_class(word: str, lexicon: Lexicon) -> str:
    """G, F: in the table; I: an initial; C: other word in title or upper case; c: lower case, spelled like a name; -: no part of a name."""
    low = word.lower()
    if known := lexicon.words.get(low):
        return known
    if len(word) == 1:
        return "I" if word.isupper() else "-"
    if low in _NO_NAME:
        return "-"
    if word[0].isupper() and (word[1:].islower() or word.isupper() or _INNER_CAPITAL.fullmatch(word)):
        return "C"
    return "c" if word.islower() and lexicon.likeness.of(low) >= 3 else "-"


def _name_segments(text: str, words: list[re.Match], lexicon: Lexicon) -> Iterator[Segment]:
    """Two to four words (hyphenated parts count) of the classes above, an initial never last but after a comma.

    Runs without any word of the table or like one are candidates too where
    they are capitalised; what stands around them decides.
    """
    kinds = [_word_class(w.group(), lexicon) for w in words]
    gaps = []
    for a, b in zip(words, words[1:]):
        between = text[a.end() : b.start()]
        gaps.append({",": ",", "-": "-", ".": "."}.get(between[:1], " ") if len(between) <= 3 and _BETWEEN.fullmatch(between) else None)
    for i, first in enumerate(kinds):
        if first in "-I" or (i and gaps[i - 1] == "-"):
            continue
        pattern = first
        for j in range(i + 1, min(i + 5, len(kinds))):
            gap = gaps[j - 1]
            if gap is None or kinds[j] == "-" or (gap == "." and kinds[j - 1] != "I"):
                break
            pattern += {" ": "", ".": "."}.get(gap, gap) + kinds[j]
            if kinds[j] == "I" and "," not in pattern:
                continue
            if j < len(gaps) and gaps[j] == "-" and kinds[j + 1] != "-":
                continue
            if "c" in pattern and not ("G" in pattern or "F" in pattern):
                continue
            if sum(x in "GFCc" for x in pattern.replace("-", "")) < 2 or pattern.count(",") > 1:
                continue
            s, e = words[i].start(), words[j].end()
            body = [w.group() for w in words[i : j + 1] if len(w.group()) > 1]
            case = "U" if all(x.isupper() for x in body) else "T" if all(x[0].isupper() for x in body) else "l" if all(x.islower() for x in body) else "m"
            unknown = [w.group().lower() for w, k in zip(words[i : j + 1], kinds[i : j + 1]) if k in "Cc"]
            like = min((lexicon.likeness.of(w) for w in unknown), default=5)
            known = sum(x in "GF" for x in pattern)
            order = pattern.replace("c", "C")
            left = i > 0 and gaps[i - 1] == " " and kinds[i - 1] in "GFC"
            right = j < len(gaps) and gaps[j] == " " and kinds[j + 1] in "GFC"
            before, after = _before(text, s), _after(text, e)
            lead = _lead(before, text[:s])
            follow = "$" if not after else "poss" if after[:2] in (["'", "s"], ["’", "s"]) else after[0] if not after[0][0].isalnum() else "verb" if after[0] in _OF_PEOPLE else "word"
            f = [f"order={order}", f"case={case}", f"order={order}&case={case}", f"known={known}&like={like}", f"known={known}&like={like}&case={case}", f"lead={lead}", f"known={known}&lead={lead}", f"follow={follow}", f"known={known}&lead={lead}&follow={follow}"]
            f += [f"end={w[-3:]}" for w in unknown if len(w) > 3]
            if case == "U" and _loud(text, s, e):
                if not known and like < 3:  # among capitals, case tells nothing
                    continue
                f += ["loud", f"loud&known={known}&like={like}"]
            if left or right:
                f += [f"run={'l' * left}{'r' * right}", f"run={'l' * left}{'r' * right}&known={known}"]
            yield Segment(s, e, "NAME", ["NAME", *(f"NAME|{x}" for x in f), *_context(text, s, e, "NAME")])


def _loud(text: str, s: int, e: int) -> bool:
    """Whether what stands around a segment is written in capitals as well."""
    around = [ch for ch in text[max(0, s - 40) : s] + text[e : e + 40] if ch.isalpha()]
    return len(around) > 8 and sum(ch.isupper() for ch in around) > 0.6 * len(around)


def _lead(before: list[str], head: str) -> str:
    """What kind of word or mark stands before a name."""
    if not before:
        return "start"
    last = before[-1]
    if last in _TITLES or (last == "." and len(before) > 1 and before[-2] in _TITLES):
        return "title"
    if last in _WITH_PEOPLE:
        return "people"
    if last in _DETERMINERS:
        return "det"
    if last in _WITH_PLACES:
        return "place"
    if last == ":":
        return "label"
    if last in ".!?" or head.endswith("\n"):
        return "sentence"
    return "mark" if not last[0].isalnum() else "digit" if last.isdigit() else "word"


def segments(text: str, lexicon: Lexicon) -> list[Segment]:
    """All candidate segments of a text."""
    out: list[Segment] = []
    out += _mail_segments(text)
    out += _digit_segments(text)
    out += _id_segments(text)
    words = list(_WORD.finditer(text))
    low = {w.group().lower() for w in words}
    if not _STREET_WORDS.isdisjoint(low) or any(w.endswith(_STREET_ENDS) for w in low):
        out += _address_segments(text)
    out += _name_segments(text, list(_NAME_WORD.finditer(text)) if "'" in text or "’" in text else words, lexicon)
    return out


#: Characters between two segments within which the first one's type bears on the second.
REACH = 40


def follows(text: str, a: Segment, b: Segment) -> str | None:
    """The transition feature from segment ``a`` to the next segment ``b``; none where they lie far apart."""
    gap = b.start - a.end
    if gap > REACH:
        return None
    between = text[a.end : b.start]
    how = "touch" if gap == 0 else "marks" if not any(c.isalnum() for c in between) else "words"
    return f"{a.kind}>{b.kind}|{how}"


def best_segmentation(candidates: list[Segment], weights: dict[str, float], text: str = "") -> list[Segment]:
    """The segmentation of highest score: disjoint segments, the rest outside.

    A segment scores by its features and by the transition from the segment
    before it, where that lies within ``REACH``.  The program keeps the best
    score for each last segment; what ended farther back counts only by its
    maximum, so a text takes time in proportion to its candidates.
    """
    order = sorted(candidates, key=lambda c: (c.end, -c.start))
    ends = [c.end for c in order]
    total: list[float] = []
    back: list[int | None] = []
    peak: list[int | None] = [None]  # the best last segment among the first k
    for c in order:
        own = sum(weights.get(f, 0.0) for f in c.features)
        near_from, to = bisect_left(ends, c.start - REACH), bisect_right(ends, c.start)
        far = peak[min(near_from, len(total))]
        best, pick = (total[far], far) if far is not None and total[far] > 0 else (0.0, None)
        for j in range(near_from, min(to, len(total))):
            score = total[j] + weights.get(follows(text, order[j], c), 0.0)
            if score > best:
                best, pick = score, j
        total.append(own + best)
        back.append(pick)
        last = peak[-1]
        peak.append(len(total) - 1 if last is None or total[-1] > total[last] else last)
    at = peak[-1]
    if at is None or total[at] <= 0:
        return []
    out = []
    while at is not None:
        out.append(order[at])
        at = back[at]
    return out[::-1]


def letters_and_digits(s: str) -> str:
    return "".join(ch for ch in s.lower() if ch.isalnum())


class Finder:
    def __init__(self, lexicon: Lexicon, weights: dict[str, float] | None = None):
        self.lexicon = lexicon
        if weights is None:
            with open(WEIGHTS, encoding="utf-8") as f:
                weights = json.load(f)
        self.weights = weights

    def find(self, text: str | None) -> list[Segment]:
        if not text:
            return []
        candidates = segments(text, self.lexicon)
        return best_segmentation(candidates, self.weights, text) if candidates else []

    def redact(self, text: str | None) -> str | None:
        """The text with each mention replaced by its kind in brackets."""
        if not text:
            return text
        out, at = [], 0
        for s in self.find(text):
            out += [text[at : s.start], f"[{s.kind}]"]
            at = s.end
        return "".join([*out, text[at:]])


def lexicon_of(name_part: DataFrame) -> Lexicon:
    """The name table on the driver; refused beyond ``MAX_NAME_PARTS`` rows."""
    rows = name_part.select("word", "part_kind").where("word IS NOT NULL").limit(MAX_NAME_PARTS + 1).collect()
    if len(rows) > MAX_NAME_PARTS:
        raise ValueError(f"name_part has more than {MAX_NAME_PARTS} rows")
    kinds = {k: {r.word.strip().lower() for r in rows if r.part_kind == k and r.word.strip()} for k in ("given", "family")}
    return Lexicon.from_parts(kinds["given"], kinds["family"])


def texts(episode: DataFrame, calendar: DataFrame) -> DataFrame:
    """(field, rec_id, text) of both fields, a row for each delivery."""
    e = episode.select(F.lit("episode.content").alias("field"), F.col("id").alias("rec_id"), F.col("content").alias("text"))
    c = calendar.select(F.lit("raw_calendar_event.description_text").alias("field"), F.col("raw_id").cast("string").alias("rec_id"), F.col("description_text").alias("text"))
    return e.unionByName(c)


def mentions(source: DataFrame, name_part: DataFrame) -> DataFrame:
    """(field, rec_id, kind, found): each mention once.

    Only the mentions are shuffled (to make rows distinct), never the texts.
    """
    words = lexicon_of(name_part).words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(Lexicon(words)).find
        for b in batches:
            at, kind, found = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for s in find(text):
                    at.append(i)
                    kind.append(s.kind)
                    found.append(letters_and_digits(text[s.start : s.end]))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("field").take(take), b.column("rec_id").take(take), pa.array(kind, pa.string()), pa.array(found, pa.string())], names=["field", "rec_id", "kind", "found"])

    return source.where("text IS NOT NULL").mapInArrow(run, "field string, rec_id string, kind string, found string").distinct()


def redacted(source: DataFrame, name_part: DataFrame) -> DataFrame:
    """(field, rec_id, text) with typed placeholders; rows delivered again come once."""
    words = lexicon_of(name_part).words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redact = Finder(Lexicon(words)).redact
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("rec_id"), pa.array([redact(t) for t in b.column("text").to_pylist()], pa.string())], names=["field", "rec_id", "text"])

    return source.distinct().mapInArrow(run, "field string, rec_id string, text string")
