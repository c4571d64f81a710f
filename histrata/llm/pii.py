"""Personal information in free text: found, typed and replaced by placeholders.

A semi-Markov conditional random field over candidate spans. Loose patterns propose spans of
bounded length with a type; features look at the whole span (shape, digits, known given names,
street words) and at the words beside it; a dynamic programme over span ends picks the
non-overlapping spans of the highest total score, so boundaries and types are chosen together and
text outside spans scores zero. Weights come from ``pii_train`` (maximum likelihood, forward-
backward over the same lattice, on sentences made up there) and lie in ``pii_weights.json``.

Given names are learned from the corpus itself: words of author and committer names that stand
before more surnames than they follow given names, and that messages mostly write with a capital.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import NICKNAMES, PARTICLES, TITLES, UNITS, fold

KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}
#: Given names are shipped while they are at most so many, else joined with the words of the messages.
LEXICON = 50_000

#: The longest span considered, in characters.
MAX_CHARS = 1_000

#: Words beside personal information, in several languages.
CUES = {
    "phone": "tel tel. telephone telefon telefono teléfono téléphone phone call mobil mobile cell cellphone handy sms fax ring dial callback on-call hotline voicemail whatsapp joignable reachable rufnummer numéro тел телефон text",
    "id": "ssn social security dni nie pesel nip passport reisepass passeport pasaporte personnummer cpf cnp nif inn инн снилс national identity identité identidad id personalausweis ausweis steuer-id steuernummer tax taxpayer license licence documento carte d'identité insurance applicant tessera nino card document",
    "address": "address adresse adres dirección lieferanschrift anschrift moved stands ships ship mail courier visit office site lives located residence form labo used",
    "person": "with by per to from and for an à cc thanks thank danke merci gracias sorry contact requested reported owner customer colleague since paired discussed idea ask gruß regards hi hello dear credit sincerely wrote",
    "mail": "mail e-mail email write ask contact mailto cc bounce reported logs alias via écrire rückfragen owner reply",
    "tech": "sha offset offsets run build version section order ticket issue bug port ports listens row rows line lines item lane slot rack drive case cases step id: pid crc rev revision page pages block size bytes at: depth commit object release bump 0x field layout module patch mode count key",
}
CUE = {w: k for k, ws in CUES.items() for w in ws.split()}
AFTER = frozenset("entries bytes ns ms us kb mb gb hz px rows lines times blobs items cases tests pages commits objects files runs of per percent % is took to was were green hits".split())

#: Words and endings that name streets, and words of units within buildings.
STREET = frozenset("street st st. road rd rd. lane ln avenue ave ave. boulevard blvd blvd. close drive dr way court ct terrace square sq place crescent alley row hill".split())
STREET_FIRST = frozenset("rue avenue boulevard calle via viale ul. ulica rua avenida plaza place chemin paseo allée impasse carrer rúa al. os. piazza corso улица ул.".split())
STREET_END = re.compile(r"(?i)(gasse|straße|strasse|weg|platz|allee|str\.|gatan|vägen|laan|straat|gade|veien)$")
ORGS = frozenset("team group department dept institute inst committee bot gmbh inc ltd llc corp systems foundation company farm channel rota mirror queue project university office service services security docs build release research response infrastructure software documentation translation squad crew".split())
#: Capital letters of the Latin, Greek and Cyrillic alphabets, for use inside a character class.
UP = "A-Z" + "".join(c for c in map(chr, range(0xC0, 0x530)) if c.isupper())
#: Given names that are ordinary words when written small.
WORDY = frozenset("rich will pat kit bill frank mark jack drew sue dot may ray rob mat mike dan ola art bob chuck dick gene grant guy hope jean joy max nick rose sandy skip stew ted tom van victor ward will xander jo al".split())
PARTICLE = r"(?:(?:van|von|de|der|den|del|della|di|da|la|le|al|el|bin|ter|zu)[ -]){0,2}(?:al-|el-|d'|O'|Mc)?"
NAME = rf"{PARTICLE}[{UP}][\w'’]*(?:-[{UP}a-zà-ÿ][\w'’]*)?"
ORDINARY = frozenset("the a an and or not no of in on at to for with from by as is was are were be been has have had do does did it its this that these those he she they we you i our my your their his her us them who which what when where while if then than so but also only after before until since under over again still never always every each both left some any all one two broke found wrote said".split())

EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9À-ÿ][\w.+%-]*(?:@|\s?(?:\(at\)|\[at\]|\{at\}|<at>)\s?|\s(?:at|AT)\s|\s@\s)[A-Za-z0-9-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>)\s?|\sdot\s|\sDOT\s)[A-Za-z0-9-]+){0,5}")
PHONE = re.compile(r"(?<![\w.@#/:\-])(?:\+|\(?0|\(?\d)[\d]*(?:[ ().\-/]{1,2}\d+)*(?:\s?(?:ext\.?|x|App\.)\s?\d{1,5})?(?![\w])")
IDENT = re.compile(r"(?<![\w.@#/:+])(?:[A-Z]{1,3}[ -]?)?\d(?:[\dA-Z]|[-. ](?=[\dA-Z]))*(?:-[A-Z]|[A-Z])?(?![\w])")
CODE = re.compile(r"(?<![\w.@#/:])[A-Z]{1,2}\d[\dA-Z]{5,10}(?![\w])|(?<![\w.])[A-Z]\d{2,3}-\d{3,5}-\d(?!\w)")
STREETS = "|".join(sorted(map(re.escape, STREET), key=len, reverse=True))
FIRSTS = "|".join(sorted(map(re.escape, STREET_FIRST), key=len, reverse=True))
UNIT = r"(?:,? (?:Apt\.?|Apartment|Unit|Suite|Ste\.?|Floor|Fl\.?|Flat|No\.?|#) ?[\w-]+)?"
TOWN = rf"(?:,? ?(?:[A-Z]-)?\d{{2}}-?\d{{3}} [{UP}][\w'’-]+(?:[ -](?:[{UP}][\w'’-]+|sur|am|an|der|la|le|de))*|, [{UP}][\w'’-]+(?:[ -](?:[{UP}][\w'’-]+|sur|am|an|der|la|le|de))*(?: \d{{4,5}})?)?"
ADDRESS = (
    re.compile(rf"(?:Flat \d+\w?,? )?(?<![\w.])\d{{1,5}}(?:[/-]\d+)?[A-Za-z]? (?:[NSEW]\.? )?(?:[\w'’]+ ){{1,3}}(?i:{STREETS})(?!\w){UNIT}{TOWN}"),
    re.compile(rf"(?<!\w)\d{{1,4}}(?: ?(?:bis|ter))?,? (?i:{FIRSTS}) (?:(?:des|de|du|la|le|les|del|d'|l') ?){{0,2}}[{UP}][\w'’-]+(?: [{UP}][\w'’-]+)*{TOWN}"),
    re.compile(rf"(?<!\w)(?i:{FIRSTS}) (?:(?:des|de|du|la|le|les|del|della) )?[{UP}][\w'’-]+(?: [{UP}][\w'’-]+)?,? (?:n[ºo°]? ?)?\d{{1,5}}(?:[/-]\d+)?\w?(?:, ?\d+[ºª°] ?[A-Z]?(?![\w]))?{TOWN}"),
    re.compile(rf"(?<!\w)[{UP}][\w'’-]*(?i:gasse|straße|strasse|weg|platz|allee|gatan|vägen|laan|straat|gade|veien) \d{{1,4}}\w?{TOWN}"),
    re.compile(rf"(?<!\w)(?:[{UP}][\w'’]+ ){{1,2}}(?:Close|Way|Court|Road|Street|Lane|Avenue|Drive|Hill|Row|Terrace|Square|Crescent) \d{{1,4}}\w?(?!\w){TOWN}"),
)
PERSON = (
    re.compile(rf"(?<![\w/.@<])(?:(?:Frau|Herr|Mr\.?|Mrs\.?|Ms\.?|Miss|Mx\.?|Dr\.?|Prof\.?|Mme|M\.|Señora?|Sra?\.?|Pani?|Sig\.?|Monsieur|Madame) )?(?:[{UP}]\. ?){{0,2}}{NAME}(?: (?:[{UP}]\.? )?{NAME}){{0,3}}(?![\w/(@])"),
    re.compile(rf"(?<![\w/.@<]){NAME}, {NAME}(?: [{UP}]\.)?(?![\w/(@])"),
    re.compile(rf"(?<![\w/.@<])[{UP}]\.? {NAME}(?![\w/(@])"),
    re.compile(r"(?<![\w/.@<\ufffd])[a-zà-ž]{2,}(?: [a-z]\.?)? (?:(?:van|de|von|al-|der) ?)?[a-zà-ž][\w'’-]{3,}(?![\w/(@.])"),
    re.compile(r"(?<![\w/.@<\ufffd])[a-zà-ž]{2,}(?: [a-z]\.?)? (?:(?:van|de|von|al-|der) ?)?[a-zà-ž][\w'’-]{3,}(?=\.(?:\s|$))"),
)

_WORDS = re.compile(r"[\w'’.#:%-]*[\w%:]|[^\w\s]")


def _near(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to four words before and three after a span, lower-cased, nearest first."""
    left = _WORDS.findall(text[max(0, start - 60) : start].rpartition("\n")[2].lower())
    right = _WORDS.findall(text[end : end + 40].partition("\n")[0].lower())
    return left[::-1][:4], right[:3]


def _beside(text: str, start: int, end: int) -> list[str]:
    left, right = _near(text, start, end)
    out = []
    for k, w in enumerate(left):
        c = CUE.get(w) or CUE.get(w.rstrip(".:="))
        if c:
            out.append(f"l{'0' if k == 0 else '+'}={c}")
    for k, w in enumerate(right):
        if w in AFTER:
            out.append("r0=count" if k == 0 else "r+=count")
        elif CUE.get(w.strip("().:")) == "id":
            out.append("r=id")
    return out


def _email(text: str, s: int, e: int) -> list[str]:
    span = text[s:e]
    host = re.split(r"@|\(at\)|\[at\]|\{at\}|<at>|\s(?:at|AT)\s", span)[-1].strip()
    parts = [p for p in re.split(r"\.|\(dot\)|\[dot\]|\{dot\}|<dot>|\s(?:dot|DOT)\s", host) if p.strip()]
    out = [f"parts={min(len(parts), 3)}", "alpha_tld" if parts and parts[-1].strip().isalpha() and len(parts[-1].strip()) >= 2 else "odd_tld"]
    if parts and parts[0].strip()[:1].isdigit():
        out.append("number_host")
    if re.match(r":[\w/~.]", text[e : e + 2]):
        out.append("path_after")
    if re.search(r"://[^\s]*$", text[max(0, s - 40) : s]):
        out.append("scheme_before")
    if "@" not in span:
        out.append("spelled" if re.search(r"[(\[{<]at|\sdot\s|\sDOT\s|[(\[{<]dot", span) else "bare_at")
    return out


def _digits(span: str) -> str:
    n = sum(c.isdigit() for c in span)
    return "d<7" if n < 7 else f"d={n}" if n < 14 else "d>13"


def _shape(span: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d+", lambda m: str(min(9, len(m.group()))), span))[:24]


def _phone(text: str, s: int, e: int) -> list[str]:
    span = text[s:e]
    groups = re.findall(r"\d+", span)
    out = [_digits(span), f"g={min(len(groups), 6)}"]
    out.append("plus" if span[0] == "+" else "zero" if span.lstrip("(")[:1] == "0" else "other_start")
    if "(" in span:
        out.append("paren")
    if re.search(r"ext|x|App", span):
        out.append("ext")
    if re.fullmatch(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}", span):
        out.append("3-3-4")
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{6}-\d{4}|\d{4}-\d{4}", span):
        out.append("id_like")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", span):
        out.append("ip")
    if re.fullmatch(r"\d+\.\d+", span) or re.fullmatch(r"\d+", span):
        out.append("plain")
    if re.match(r"[.:]\d", text[e : e + 2]) or re.search(r"[\w][.:]$", text[max(0, s - 2) : s]):
        out.append("cut")
    return out


def _ident(text: str, s: int, e: int) -> list[str]:
    span = text[s:e]
    alnum = re.sub(r"[^0-9A-Z]", "", span)
    out = [_digits(span), "letters" if re.search(r"[A-Z]", span) else "no_letters", "s=" + _shape(span)]
    if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", span):
        out.append("3-2-4")
    if span.isdigit():
        out.append("solid")
    if re.fullmatch(r"[A-Z]{1,2}\d{6,8}|[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}|\d{8}-?[A-Z]", span):
        out.append("coded")
    if not 7 <= len(alnum) <= 14:
        out.append("odd_length")
    if re.match(r"[.:]\d", text[e : e + 2]):
        out.append("cut")
    return out


def _address(text: str, s: int, e: int) -> list[str]:
    span = text[s:e]
    words = re.findall(r"[\w'’.]+", span)
    out = ["town" if re.search(r"\d{4,5}|\d{2}-\d{3}|, [A-Z]", span) else "no_town", "starts_number" if span[:1].isdigit() else "starts_word"]
    if re.search(r"(?i)\b(apt|unit|flat|suite|floor)\b", span):
        out.append("unit")
    if any(w.lower() in STREET_FIRST for w in words):
        out.append("street_first")
    if any(STREET_END.search(w) for w in words):
        out.append("street_end")
    if re.search(r"(?i)\b(?:mon|tues|wednes|thurs|fri|satur|sun)day$", span):
        out.append("weekday_end")
    if re.match(r",? (?:[A-Z]-)?\d{2}-?\d{2,3}\b|, ?\d|, [A-Z]", text[e : e + 12]) or re.match(rf"[ -][{UP}]", text[e : e + 2]):
        out.append("more_after")
    if not any(w.lower() in STREET or w.lower() in STREET_FIRST or STREET_END.search(w) for w in words):
        out.append("no_street")
    if words[-1].lower() in ("apt", "unit", "suite", "rue", "des", "de", "la", "sur", "w", "w.", "port", "ul."):
        out.append("open_end")
    inner = [w for w in words if not w[0].isdigit() and w.lower() not in STREET]
    if inner and all(w[0].islower() for w in inner):
        out.append("lower")
    elif any(w[0].islower() and w not in STREET_FIRST and w not in ("des", "de", "du", "del", "la", "le", "les", "sur", "am", "an", "der", "d'", "l'") for w in inner):
        out.append("mixed")
    if any(w.lower() in ORDINARY for w in inner):
        out.append("ordinary_inside")
    return out


def _person(text: str, s: int, e: int, given: set[str]) -> list[str]:
    span = text[s:e]
    line = text[text.rfind("\n", 0, s) + 1 : s]
    words = re.findall(r"[\w'’-]+\.?", span)
    bare = [fold(w.strip(".")) for w in words]
    out = [f"n={min(len(words), 5)}"]
    title = bare[0] in TITLES or bare[0] in ("frau", "herr", "mme", "senor", "senora", "sra", "pan", "pani", "monsieur", "madame", "mx", "sig", "m") and len(words) > 1 and words[0] != "M"
    if title:
        out.append("title")
    known = [w in given for w in bare]
    caps = [w[:1].isupper() for w in words]
    comma = "," in span
    lower = not any(caps)
    tag = "lower_" if lower else ""
    if comma:
        out.append("comma_given" if any(known[1:]) else "comma")
    elif known[0] and len(words) > 1:
        out.append(tag + "given_first")
    elif any(known):
        out.append(tag + "given_inside")
    else:
        out.append(tag + "no_given")
    if len(words) > 1 and re.fullmatch(rf"[{UP}]\.?", words[0]):
        out.append("initial")
    if any(w in ORGS for w in bare):
        out.append("org")
    if any(w in ORDINARY or w in CUE for w in bare):
        out.append(tag + "ordinary")
    if any(w in STREET for w in bare[1:]):
        out.append("street")
    if re.search(r"(?:^|\s)[A-Z][\w-]*-by: ?$", line):
        out.append("trailer")
    if re.match(r"\s*<[^>\s]+@", text[e : e + 60]):
        out.append("mail_after")
    if len(words) == 1:
        out.append("single")
    if not line.strip() or re.search(r"[.!?:] $", line):
        out.append("opens")
    if re.match(rf"[ ,]+[{UP}]", text[e : e + 3]) or (s > 1 and re.search(rf"[{UP}][\w'’-]* $", text[max(0, s - 30) : s]) and text[s].isupper()):
        out.append("cut_name")
    if re.match(r"\s(?:broke|found|and I|left|wrote|complained|until|asked|said|reported|will|has|hat|a )", text[e : e + 12]):
        out.append("acts")
    if not any(known) and any(len(w) > 2 and w.isupper() for w in words):
        out.append("shout")
    if any(re.search(r"[a-z][A-Z]", w.removeprefix("Mc").removeprefix("Mac")) for w in words):
        out.append("camel")
    if any(w.isdigit() for w in bare):
        out.append("digits")
    return out


def candidates(text: str, given: set[str]) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of every span proposed."""
    out: dict[tuple[int, int, str], list[str]] = {}

    def add(s: int, e: int, kind: str, feats: list[str]) -> None:
        if 0 < e - s <= MAX_CHARS and (s, e, kind) not in out:
            out[s, e, kind] = [f"{kind}:{f}" for f in ("bias", *feats, *_beside(text, s, e))]

    if "@" in text or " at " in text or "at)" in text or "at]" in text or "AT " in text:
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email", _email(text, *m.span()))
    if re.search(r"\d", text):
        for m in PHONE.finditer(text):
            if sum(c.isdigit() for c in m.group()) >= 6:
                add(*m.span(), "phone", _phone(text, *m.span()))
        for pattern in (IDENT, CODE):
            for m in pattern.finditer(text):
                s, e = m.span()
                bare = re.match(r"[A-Z]{1,3}[ -]", m.group())
                for a in {s, s + bare.end() if bare else s}:
                    words = [e, *(a + w.start() for w in re.finditer(" ", text[a:e]))]
                    for z in words:
                        if sum(c.isdigit() for c in text[a:z]) >= 5:
                            add(a, z, "id_number", _ident(text, a, z))
        for pattern in ADDRESS:
            for m in pattern.finditer(text):
                s, e = m.span()
                while text[e - 1] in ".,;":
                    e -= 1
                for z in {e, *(s + c.start() for c in re.finditer(r",|(?<=[\w.]) (?=[^\W\d_])", text[s:e]))}:
                    if re.search(r"\d", text[s:z]) and z - s >= 8 and not re.fullmatch(r"Flat \d+\w?|\d+", text[s:z]):
                        add(s, z, "address", _address(text, s, z))
    for pattern in PERSON[:3]:
        for m in pattern.finditer(text):
            words = [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\S+", m.group())]
            for a in range(len(words)):
                for b in range(a, min(len(words), a + 5)):
                    s, e = words[a][0], words[b][1]
                    while e > s and text[e - 1] in ",;:":
                        e -= 1
                    span = text[s:e]
                    if b == a or (len(words) > 2 and (a, b) != (0, len(words) - 1)):
                        low = [fold(x.strip(".,")) for x in span.split()]
                        if b == a or not (any(x in given for x in low) or re.match(rf"[{UP}]\.? ", span) or low[0] in ("frau", "herr", "ms", "mr", "mrs", "dr", "prof", "mme")):
                            continue
                    add(s, e, "person", _person(text, s, e, given))
    for pattern in PERSON[3:]:
        at = 0
        while m := pattern.search(text, at):
            first = fold(m.group().split()[0])
            if first in given and first not in WORDY and m.group().split()[-1] not in ORDINARY:
                add(*m.span(), "person", _person(text, *m.span(), given))
            at = m.start() + max(1, len(m.group().split()[0]))
    return [(s, e, k, f) for (s, e, k), f in sorted(out.items())]


def best(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The non-overlapping spans of the highest total score (scores above zero only can be part of it)."""
    spans = sorted((x for x in spans if x[3] > 0), key=lambda x: x[1])
    ends = [x[1] for x in spans]
    total, took = [0.0], [None]
    from bisect import bisect_right

    for k, (s, e, _, w) in enumerate(spans):
        j = bisect_right(ends, s, 0, k)
        gain = total[j] + w
        if gain > total[k]:
            total.append(gain)
            took.append(j)
        else:
            total.append(total[k])
            took.append(None)
    out, k = [], len(spans)
    while k:
        if took[k] is None:
            k -= 1
        else:
            out.append(spans[k - 1][:3])
            k = took[k]
    return out[::-1]


def load_weights(path: str | None = None) -> dict[str, float]:
    with open(path or os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.json")) as f:
        return json.load(f)


class Tagger:
    """Finds the spans of personal information in a text."""

    def __init__(self, weights: dict[str, float], given: set[str]):
        self.weights, self.given = weights, given

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        if not text:
            return []
        w = self.weights
        return best([(s, e, k, sum(w.get(f, 0.0) for f in feats)) for s, e, k, feats in candidates(text, self.given)])

    def redact(self, text: str) -> tuple[str, int]:
        """The text with each span replaced by its placeholder and everything else unchanged, and how many there were."""
        out, at, spans = [], 0, self.find(text)
        for s, e, k in spans:
            out += [text[at:s], PLACEHOLDERS[k]]
            at = e
        return "".join(out) + text[at:], len(spans)


def lattice_gradient(spans: list[tuple[int, int, list[str]]], gold: set[int], weights: dict[str, float]) -> tuple[float, list[float]]:
    """Log-likelihood of choosing exactly the ``gold`` spans, and its derivative by each span's score (forward-backward)."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0]))
    score = [sum(weights.get(f, 0.0) for f in spans[i][2]) for i in order]
    starts, ends = [spans[i][0] for i in order], [spans[i][1] for i in order]
    points = sorted({0, *starts, *ends})
    place = {p: k for k, p in enumerate(points)}
    alpha = [float("-inf")] * len(points)
    alpha[0] = 0.0
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for k in range(len(order)):
        by_end.setdefault(place[ends[k]], []).append(k)
        by_start.setdefault(place[starts[k]], []).append(k)

    def add(a: float, b: float) -> float:
        if a < b:
            a, b = b, a
        return a if b == float("-inf") else a + math.log1p(math.exp(b - a))

    for p in range(1, len(points)):
        alpha[p] = alpha[p - 1]
        for k in by_end.get(p, ()):
            alpha[p] = add(alpha[p], alpha[place[starts[k]]] + score[k])
    beta = [0.0] * len(points)
    for p in range(len(points) - 2, -1, -1):
        beta[p] = beta[p + 1]
        for k in by_start.get(p, ()):
            beta[p] = add(beta[p], beta[place[ends[k]]] + score[k])
    z = alpha[-1]
    grad = [0.0] * len(spans)
    for k, i in enumerate(order):
        grad[i] = (i in gold) - math.exp(min(0.0, alpha[place[starts[k]]] + score[k] + beta[place[ends[k]]] - z))
    return sum(score[k] for k, i in enumerate(order) if i in gold) - z, grad


def _evidence(name: str) -> list[tuple[str, str, bool]]:
    """(word, the word it goes with, whether it stands as given name) of a person's name; nothing for organisations, single words and initials."""
    low = fold(name)
    if any(w in ORGS or w in UNITS for w in re.findall(r"[^\W\d_]+", low)):
        return []
    sides = [[t.strip(".") for t in x.split() if t.strip(".") not in TITLES and t not in PARTICLES] for x in low.split(",")[:2]]
    if not all(sides):
        return []
    given, last = (sides[1][0], sides[0][-1]) if len(sides) > 1 else (sides[0][0], sides[0][-1])
    if len(sides) == 1 and len(sides[0]) < 2 or min(len(given), len(last)) < 2:
        return []
    return [(given, last, True), (last, given, False)]


def _evidence_rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        yield pd.DataFrame(sorted({x for n in pdf["n"] for x in _evidence(n) if re.fullmatch(r"[^\W\d_]+", x[0])}), columns=["g", "other", "first"])


def _spelling_rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch, how many messages have a word in small letters, and with a capital."""
    for pdf in it:
        small: Counter = Counter()
        for t in pdf["message"]:
            small.update(set(re.findall(r"[^\W\d_]{2,}", t)))
        folded: dict[str, list[int]] = {}
        for w, n in small.items():
            folded.setdefault(fold(w), [0, 0])[w[0].isupper()] += n
        yield pd.DataFrame([(w, *n) for w, n in folded.items()], columns=["g", "small", "capital"])


def _given(commits: DataFrame) -> DataFrame:
    """(g): folded given names of authors and committers, in any script.

    All evidence is relative, so that more data teaches no other words: a word stands before more
    surnames than it follows given names, before two at least (one person's name is none of two),
    and messages write it with a capital more often than without. Particles, titles, ordinary
    words and words of organisations are no given names.
    """
    names = commits.select(F.explode(F.array("author_name", "committer_name")).alias("n")).where(F.col("n").isNotNull()).distinct()
    seen = names.mapInPandas(_evidence_rows, "g string, other string, first boolean").distinct()
    k = lambda x: F.count(F.when(F.col("first") == F.lit(x), 1))
    able = seen.groupBy("g").agg(k(True).alias("k"), k(False).alias("s")).where("k >= 2 AND k > s").select("g")
    spelt = commits.where(F.col("message").isNotNull()).select("message").mapInPandas(_spelling_rows, "g string, small bigint, capital bigint")
    mostly = spelt.join(able, "g", "left_semi").groupBy("g").agg(F.sum("small").alias("small"), F.sum("capital").alias("capital")).where("small > capital").select("g")
    return able.join(mostly, "g", "left_anti").mapInPandas(_usable_rows, "g string")


def _usable(names: set[str]) -> set[str]:
    return {x for x in names if x not in ORDINARY and x not in ORGS and x not in UNITS and x not in PARTICLES and x not in TITLES}


def _usable_rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        yield pd.DataFrame({"g": sorted(_usable(set(pdf["g"])))}, dtype=object)


def _table() -> set[str]:
    """The names of the nickname table."""
    return _usable(set(NICKNAMES) | {n for v in NICKNAMES.values() for n in v})


def given_names(commits: DataFrame) -> set[str] | None:
    """Learned given names and those of the nickname table; None if more than LEXICON are learned."""
    found = [r[0] for r in _given(commits).limit(LEXICON + 1).collect()]
    return None if len(found) > LEXICON else set(found) | _table()


def asked(text: str | None) -> set[str]:
    """The folded words of a text that may be looked up among the given names."""
    out: set[str] = set()
    for k, pattern in enumerate(PERSON if text else ()):
        at = 0
        while m := pattern.search(text, at):
            parts = m.group().split()
            out.update(fold(x) for w in parts for x in (w.strip(".,"), w.rstrip(",;:").strip(".,"), w))
            out.update(fold(w.strip(".")) for w in re.findall(r"[\w'’-]+\.?", m.group()))
            at = m.end() if k < 3 else m.start() + max(1, len(parts[0]))
    return out


def _asked_rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        yield pd.DataFrame([(o, w) for o, t in zip(pdf["oid"], pdf["message"]) for w in asked(t)], columns=["oid", "w"])


def _with_names(commits: DataFrame) -> tuple[DataFrame, set[str]]:
    """Distinct messages (oid, message, given), and the names to be shipped.

    ``given`` is null while all names are shipped; if there are too many, it holds those learned names that the message has.
    """
    once, names = _once(commits), given_names(commits)
    if names is not None:
        return once.withColumn("given", F.lit(None).cast("array<string>")), names
    learned = _given(commits).withColumnRenamed("g", "w")
    here = once.mapInPandas(_asked_rows, "oid string, w string").distinct().join(learned, "w").groupBy("oid").agg(F.collect_set("w").alias("given"))
    return once.join(here, "oid", "left").select("oid", "message", "given"), _table()


def _taggers(model: tuple[dict, set[str]], given: pd.Series) -> Iterator[Tagger]:
    """A tagger for each message."""
    weights, names = model
    every = Tagger(weights, names)
    for g in given:
        yield every if g is None else Tagger(weights, names.union(g))


def _once(commits: DataFrame) -> DataFrame:
    return commits.where(F.col("oid").isNotNull() & F.col("message").isNotNull()).select("oid", "message").distinct()


def kinds(commits: DataFrame) -> DataFrame:
    """(oid, pii_kind): one row per distinct commit and kind of personal information in its message.

    ``commits``: oid, message, author_name, committer_name. Null oids and messages are left out,
    repeated rows count once, an empty table gives an empty result. Very long messages are read whole.
    """
    texts, names = _with_names(commits)
    model = commits.sparkSession.sparkContext.broadcast((load_weights(), names))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(o, k) for o, t, g in zip(pdf["oid"], pdf["message"], _taggers(model.value, pdf["given"])) for k in {x[2] for x in g.find(t)}]
            yield pd.DataFrame(rows, columns=["oid", "pii_kind"])

    return texts.mapInPandas(run, "oid string, pii_kind string").distinct()


def redacted(commits: DataFrame) -> DataFrame:
    """(oid, redacted, n_spans): every distinct message with personal information replaced by typed placeholders."""
    texts, names = _with_names(commits)
    model = commits.sparkSession.sparkContext.broadcast((load_weights(), names))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(o, *g.redact(t)) for o, t, g in zip(pdf["oid"], pdf["message"], _taggers(model.value, pdf["given"]))]
            yield pd.DataFrame(rows, columns=["oid", "redacted", "n_spans"])

    return texts.mapInPandas(run, "oid string, redacted string, n_spans int")
