"""Training of the personal-information model on sentences made up here: python -m histrata.llm.pii_train.

Every sentence is put together from a frame, a filler and distractors by a seeded generator; the
true spans are known by construction. Weights are fitted by stochastic gradient ascent on the
log-likelihood of the span lattice, with L2 shrinkage. ``sentences`` with another seed gives held-out text.
"""

from __future__ import annotations

import json
import os
import random

from .names import NICKNAMES
from .pii import candidates, lattice_gradient

ONSETS = "b br c ch d dr f fl g gr h j k kr l m n p pr r s sh st t tr v w z".split()
VOWELS = "a e i o u ö á ai".split()
ENDS = "n s r l nd mann berg sen ova ski ez ic ton ley well".split()
GIVEN = sorted({n.title() for v in NICKNAMES.values() for n in v} | {k.title() for k in NICKNAMES} | set("Zoë Søren Łucja Çelik André Noor Priya Kenji Ingrid Tariq Leila Marek Björn Yusuf Amara Ravi Divya Hugo".split()))
STREET_NAMES = "Birchwood Harbour Oldmill Chapel Ashgrove Foundry Kingfisher Larkspur Meadow Hollow Barley Orchard Cobbler's".split()
TOWNS = "Northwick,Elmsford,Altstadt,Saint-Roche,Grünau,Port Ellery,Villa Clara,Bad Weiler".split(",")
THINGS = "Copper,Silver,Granite,Harbor,Falcon,Beacon,Cedar,Marble,Summit,Delta,Anchor,Ember,Main,Old,Lantern,Quarry".split(",")
OBJECTS = "Relay,Anvil,Bridge,Mirror,Gateway,Engine,Cache,Station,Market,Tower,Compass,Street,Road,Node".split(",")
WORDS = "the cache drops its index when two writers race on a stale entry and later reads return old data from the second mirror".split()


def surname(r: random.Random) -> str:
    s = "".join(r.choice(ONSETS) + r.choice(VOWELS) for _ in range(r.randint(1, 3))) + r.choice(ENDS)
    return s.capitalize()


def person(r: random.Random) -> str:
    g, s = r.choice(GIVEN), surname(r)
    if r.random() < 0.12:
        s += "-" + surname(r)
    if r.random() < 0.08:
        s = r.choice(("van ", "de ", "al-", "von ")) + s
    k = r.random()
    if k < 0.5:
        return f"{g} {s}"
    if k < 0.62:
        return f"{s}, {g}"
    if k < 0.74:
        return f"{g[0]}. {s}"
    if k < 0.84:
        return f"{r.choice(('Frau', 'Herr', 'Ms', 'Mr.', 'Dr.', 'Mrs', 'Prof.', 'Mme'))} {s}"
    if k < 0.94:
        return f"{g} {s}".lower()
    return f"{g} {r.choice('ABCDEFGHJKLM')}. {s}"


def email(r: random.Random) -> str:
    g, s = r.choice(GIVEN).lower(), surname(r).lower()
    local = r.choice((f"{g}.{s}", f"{g[0]}{s}", f"{s}{r.randint(1, 99)}", f"{s}.{g[0]}", f"{g}_{s}", f"{s}+lists"))
    host = r.choice(("example.org", "mail.example", "post.sample.test", "dept.uni.invalid", "corp.example.com"))
    k = r.random()
    if k < 0.72:
        return f"{local}@{host}"
    if k < 0.8:
        return f"{local}@{host}".upper()
    dot = r.choice((" (dot) ", " dot ", "."))
    return local + r.choice((" (at) ", " [at] ")) + host.replace(".", dot) if k < 0.93 else f"{local} at {host.replace('.', ' dot ')}"


def phone(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice((f"+{r.randint(1, 98)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{r.randint(2, 9)}{d(2)}-{d(3)}-{d(4)}", f"{r.randint(2, 9)}{d(2)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+49 {d(2)} {d(5)}-{d(3)}", f"+{r.randint(10, 99)} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(4)}/{d(2)}-{d(3)}-{d(3)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)} ext. {d(2)}", f"0{d(3)} {d(5)} {d(3)}", f"{r.randint(2, 9)}{d(9)}", f"0{d(4)}-{d(3)} {d(3)}", f"+1{d(3)}{d(3)} {d(4)}", f"+{d(3)} {d(2)} {d(3)} {d(2)} {d(2)}", f"0{d(2)} {d(5)} {d(3)}"))


def ident(r: random.Random) -> tuple[str, str, str]:
    """(words before, number, words after)."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    a = r.choice("ABCDEFGHKLMNPRSTXYZ")
    return r.choice((
        ("SSN ", f"{d(3)}-{d(2)}-{d(4)}", ""), ("her social security number is ", f"{d(3)} {d(2)} {d(4)}", ""), ("SSN=", d(9), ""), ("SSN: ", f"{d(3)}-{d(2)}-{d(4)}", ""),
        ("DNI ", d(8) + a, ""), ("documento de identidad ", f"{d(8)}-{a}", ""), ("NIE ", f"X{d(7)}{a}", ""), ("PESEL ", d(11), ""), ("ИНН ", d(12), ""),
        ("passport no. ", a + d(7), ""), ("Reisepass ", f"C{d(2)}X{d(2)}T{d(2)}", ""), ("passport ", a + d(8), ""), ("Personalausweis ", f"L{d(2)}X{d(2)}T{d(2)}", ""), ("personnummer ", f"{d(6)}-{d(4)}", ""),
        ("national id ", f"{a}{d(3)}-{d(4)}-{d(1)}", ""), ("applicant ", f"{a}{a}{d(6)}", " (ID card)"), ("tax number ", f"{d(2)}.{d(3)}.{d(3)}-{d(1)}", ""), ("carte d'identité ", d(11), ""), ("CPF ", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", ""), ("Steuer-ID ", d(11), ""), ("identity card ", f"{a}{a}{d(7)}", ""),
    ))


def address(r: random.Random) -> str:
    s, n, t = r.choice(STREET_NAMES), r.randint(1, 299), r.choice(TOWNS)
    z = f"{r.randint(10000, 99999)}"
    one = s.split("'")[0]
    return r.choice((f"{n} {s} Lane, {t}", f"{n} {s} Blvd., {t} {z}", f"{n} W. {s} St Apt {r.randint(1, 30)}B", f"Flat {r.randint(1, 9)}, {n} {s} Road", f"{n}/{r.randint(1, 9)} {s} Street, Unit {n}", f"{one}gasse {n}, {z} {t}", f"{one}straße {n}, {z} {t}", f"{n} rue des {one}s, {z} {t}", f"ul. {one} {n}/{r.randint(1, 20)}, {z[:2]}-{z[2:]} {t}", f"Calle {one} {n}, {r.randint(1, 9)}º{r.choice('ABC')}", f"{n} {s.lower()} avenue", f"{s} Close {n}", f"{n} Old {s} Street", f"{n} {s} Road, {t}", f"via {one} {n}, {z} {t}"))


FRAMES = {
    "person": ("Many thanks to {} for testing this", "{} reported the failure", "Paired with {}.", "Written together with {} last night", "cc {}", "Credit goes to {}", "{} found this while debugging", "Danke an {} für den Test.", "Merci à {} pour la correction.", "{} and I rewrote the parser.", "as agreed with {}, keep it", "was owned by {} until March", "requested by {}", "per {}: keep as is", "sorry {}", "customer {} called again", "Idea by {}", "{} broke this", "broken since {} left the company"),
    "email": ("Contact: {}", "write to {} first", "bounce from {} again", "ask {} for details", "Logs went to {}.", "<{}>", "old alias {} is gone", "{} never answered", "cc {}", "(thanks, {})", "Fragen an {}", "reported via <mailto:{}> today"),
    "phone": ("Tel. {}", "call {} if it stalls", "Reachable at {} until noon.", "SMS to {} confirmed it", "On-call: {}", "Mobil {}", "fax {}", "ring {} first", "joignable au {}", "the customer left {} as callback", "{} (voicemail only)", "number in the dump was {}", "phone {}"),
    "address": ("Server moved to {}.", "ships to {}", "the lab stands at {}.", "mail the form to {}", "Lieferanschrift: {}", "the courier went to {} instead", "registered office: {}", "site visit, {}, Monday", "- {} has no uplink", "adresse du bureau : {}", "the fixture used {} by mistake"),
}


def clean(r: random.Random) -> str:
    """A sentence without personal information that looks a little like it."""
    d = lambda n: "".join(r.choice("123456789") for _ in range(n))
    t, o, u = r.choice(THINGS), r.choice(OBJECTS), r.choice(THINGS)
    return r.choice((
        f"{t} {o} and {u} {r.choice(OBJECTS)} both pass.", f"Thanks to the {r.choice(('build farm', 'docs team', 'release bot', 'QA crew'))} for this", f"{t} Street tile set has {d(2)} blobs.", f"{t} Road map, item {d(2)}", f"Lane {d(2)} of the vector unit was idle.", f"Drive {d(2)} reported bad sectors.",
        f"Bump {t.lower()}@{d(1)}.{d(2)}.{d(1)} to {d(1)}.{d(2)}.", f"clone with git@host.example:{t.lower()}/core.git first.", f"ssh://git@mirror.example:22/{o.lower()}.git works", f"order {d(3)}-{d(2)}-{d(4)} of the queue", f"Ticket {d(4)}-{d(4)} stays open.", f"{d(2)}-{d(3)} entries per page", f"Run {d(7)}.{d(1)} took {d(7)} ns.", f"sha {d(11)} was packed twice", f"listens on 10.0.{d(2)}.{d(2)}:{d(4)}", f"Offsets {d(5)} to {d(5)} were free.", f"Version id 0x{d(2)}ff{d(4)} is reserved.", f"Build {d(1)}.{d(2)}.{d(2)}-rc{d(1)} is green.", f"See section {d(1)}.{d(2)} of the notes.",
        f"Tel. column dropped from sample {d(2)}", f"SSN column was in the dump", f"passport no. field renamed in row {d(2)}", f"passport module: {d(2)} tests skipped", f"tax number check has {d(2)} cases", f"the phone layout needs {d(2)} px", f"Call Flush{d(2)}() if it stalls.", f"Contact: the release channel", f"On-call: see the rota, slot {d(2)}", f"address space of {d(2)} pages", f"Paired with nobody.", f"{t} {o} wrote {d(2)} notes.", f"per {t} {o}: do not squash", f"the mail hook ran @{d(2)} Hz", f"server moved to rack {d(2)}.", f"DNI appears {d(2)} times", "Danke an alle für den Test.", "Idea by the docs team", f"moved {d(4)} bytes at depth {d(2)} until Friday", f"Zürich node {d(3)} €",
        f"{r.choice('ABCEÉÀZ')} {r.choice(WORDS).upper()} {r.choice(WORDS).upper()} {r.choice(WORDS).upper()}", f"{r.choice('ABCDEF')}. {r.choice(('Tree', 'Byte', 'Mask'))}{r.choice(('Walk', 'Time', 'Base'))}", f"{r.choice('ABCDEF')} {r.choice(('Tree', 'Byte', 'Mask'))}{r.choice(('Walk', 'Time', 'Base'))} is stale",
        f"{r.choice(('Use', 'Keep', 'Drop', 'Split'))} {t.lower()} {o.lower()} in {r.choice(('Tree', 'Index', 'Pack'))}{r.choice(('Walk', 'Node', 'Size'))}()", f"Merge branch '{t.lower()}-{o.lower()}' into main", f"Size of the {o.lower()} table grew to {d(4)} entries", f"{r.choice(('Reading', 'Setting', 'Moving'))} the {t.lower()} {o.lower()} saves {d(4)} KB", f"Größe der Tabelle auf {d(4)} Einträge erhöht", f"Each {o.lower()} carries {d(3)} bytes", f"{d(3)} of {d(4)} runs ended with a stale {o.lower()}", f"took {d(4)} ms per {o.lower()}",
    ))


def sentences(seed: int, n: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their true spans (start, end, kind)."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []

        def say(before: str, filler: str, kind: str, after: str) -> None:
            nonlocal text
            text += before
            spans.append((len(text), len(text) + len(filler), kind))
            text += filler + after

        for k in range(r.randint(1, 4)):
            if text:
                text += r.choice((" ", "\n", "\n\n", " "))
            kind = r.choice(("clean", "clean", "person", "email", "phone", "id_number", "address", "words", "trailer", "org"))
            if kind == "clean":
                text += clean(r)
            elif kind == "words":
                text += " ".join(r.sample(WORDS, 8)).capitalize() + "."
            elif kind == "id_number":
                before, number, after = ident(r)
                text += r.choice(("", "Remove ", "found ", "- ", "the sample has "))
                say(before, number, kind, after + r.choice((" in the dump", " was leaked", " still sits in the seed file", "", " aparece en el registro", " im Testordner", ".")))
            elif kind == "org":
                text += f"Reviewed-by: {surname(r)} {r.choice(('Release Team', 'Build Bot', 'Systems GmbH', 'Research Institute', 'Docs Grp', 'Software Foundation', 'Infrastructure Department'))} <"
                say("", f"{r.choice(WORDS)}@lists.example.org", "email", ">")
            elif kind == "trailer":
                g = f"{r.choice(GIVEN)} {surname(r)}"
                say(r.choice(("Reviewed-by: ", "Signed-off-by: ", "Tested-by: ", "Acked-by: ", "Co-authored-by: ")), g, "person", " <")
                say("", f"{g.split()[1].lower()}@mail.example.org", "email", ">")
            else:
                before, after = r.choice(FRAMES[kind]).split("{}")
                make = {"person": person, "email": email, "phone": phone, "address": address}[kind]
                say(before, make(r), kind, after)
        out.append((text, spans))
    return out


def lexicon(seed: int) -> set[str]:
    """The given names known while training: most, not all, so that unknown ones are learned from what is beside them."""
    from .names import fold

    r = random.Random(seed)
    return {fold(g) for g in GIVEN if r.random() < 0.97}


def fit(data: list, given: set[str], epochs: int = 6, rate: float = 0.2, shrink: float = 1e-4, seed: int = 1) -> dict[str, float]:
    """Weights that make the true spans likely. A sentence with a span that no pattern proposes is left out."""
    r, weights, ready = random.Random(seed), {}, []
    for text, spans in data:
        found = candidates(text, given)
        true = {s for s in spans}
        gold = {i for i, (s, e, k, _) in enumerate(found) if (s, e, k) in true}
        if len(gold) == len(true):
            ready.append(([(s, e, f) for s, e, _, f in found], gold))
    for epoch in range(epochs):
        r.shuffle(ready)
        step = rate / (1 + epoch)
        for spans, gold in ready:
            if spans:
                for (_, _, feats), g in zip(spans, lattice_gradient(spans, gold, weights)[1]):
                    if abs(g) > 1e-4:
                        for f in feats:
                            weights[f] = weights.get(f, 0.0) * (1 - shrink) + step * g
    return {f: round(w, 4) for f, w in sorted(weights.items()) if abs(w) > 0.02}


def main() -> None:
    weights = fit(sentences(11, 6000), lexicon(3))
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.json"), "w") as f:
        json.dump(weights, f, indent=0, ensure_ascii=False, sort_keys=True)


if __name__ == "__main__":
    main()
