"""Variant spellings of names typed by people and organisations.

1. A name is parsed into given name (or initial) and surname, or into an organisation's own name
   and its unit; decorations, titles, middle initials, order, case, accents and abbreviations go.
   Signatures with the same parsed name are one node ("no two share a written name").
2. Blocks. Tokens are sorted by role, not by place, so order doesn't matter; a block key joins the
   phonetic code of one token, or that code less one symbol (so codes one symbol apart still
   meet), with the other token. Blocks hold distinct spellings, never copies.
3. Pairs are compared by Jaro-Winkler, a one-edit bound and a table of nicknames. One of the two
   tokens must agree exactly or by nickname, unless an e-mail address used by nobody else says
   more. Two given names are a typing error only if one stands with far fewer surnames than the other.
4. A name with an initial only joins the one group it fits; where it fits several, the e-mail
   address has to decide, and otherwise it stays alone.
5. Accepted pairs are clustered by connected components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import Scratch
from ..operators.components import components

#: Parameters: least Jaro-Winkler similarity of tokens one edit apart; a misspelt given name stands with fewer surnames than
#: the right one by this factor; an address is somebody's own if this share of the names that use it sound alike in surname.
LEAST_SIMILARITY = 0.85
RARER = 4
OWN_SHARE = 0.5
#: Phonetic codes of fewer symbols tell too little; such tokens are blocked by their letters less one only.
SHORT_CODE = 4
#: Surnames from this length on may be two errors apart if the given name is the same.
LONG = 10

#: Short and familiar forms, each with the names it stands for.
NICKNAMES = {
    k: frozenset(v.split())
    for k, v in {
        "abby": "abigail", "gail": "abigail", "alex": "alexander aleksandra alexandra alexis", "sasha": "alexander aleksandra alexandra", "sandy": "alexander alexandra", "ola": "aleksandra oluwaseun", "seun": "oluwaseun",
        "xander": "alexander", "andy": "andrew andreas andre", "drew": "andrew", "tony": "anthony antonio", "anni": "anneli", "ann": "anneli anna", "becca": "rebecca", "becky": "rebecca", "ben": "benjamin", "benny": "benjamin", "benji": "benjamin",
        "bill": "william", "billy": "william", "will": "william", "liam": "william", "willy": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bert": "robert albert", "charlie": "charles", "chuck": "charles", "chas": "charles",
        "chris": "christopher christian christine", "kit": "christopher katherine", "topher": "christopher", "dan": "daniel", "danny": "daniel", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "dick": "richard", "rick": "richard", "ricky": "richard", "rich": "richard", "richie": "richard",
        "dora": "dorothea theodora", "thea": "dorothea", "dot": "dorothea dorothy", "dolly": "dorothea dorothy", "dima": "dmitri", "mitya": "dmitri", "ed": "edward edwin", "eddie": "edward", "ned": "edward", "ted": "edward theodore", "teddy": "edward theodore", "theo": "theodore", "ellie": "eleanor", "nell": "eleanor", "nellie": "eleanor", "nora": "eleanor",
        "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "betsy": "elizabeth", "libby": "elizabeth", "fin": "fintan", "frank": "francisco francis franz", "paco": "francisco", "pancho": "francisco", "fran": "francisco frances", "cisco": "francisco", "fred": "frederick", "freddy": "frederick", "freddie": "frederick", "fritz": "frederick friedrich",
        "gabi": "gabriela", "gaby": "gabriela", "gabby": "gabriela", "gianni": "giovanni", "vanni": "giovanni", "gio": "giovanni", "greg": "gregory", "hans": "johannes", "jo": "johannes josephine joseph joanna", "jan": "johannes", "johan": "johannes", "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer", "jon": "jonathan", "jonny": "jonathan", "johnny": "jonathan john", "josie": "josephine", "josy": "josephine",
        "kate": "katherine", "katie": "katherine", "kathy": "katherine", "kat": "katherine", "kay": "katherine", "lotte": "charlotte", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "madge": "margaret", "marge": "margaret", "matt": "matthew", "matty": "matthew", "mat": "matthew",
        "mike": "michael mikhail", "mick": "michael", "mikey": "michael", "misha": "mikhail", "moni": "monica", "nick": "nicholas", "nico": "nicholas", "nicky": "nicholas", "klaus": "nicholas", "pat": "patricia patrick", "trish": "patricia", "patty": "patricia", "tricia": "patricia", "pippa": "philippa", "pip": "philippa", "phil": "philippa philip", "ros": "rosalind", "roz": "rosalind", "rosie": "rosalind", "rosa": "rosalind",
        "sam": "samuel samantha", "sammy": "samuel", "sue": "susanna susan", "suzy": "susanna", "susie": "susanna", "suzie": "susanna", "tom": "thomas tomasz", "tommy": "thomas", "tomek": "tomasz", "ulli": "ulrike", "uli": "ulrike", "rike": "ulrike", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vic": "victoria", "vik": "vikram", "zuza": "zuzana", "zuzka": "zuzana", "jack": "john", "jim": "james", "joe": "joseph", "larry": "laurence lawrence", "steve": "stephen steven",
    }.items()
}

#: Words of organisations' units and their short forms.
UNITS = {
    k: w
    for w, short in {
        "team": "team tm teams", "department": "department dept dep", "institute": "institute inst institut", "research": "research res rsch", "systems": "systems sys system syst", "gmbh": "gmbh", "translation": "translation transl trans l10n", "committee": "committee cttee comm cmte ctte", "documentation": "documentation docs doc", "group": "group grp gp",
        "security": "security sec", "response": "response resp", "infrastructure": "infrastructure infra", "build": "build bld", "bot": "bot robot", "release": "release rel", "software": "software sw", "foundation": "foundation fdn found fndn", "laboratory": "laboratory lab labs", "company": "company co", "corporation": "corporation corp", "incorporated": "incorporated inc", "limited": "limited ltd",
        "engineering": "engineering eng engr", "operations": "operations ops", "services": "services svc svcs service", "quality": "quality qa", "university": "university univ uni", "project": "project proj", "office": "office ofc", "center": "center centre ctr", "development": "development dev devel", "support": "support supp", "testing": "testing test",
    }.items()
    for k in short.split()
}

#: Particles that belong to the following surname, titles, and letters that no decomposition folds.
PARTICLES = frozenset("van von de der den del della di da dos du la le al el bin ibn ter ten zu zur af av".split())
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame jr sr ii iii iv phd md msc bsc ing dipl mag hon rev".split())
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d", "’": "'", "ħ": "h", "ŋ": "n"})


def fold(text: str) -> str:
    """Lower case without accents."""
    low = unicodedata.normalize("NFKD", text.casefold().translate(LETTERS))
    return "".join(c for c in low if not unicodedata.combining(c)).translate(LETTERS)


def plain(token: str) -> str:
    """A folded token with two-letter spellings of umlauts reduced as accents are."""
    return re.sub(r"([aou])e", r"\1", token)


def near(a: str, b: str) -> bool:
    """At most one letter inserted, dropped, replaced, or one neighbouring pair swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def edits(a: str, b: str) -> int:
    """Letters inserted, dropped, replaced and neighbouring pairs swapped between two tokens."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
    return row[-1]


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """The Jaro-Winkler similarity of two strings, in 0..1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    m, t = len(hits), sum(x != y for x, y in zip(hits, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * scale * (1 - jaro)


def similar(a: str, b: str) -> bool:
    """One typing error apart, on plain or reduced spelling, and similar enough."""
    x, y = plain(a), plain(b)
    return x == y or (min(len(a), len(b)) >= 3 and (near(a, b) or near(x, y)) and jaro_winkler(x, y) >= LEAST_SIMILARITY)


def alike(a: str, b: str) -> bool:
    """Up to two typing errors apart: enough where an address says the same."""
    return similar(a, b) or (min(len(a), len(b)) >= 6 and jaro_winkler(a, b) >= LEAST_SIMILARITY and edits(a, b) <= 2)


_SOUNDS = str.maketrans({"b": "P", "p": "P", "f": "F", "v": "F", "w": "F", "c": "K", "k": "K", "q": "K", "g": "K", "x": "K", "d": "T", "t": "T", "s": "S", "z": "S", "j": "J", "l": "L", "m": "M", "n": "M", "r": "R", "a": "", "e": "", "i": "", "o": "", "u": "", "y": "", "h": ""})


def sound(token: str) -> str:
    """A phonetic code: consonant classes, runs collapsed, vowels and h dropped but for a leading vowel."""
    t = token.replace("sch", "s").replace("sh", "s").replace("ch", "k").replace("ph", "f").replace("th", "t").replace("ck", "k")
    code = re.sub(r"(.)\1+", r"\1", t.translate(_SOUNDS))
    return ("A" if t[:1] in "aeiouy" and t else "") + re.sub(r"[^A-Z]", "", code)


def codes_of(token: str) -> set[str]:
    """The phonetic code of a token, and the code less each one symbol."""
    c = sound(token)
    return {c} | {re.sub(r"(.)\1+", r"\1", c[:i] + c[i + 1 :]) for i in range(len(c))}


def blocks(token: str) -> set[str]:
    """The codes of a token, but for short ones of a short token, and itself less each one letter.

    One letter may change a code by several symbols ("ph"), so tokens one letter apart are sure to
    meet by letters only; codes find those two letters apart. No block holds all short names.
    """
    out = {f"={x}" for t in {token, plain(token)} for x in (t, *(t[:i] + t[i + 1 :] for i in range(len(t))))}
    return out | codes_of(token) if len(sound(token)) >= SHORT_CODE or len(token) >= LONG else out


#: For each name the first letters of its short forms.
_SHORT_LETTERS: dict[str, set[str]] = {}
for _nick, _names in NICKNAMES.items():
    for _name in _names:
        _SHORT_LETTERS.setdefault(_name, set()).add(_nick[0])


def letters_of(given: str) -> set[str]:
    """The initials someone of this given name may write: its own, its formal names' and its short forms'."""
    return {x for n in formal(given) for x in {n[0]} | _SHORT_LETTERS.get(n, set())}


def formal(given: str) -> frozenset[str]:
    """The names a given name may stand for."""
    return NICKNAMES.get(given, frozenset()) | {given}


_DECOR = re.compile(r"\[[^\]]*\]|<[^>]*>|\bvia\s+\S.*$|\s[|/@#].*$")
_PAREN = re.compile(r"\(([^)]*)\)")


def _unit(token: str) -> str | None:
    if token in UNITS:
        return UNITS[token]
    if len(token) >= 5:
        for u in set(UNITS.values()):
            if len(u) >= 4 and near(token, u) and token[0] == u[0]:
                return u
    return None


def parse(name: str | None) -> tuple[str, str, str] | None:
    """(kind, given or unit, surname or own name); kind is "p" or "o". None where nothing is left of a name."""
    if not name or not name.strip():
        return None
    raw = _DECOR.sub(" ", name)
    words = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", fold(raw))
    units = [u for u in map(_unit, words) if u]
    if units and len(words) > len(units) and (len(units) > 1 or units[0] in ("gmbh", "bot", "team", "department", "institute", "foundation", "committee", "group", "incorporated", "limited", "corporation", "university")):
        own = [w for w in words if not _unit(w) and w not in ("the", "of", "and", "for", "via")]
        if own:
            return "o", " ".join(sorted(set(units))), "".join(sorted(own))
    raw = _PAREN.sub(" ", raw)
    parts = [p for p in raw.split(",")]
    shout = lambda t: len(re.sub(r"[\W\d_]", "", t)) > 1 and t.upper() == t and t.lower() != t
    tokens = []  # (folded, whether all capitals)
    for side, part in enumerate(parts):
        part = re.sub(r"^\s*([^\W\d_]+)[-]([^\W\d_]+(?:-[^\W\d_]+)?)\s*$", r"\1 \2", part) if len(parts) == 1 and part == part.lower() else part
        for t in re.split(r"[\s._]+", part):
            f = re.sub(r"[\W\d_]", "", fold(t))
            if f and f not in TITLES:
                tokens.append((f, shout(t), side))
    merged: list[tuple[str, bool, int]] = []
    held = ""
    for f, s, side in tokens:
        if f in PARTICLES:
            held += f
            continue
        merged.append((held + f, s, side))
        held = ""
    if held:
        merged.append((held, False, 0))
    if not merged:
        return None
    if len(merged) == 1:
        t = merged[0][0]
        return ("p", t[0], t[1:]) if len(t) > 4 else ("p", "", t)
    sides = {side for _, _, side in merged}
    if len(sides) > 1:  # surname, given
        first = [t for t, _, side in merged if side == min(sides)]
        rest = [t for t, _, side in merged if side != min(sides)]
        return "p", (next((t for t in rest if len(t) > 1), rest[0])), "".join(first)
    if merged[0][1] and not all(s or len(t) == 1 for t, s, _ in merged) or (merged[0][1] and len(merged[0][0]) > 1 and all(len(t) == 1 for t, _, _ in merged[1:])):
        rest = [t for t, _, _ in merged[1:]]
        return "p", (next((t for t in rest if len(t) > 1), rest[0])), merged[0][0]
    surname = merged[-1][0]
    if len(surname) == 1 and len(merged[0][0]) > 1:  # Surname I.
        return "p", surname, merged[0][0]
    given = [t for t, _, _ in merged[:-1]]
    long = [t for t in given if len(t) > 1]
    if len(given[0]) == 1 and len(given) > 1 and long:
        return "p", long[0], surname
    extra = "".join(t for t in given[1:] if len(t) > 1)
    return "p", given[0], extra + surname


def parse_mail(mail: str | None) -> tuple[str | None, list[str]]:
    """(address without tag and case, words of its local part); nothing for what is no address."""
    if not mail or "@" not in mail:
        return None, []
    local, _, host = mail.strip().lower().rpartition("@")
    local = local.split("+")[0]
    return f"{local}@{host}", [w for w in re.split(r"[._]", fold(local)) if w]


def nodes_of(signatures: DataFrame) -> DataFrame:
    """(sig_id, kind, g, s, mail, hint): the parsed name of each signature; null names are left out."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for i, name, mail in zip(pdf["sig_id"], pdf["name"], pdf["email"]):
                got = parse(name)
                if got:
                    kind, g, s = got
                    address, words = parse_mail(mail)
                    hint = next((w for w in words if len(w) > 2 and w[0] == g[:1] and not similar(w, s) and not w.endswith(s)), "") if len(words) > 1 and len(g) == 1 else ""
                    rows.append((i, kind, g, s, address, hint))
            yield pd.DataFrame(rows, columns=["sig_id", "kind", "g", "s", "mail", "hint"])

    return signatures.select("sig_id", "name", "email").mapInPandas(run, "sig_id bigint, kind string, g string, s string, mail string, hint string")


def same_given(a: str, b: str, fa: int, fb: int) -> str:
    """"same", "typo" or "" for two full given names seen with fa and fb surnames."""
    if plain(a) == plain(b) or formal(a) & formal(b):
        return "same"
    if max(len(a), len(b)) >= 4 and similar(a, b) and (min(fa, fb) * RARER <= max(fa, fb) or max(fa, fb) < RARER):
        return "typo"
    return ""


def accepted(ka: str, ga: str, sa: str, fa: int, kb: str, gb: str, sb: str, fb: int, mail: bool) -> bool:
    """Whether two parsed names stand for the same; ``mail``: both used an address that nobody else uses."""
    if ka != kb:
        return False
    if ka == "o":
        return ga == gb and similar(sa, sb) and min(len(sa), len(sb)) >= 4
    if len(ga) < 2 or len(gb) < 2:
        return mail and (ga[:1] == gb[:1]) and alike(sa, sb)
    given = same_given(ga, gb, fa, fb)
    if given == "same":
        return plain(sa) == plain(sb) or (min(len(sa), len(sb)) >= 4 and (similar(sa, sb) or ((mail or min(len(sa), len(sb)) >= LONG) and alike(sa, sb))))
    return given == "typo" and (plain(sa) == plain(sb) or (mail and alike(sa, sb)))


def _keys(kind: str, g: str, s: str, mails: list[str]) -> set[str]:
    if kind == "o":
        return {f"o|{b}|{g}" for b in blocks(s)}
    out = {f"m|{b}|{m}" for m in mails for b in codes_of(s)}
    if len(g) > 1:
        out |= {f"s|{plain(s)}|{b}" for b in blocks(g)}
        out |= {f"s|{plain(s)}|={n}" for n in formal(g)}
        out |= {f"g|{b}|{n}" for n in formal(g) for b in blocks(s)}
    return out


def clusters(signatures: DataFrame) -> tuple[DataFrame, Scratch]:
    """(sig_id, entity) of every signature with a name."""
    scratch = Scratch(signatures.sparkSession, "names")
    sigs = scratch.save(nodes_of(signatures))
    named = sigs.groupBy("kind", "g", "s").agg(F.array_sort(F.collect_set("mail")).alias("all_mails"), F.array_sort(F.collect_set(F.when(F.col("hint") != "", F.col("hint")))).alias("hints"))
    freq = named.where("kind = 'p'").groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    bare = scratch.save(named.join(freq, "g", "left").withColumn("f", F.coalesce("f", F.lit(0))).withColumn("id", F.monotonically_increasing_id()))
    # addresses whose names mostly sound alike in surname, per node

    @F.pandas_udf("string")
    def codes(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sound(x) or x)

    owned = bare.select("id", F.explode("all_mails").alias("mail"), codes("s").alias("code"))
    few = owned.groupBy("mail", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("mail").agg(F.max("n").alias("most"), F.sum("n").alias("all")).where(F.col("most") >= OWN_SHARE * F.col("all")).select("mail")
    own = owned.join(few, "mail", "left_semi").select("id", "mail").distinct()
    # an address spelled given.surname speaks for the name it spells
    found = lambda pattern, k: F.regexp_extract("mail", pattern, k)
    shapes = [(r"^([a-z]{3,})[._]([a-z]{4,})@", 1, 2), (r"^([a-z]{5,})[._]([a-z])@", 2, 1), (r"^([a-z])([a-z]{5,})[0-9]*@", 1, 2)]
    spelled = [own.select("id", F.concat_ws(" ", found(p, x), found(p, y)).alias("mail")).where("mail <> ' '") for p, x, y in shapes]
    full = bare.where("kind = 'p' AND length(g) > 2").select("id", F.explode(F.array(F.concat_ws(" ", "g", "s"), F.concat_ws(" ", F.substring("g", 1, 1), F.col("s")))).alias("mail"))
    for more in (*spelled, full):
        own = own.unionByName(more)
    own = own.distinct()
    mails = own.groupBy("id").agg(F.collect_set("mail").alias("mails"))
    nodes = scratch.save(bare.drop("all_mails").join(mails, "id", "left").withColumn("mails", F.coalesce("mails", F.array().cast("array<string>"))))

    @F.pandas_udf("array<string>")
    def keys(kind: pd.Series, g: pd.Series, s: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([sorted(_keys(*x)) for x in zip(kind, g, s, m)])

    @F.pandas_udf("boolean")
    def match(ka: pd.Series, ga: pd.Series, sa: pd.Series, fa: pd.Series, kb: pd.Series, gb: pd.Series, sb: pd.Series, fb: pd.Series, mail: pd.Series) -> pd.Series:
        return pd.Series([accepted(*x) for x in zip(ka, ga, sa, fa, kb, gb, sb, fb, mail)], dtype=bool)

    keyed = scratch.save(nodes.select("id", F.explode(keys("kind", "g", "s", "mails")).alias("key")))
    met = keyed.alias("x").join(keyed.alias("y"), F.col("x.key") == F.col("y.key")).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    left = nodes.select(F.col("id").alias("a"), F.col("kind").alias("ka"), F.col("g").alias("ga"), F.col("s").alias("sa"), F.col("f").alias("fa"), F.col("mails").alias("ma"))
    right = nodes.select(F.col("id").alias("b"), F.col("kind").alias("kb"), F.col("g").alias("gb"), F.col("s").alias("sb"), F.col("f").alias("fb"), F.col("mails").alias("mb"))
    judged = met.join(left, "a").join(right, "b").withColumn("mail", F.arrays_overlap("ma", "mb"))
    strong = scratch.save(judged.where(match("ka", "ga", "sa", "fa", "kb", "gb", "sb", "fb", "mail")).select("a", "b"))
    groups = scratch.save(_labelled(nodes, strong, scratch))
    # names with an initial only
    weak = _initials(nodes, groups)
    final = scratch.save(_labelled(nodes, strong.unionByName(weak), scratch))
    out = sigs.join(nodes.select("kind", "g", "s", "id"), ["kind", "g", "s"]).join(final, "id").select("sig_id", F.col("entity"))
    out = scratch.save(out)
    scratch.release(sigs, keyed, strong, groups, final, bare, nodes)
    return out, scratch


def _labelled(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    found = components(edges, scratch)
    return nodes.select("id").join(found, nodes["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("entity"))


def _initials(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (a, b) from names with an initial to a full name of the one group each fits."""

    @F.pandas_udf("array<string>")
    def sounds(g: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([sorted({f"{b}|{i}" for b in blocks(y) for i in letters_of(x)}) for x, y in zip(g, s)])

    @F.pandas_udf("int")
    def grade(g: pd.Series, s: pd.Series, hints: pd.Series, full: pd.Series, t: pd.Series, mail: pd.Series) -> pd.Series:
        out = []
        for a, b, h, c, d, m in zip(g, s, hints, full, t, mail):
            told = bool(m or any(formal(x) & formal(c) or similar(x, c) for x in h))
            exact = plain(b) == plain(d)
            if not exact and not (min(len(b), len(d)) >= 5 and (similar(b, d) or (told and alike(b, d)))):
                out.append(0)
            else:
                out.append(1 + 2 * any(a == n[0] for n in formal(c)) + 4 * exact + 8 * told)
        return pd.Series(out, dtype="int32")

    person = nodes.where("kind = 'p' AND g <> ''")
    short = person.where(F.length("g") == 1).select("id", "g", "s", "hints", "mails", F.explode(sounds("g", "s")).alias("key"))
    full = person.where(F.length("g") > 1).join(groups, "id").select(F.col("id").alias("fid"), F.col("g").alias("fg"), F.col("s").alias("fs"), F.col("mails").alias("fm"), "entity", F.explode(sounds("g", "s")).alias("key"))
    pairs = short.join(full, "key").dropDuplicates(["id", "fid"]).withColumn("mail", F.arrays_overlap("mails", "fm"))
    graded = pairs.withColumn("grade", grade("g", "s", "hints", "fg", "fs", "mail")).where("grade > 0")
    per = graded.groupBy("id", "entity").agg(F.max("grade").alias("grade"), F.min_by("fid", F.struct(-F.col("grade"), "fid")).alias("fid"))
    best = per.groupBy("id").agg(F.max("grade").alias("best"))
    top = per.join(best, "id").where("grade = best")
    return top.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("fid").alias("fid")).where("n = 1").select(F.col("id").alias("a"), F.col("fid").alias("b"))


def variants(signatures: DataFrame) -> DataFrame:
    """(sig_a, sig_b), sig_a < sig_b: every pair of signatures of one entity.

    ``signatures``: sig_id, name, email. A null, empty or letterless name (of any script) belongs to nobody and is
    in no pair; a null e-mail says nothing. Repeated sig_ids count once. An empty table gives an
    empty result.
    """
    found, _ = clusters(signatures)
    one = found.groupBy("sig_id").agg(F.min("entity").alias("entity"))
    a, b = one.alias("a"), one.alias("b")
    return a.join(b, F.col("a.entity") == F.col("b.entity")).where("a.sig_id < b.sig_id").select(F.col("a.sig_id").alias("sig_a"), F.col("b.sig_id").alias("sig_b"))


def entities(signatures: DataFrame) -> DataFrame:
    """(sig_id, entity) with entity the smallest sig_id of the group; signatures without a name are their own."""
    found, _ = clusters(signatures)
    low = found.groupBy("entity").agg(F.min("sig_id").alias("low"))
    known = found.join(low, "entity").groupBy("sig_id").agg(F.min("low").alias("low"))
    return signatures.select("sig_id").distinct().join(known, "sig_id", "left").select("sig_id", F.coalesce("low", "sig_id").alias("entity"))
