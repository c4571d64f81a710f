"""Garbled text from wrong character encodings.

Work is done on distinct tokens with counts, so a phrase that a third of all messages share is
looked at once.

1. Words that share what is left without non-ASCII characters ("Pr..fung") are near-twins: a rare
   one is joined with a much more frequent one, the non-ASCII runs are aligned, and each aligned
   pair votes for the encodings that turn the one into the other. A vote needs two distinct words.
2. Words that consist of non-ASCII characters only leave nothing to join on. They are re-read under
   each pair of encodings, and the reading is joined with the words that occur; such hits vote too. Single letters prove nothing and are not re-read.
3. Learned mappings are applied to all tokens: a token is damaged if a voted pair turns a word of
   it into a much more frequent word, or into one that is much likelier by its letter pairs (which
   distinct words teach, so counts of deliveries don't matter), if a whole run reads strictly as UTF-8 (or as Japanese
   double bytes), or if it holds replacement signs or C1 controls, which no clean text has.
4. Damage shown on purpose is enclosed: a run with its quotation marks does not read strictly, and
   a run directly between ASCII quotation marks is left alone.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import Scratch

#: Encodings considered, by Python's names. SINGLE read one byte a character, DOUBLE are Japanese.
SINGLE = ("cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "cp852", "iso8859_15")
DOUBLE = ("cp932", "euc_jp")
#: Double-byte encodings that twins may vote for, too.
FAMILIES = ("gb18030", "big5", "euc_kr")
#: UTF-8 read under one of these is recognised without a twin.
STRICT = ("cp1252", "cp1250", "iso8859_2", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "iso8859_15")
#: A twin occurs at least so often, and so many times as often as the garbled word; a pair of encodings needs so many distinct words.
TWIN_COUNT, TWIN_RATIO, VOTES = 3, 3, 2

#: The name of a mapping that no pair of encodings explains; such a one counts where most twins of the garbled run agree on it.
OWN, AGREED = "own", 2 / 3

#: A reading without a much more frequent twin is so much likelier by letter pairs, a character and as a whole; most of its pairs stand in so many distinct words.
GAIN, GAIN_ALL, PAIR_WORDS = 1.0, 6.0, 2
#: A word of ordinary shape ("Çelik") is re-read without such a twin only if it has so many characters beyond ASCII.
CHANGED = 3

_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\u0080-\U0010ffff]*")
_SHOWN = re.compile(r"[\"'`<(\[{]([^\x00-\x7f]+)[\"'`>)\]}]")
_KANA = re.compile(r"[\u3041-\u30ff]")


def _byte_tables() -> tuple[dict, dict]:
    """For each single-byte encoding its characters' bytes and back; undefined bytes stand for themselves."""
    out, back = {}, {}
    for name in SINGLE:
        chars = []
        for b in range(128, 256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        back[name] = {b + 128: c for b, c in enumerate(chars)}
        out[name] = {c: b + 128 for b, c in enumerate(chars)} | {chr(b): b for b in range(128, 160) if chr(b) not in chars}
    return out, back


BYTES, CHARS = _byte_tables()


def to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that read as ``text`` under an encoding; None if there are none."""
    if encoding in BYTES:
        table = BYTES[encoding]
        got = [ord(c) if c < "\x80" else table.get(c, -1) for c in text]
        return None if -1 in got else bytes(got)
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        return None


def read(data: bytes | None, encoding: str) -> str | None:
    """What bytes read as under an encoding, strictly; None if they don't."""
    if data is None:
        return None
    if encoding in CHARS:
        return "".join(chr(b) if b < 128 else CHARS[encoding][b] for b in data)
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


#: First and last code points of the scripts and symbols that texts are made of: Latin to Cyrillic and Armenian;
#: Hebrew, Arabic and its supplement; Devanagari to Malayalam; Thai; Georgian; Latin extensions to symbols and arrows; kana;
#: Han; Hangul; forms of width and variation selectors; emoji.
SCRIPTS = ((0xA0, 0x58F), (0x590, 0x6FF), (0x750, 0x77F), (0x900, 0xD7F), (0xE00, 0xE7F), (0x10A0, 0x10FF), (0x1E00, 0x27FF), (0x2B00, 0x2BFF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xFE00, 0xFE0F), (0xFF00, 0xFFEF), (0x1F000, 0x1FAFF))


def plausible(text: str) -> bool:
    """Whether all characters are of kinds that texts are made of: assigned, no controls, of scripts in wide use."""
    for c in text:
        if c < "\x80" or c in "\xad\u200d\u200c\u200e\u200f":
            continue
        o = ord(c)
        if unicodedata.category(c)[0] == "C" or not any(first <= o <= last for first, last in SCRIPTS):
            return False
    return True


def _short_right_to_left(text: str) -> bool:
    """Whether a reading is one letter of a script whose letters are two bytes in UTF-8, as two Cyrillic or accented letters give by chance."""
    return len(text) == 1 and 0x590 <= ord(text) < 0x780


def strictly(run: str) -> tuple[str, str] | None:
    """(restored, pair) if a whole run of non-ASCII characters reads as UTF-8, once or twice."""
    for wrong in STRICT:
        got = read(to_bytes(run, wrong), "utf-8")
        if got and len(got) < len(run) and plausible(got) and not _short_right_to_left(got):
            again = strictly(got) if _RUN.fullmatch(got) else None
            return (again[0] if again else got), f"utf_8>{wrong}"
    if len(run) >= 2:
        got = read(to_bytes(run, "cp932"), "utf-8")
        if got and plausible(got):
            return got, "utf_8>cp932"
    return None


def double_bytes(token: str) -> tuple[str, str] | None:
    """(restored, pair) if a token reads as Japanese double bytes with at least two kana and nothing else unusual."""
    if _KANA.search(token):
        return None
    for wrong in ("cp1252", "cp1251", "mac_roman", "koi8_r", "iso8859_2", "cp1250", "cp866", "cp437"):
        data = to_bytes(token, wrong)
        if data is None:
            continue
        for right in DOUBLE:
            got = read(data, right)
            if got and len(_KANA.findall(got)) >= 2 and plausible(got) and not any(0xA0 <= ord(c) < 0x3000 for c in got):
                return got, f"{right}>{wrong}"
    return None


def readings(word: str) -> list[tuple[str, str]]:
    """Other readings of a word under pairs of encodings: (reading, pair)."""
    out = {}
    for wrong in SINGLE:
        data = to_bytes(word, wrong)
        if data is None:
            continue
        for right in (*SINGLE, *DOUBLE):
            if right != wrong:
                got = read(data, right)
                if got and got != word and plausible(got):
                    out.setdefault((got, f"{right}>{wrong}"))
    return list(out)


def direct(token: str) -> tuple[str, str | None, str] | None:
    """(token, restored or None, pair) for a token that is damaged beyond doubt."""
    shown = {m.group(1) for m in _SHOWN.finditer(token)}
    if any("\x80" <= c <= "\x9f" for c in token) or "�" in token:
        lost = "�" in token
        if lost and all("�" not in r or r in shown for r in _RUN.findall(token)):
            return None
    else:
        lost = None
    pair, changed = "", False

    def swap(m: re.Match) -> str:
        nonlocal pair, changed
        if m.group() in shown:
            return m.group()
        got = strictly(m.group())
        if got:
            pair, changed = got[1], True
            return got[0]
        return m.group()

    restored = _RUN.sub(swap, token)
    if changed:
        return token, (restored if "�" not in restored else None), pair
    whole = double_bytes(token) or double_bytes(token.strip(".,;:!?()"))
    if whole:
        return token, whole[0], whole[1]
    return (token, None, "lost" if lost else "control") if lost is not None else None


def skeleton(word: str) -> str:
    """A word without its non-ASCII characters."""
    return _RUN.sub("", word)


def aligned(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The non-ASCII runs of two words of the same skeleton, matched by the ASCII characters between them."""
    parts = lambda w: re.findall(r"[^\x00-\x7f]+|[\x00-\x7f]", w)
    a, b, i, j, out = parts(garbled), parts(clean), 0, 0, []
    while i < len(a) and j < len(b):
        x, y = a[i] > "\x7f", b[j] > "\x7f"
        if x and y:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif x != y:
            return []
        else:
            i, j = i + 1, j + 1
    return out if i == len(a) and j == len(b) else []


def pairs_for(garbled: str, clean: str) -> list[str]:
    """The pairs of encodings under which a clean run reads as a garbled one."""
    out = []
    for right in (*SINGLE, "utf-8", *DOUBLE, *FAMILIES):
        data = to_bytes(clean, right)
        if data is None:
            continue
        for wrong in SINGLE:
            if wrong != right and read(data, wrong) == garbled:
                out.append(f"{right.replace('-', '_')}>{wrong}")
        if right != "utf-8" and set(garbled) == {"�"} and len(garbled) == len(clean):
            out.append(f"{right}>lost")
    return out


def tokens_of(messages: DataFrame) -> DataFrame:
    """(oid, token): every token with a non-ASCII character, once per commit."""
    found = F.array_distinct(F.regexp_extract_all("message", F.lit(r"[^\x00-\x20]*[^\x00-\x7F][^\x00-\x20]*"), F.lit(0)))
    return messages.select("oid", F.explode(found).alias("token"))


def _words(counted: DataFrame) -> DataFrame:
    """(token, word): words with non-ASCII characters of distinct tokens."""
    return counted.select("token", "n", F.explode(F.array_distinct(F.regexp_extract_all("token", F.lit(r"[A-Za-z]*[^\x00-\x7F][A-Za-z\u0080-￿]*"), F.lit(0)))).alias("word"))


class Learned:
    """The damaged tokens and the mappings they were found by."""

    def __init__(self, commits: DataFrame):
        self.scratch = Scratch(commits.sparkSession, "mojibake")
        messages = commits.where(F.col("oid").isNotNull() & F.col("message").rlike(r"[^\x00-\x7F]")).select("oid", "message").distinct()
        counted = self.scratch.save(tokens_of(messages).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
        words = self.scratch.save(_words(counted))
        vocabulary = self.scratch.save(words.groupBy("word").agg(F.sum("n").alias("n")))
        self.direct = self.scratch.save(counted.select("token").mapInPandas(_direct_rows, "token string, restored string, pair string"))
        shown = F.col("v.n") >= F.greatest(F.lit(TWIN_COUNT), TWIN_RATIO * F.col("w.n"))
        clean = vocabulary.join(words.join(self.direct, "token", "left_semi").select("word").distinct(), "word", "left_anti")
        clean = self.scratch.save(clean)
        # near-twins by skeleton, aligned
        boned = clean.withColumn("bone", _skeleton("word")).where(F.length("bone") >= 3)
        every = vocabulary.withColumn("bone", _skeleton("word")).where(F.length("bone") >= 3)
        twins = every.alias("w").join(boned.alias("v"), F.col("w.bone") == F.col("v.bone")).where(shown & (F.col("w.word") != F.col("v.word"))).select(F.col("w.word").alias("word"), F.col("v.word").alias("twin"), F.col("v.n").alias("n"))
        self.twins = self.scratch.save(twins.mapInPandas(_votes, "word string, twin string, n bigint, garbled string, clean string, pair string"))
        # words re-read under each pair; what letter pairs say is learned from the words not found garbled by counts
        again = self.scratch.save(vocabulary.where(F.length("word") >= 2).mapInPandas(_readings, "word string, n bigint, reading string, pair string"))
        met = again.alias("w").join(clean.alias("v"), F.col("w.reading") == F.col("v.word")).where(F.col("v.n") >= TWIN_COUNT).select("w.word", "w.reading", "w.pair", F.col("w.n").alias("own"), F.col("v.n").alias("n"))
        met = self.scratch.save(met)
        shown = F.col("n") >= TWIN_RATIO * F.col("own")
        letters = letter_pairs(clean.join(met.where(shown).select("word").distinct(), "word", "left_anti"))
        model = commits.sparkSession.sparkContext.broadcast(letters)

        def gains(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield pdf.assign(gain=[gain(w, r, model.value) for w, r in zip(pdf["word"], pdf["reading"])])

        # twins that are frequent but not much more frequent count if letter pairs tell which is the garbled one
        close = met.where(~shown).mapInPandas(gains, "word string, reading string, pair string, own bigint, n bigint, gain double").where("gain > 0")
        self.hits = self.scratch.save(met.where(shown).unionByName(close.drop("gain")).select("word", "reading", "pair", "n"))
        voted = self.twins.where(~F.col("pair").endswith(">lost") & (F.col("pair") != OWN)).select("pair", "word").unionByName(self.hits.select("pair", "word")).groupBy("pair").agg(F.count_distinct("word").alias("votes"))
        self.voted = self.scratch.save(voted.where(F.col("votes") >= VOTES))
        sure = self.scratch.save(self.hits.join(F.broadcast(self.voted), "pair").groupBy("word").agg(F.max_by("reading", F.struct("votes", "n", "reading")).alias("reading"), F.max_by("pair", F.struct("votes", "n", "reading")).alias("pair")))
        # the remaining words have no frequent twin: each voted pair is applied, and letter pairs decide
        rest = again.join(sure.select("word"), "word", "left_anti").join(F.broadcast(self.voted), "pair").select("word", "n", "reading", "pair", "votes")
        rest = rest.mapInPandas(gains, "word string, n bigint, reading string, pair string, votes bigint, gain double").where("gain > 0")
        self.guessed = self.scratch.save(rest.groupBy("word").agg(F.max_by("reading", F.struct("gain", "votes", "reading")).alias("reading"), F.max_by("pair", F.struct("gain", "votes", "reading")).alias("pair")))
        # what is left, if not shaped as words are: each run is replaced as aligned twins showed, whatever encodings explain it
        self.mapped = self.scratch.save(self._mapped(vocabulary.join(sure.select("word").unionByName(self.guessed.select("word")), "word", "left_anti").join(clean.where(F.col("n") >= TWIN_COUNT).select("word"), "word", "left_anti"), model))
        # replacement signs: the one frequent word with the same skeleton and as many lost characters
        back = self.twins.where(F.col("pair").endswith(">lost")).groupBy("word").agg(F.count_distinct("twin").alias("k"), F.max_by("twin", F.struct("n", "twin")).alias("reading")).where("k = 1")
        step = lambda d, name: d.select("word", "reading", "pair", F.lit(name).alias("step"))
        known = step(sure, "twin").unionByName(step(self.guessed, "mapping")).unionByName(step(self.mapped, "mapping"))
        known = step(back.withColumn("pair", F.lit("lost")), "twin").unionByName(known.join(back, "word", "left_anti"))
        swaps = self.scratch.save(words.join(known, "word").groupBy("token").agg(F.array_sort(F.collect_set(F.struct((-F.length("word")).alias("l"), "word", "reading"))).alias("swaps"), F.min_by("pair", "word").alias("learned"), F.min("step").alias("step")))
        swapped = self.direct.join(swaps, "token", "full").where("pair IS NOT NULL OR learned <> 'lost'")
        text = F.aggregate(F.coalesce("swaps", F.array().cast("array<struct<l:int,word:string,reading:string>>")), F.coalesce("restored", "token"), lambda m, x: F.replace(m, x["word"], x["reading"]))
        swapped = swapped.select("token", text.alias("restored"), F.coalesce("pair", "learned").alias("pair"), F.coalesce(F.when(F.col("pair").isNotNull(), F.when(F.col("pair").isin("lost", "control"), F.col("pair")).otherwise("strict")), "step").alias("step"))
        self.tokens = self.scratch.save(swapped.select("token", F.when(F.col("restored") != F.col("token"), F.col("restored")).alias("restored"), "pair", "step", (~F.col("restored").rlike(r"[\x{80}-\x{9f}\x{fffd}]") & (F.col("restored") != F.col("token"))).alias("whole")))
        self.messages = messages

    def _mapped(self, words: DataFrame, model) -> DataFrame:
        """(word, reading, pair) of words all of whose runs have a mapping that aligned twins agree on, where letter pairs confirm the reading."""
        shown = self.twins.where(~F.col("pair").endswith(">lost")).groupBy("garbled", "clean").agg(F.count_distinct("word").alias("k"), F.min("pair").alias("pair"))
        every = shown.groupBy("garbled").agg(F.sum("k").alias("all"), F.max(F.struct("k", "clean", "pair")).alias("top"))
        good = every.where((F.col("top.k") >= VOTES) & (F.col("top.k") >= AGREED * F.col("all"))).select(F.col("garbled").alias("run"), F.col("top.clean").alias("clean"), F.col("top.pair").alias("pair"))
        runs = words.select("word", "n", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(r"[^\x00-\x7F]+"), F.lit(0)))).alias("run"))
        full = runs.join(good, "run", "left").groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("run", "clean"))).alias("maps"), F.count(F.when(F.col("clean").isNull(), 1)).alias("open"), F.min("pair").alias("pair")).where("open = 0")

        def apply(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                out = []
                for word, maps, pair in zip(pdf["word"], pdf["maps"], pdf["pair"]):
                    table = {m["run"]: m["clean"] for m in maps}
                    reading = _RUN.sub(lambda m: table[m.group()], word)
                    if odd(word) and plausible(reading) and gain(word, reading, model.value) > 0:
                        out.append((word, reading, pair))
                yield pd.DataFrame(out, columns=["word", "reading", "pair"])

        return full.mapInPandas(apply, "word string, reading string, pair string")


def _pairs(word: str) -> list[str]:
    """The neighbouring characters of a word, its ends included."""
    return [a + b for a, b in zip(f" {word}", f"{word} ")]


def letter_pairs(words: DataFrame) -> dict[str, int]:
    """In how many distinct words each pair of neighbouring characters of an alphabet occurs."""

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"p": [x for w in pdf["word"] for x in set(_pairs(w)) if x[0] < "\u2000" and x[1] < "\u2000"]}, dtype=object)

    return {r[0]: r[1] for r in words.select("word").distinct().mapInPandas(rows, "p string").groupBy("p").agg(F.count(F.lit(1))).collect()}


def odd(word: str) -> bool:
    """Whether a word is not shaped as words are: symbols among its letters, a capital after a small letter, or letters of two alphabets."""
    kinds = {unicodedata.name(c, "?").split()[0] for c in word if c.isalpha() and c not in "ªºµ"}
    return len(kinds) > 1 or any(not c.isalpha() or c in "ªºµ" for c in word) or any(a.islower() and b.isupper() for a, b in zip(word, word[1:]))


def gain(word: str, reading: str, letters: dict[str, int]) -> float:
    """How much likelier a reading is than the word, a letter pair; 0 if not by far, or if over a quarter of the reading's are hardly seen.

    The word's own part in the counts is left out, as it may be all there is of a garbled one.
    """
    there, here = _pairs(reading), _pairs(word)
    if not odd(word) and sum(c > "\x7f" for c in word) < CHANGED:
        return 0.0
    if not any(c.isalpha() and c > "\x7f" for c in reading) or 4 * sum(letters.get(x, 0) < PAIR_WORDS for x in there) > len(there):
        return 0.0
    mean = lambda xs, own: sum(math.log(max(0, letters.get(x, 0) - own) + 0.5) for x in xs) / len(xs)
    got = mean(there, 0) - mean(here, 1)
    return got if got >= GAIN and got * len(here) >= GAIN_ALL else 0.0


def _direct_rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        yield pd.DataFrame([r for r in map(direct, pdf["token"]) if r], columns=["token", "restored", "pair"])


def _readings(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        yield pd.DataFrame([(w, n, r, p) for w, n in zip(pdf["word"], pdf["n"]) for r, p in readings(w)], columns=["word", "n", "reading", "pair"])


def _votes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        yield pd.DataFrame([(w, t, n, g, c, p) for w, t, n in zip(pdf["word"], pdf["twin"], pdf["n"]) for g, c in aligned(w, t) if g != c for p in pairs_for(g, c) or [OWN]], columns=["word", "twin", "n", "garbled", "clean", "pair"])


def _skeleton(c: str):
    return F.regexp_replace(c, r"[^\x00-\x7F]+", "")


def damaged(commits: DataFrame) -> DataFrame:
    """(oid): the distinct commits whose message is damaged, wholly or partly.

    ``commits``: oid, message. Null and ASCII messages are never damaged, null oids are left out,
    repeated rows count once, and a table without damage gives an empty result.
    """
    learned = Learned(commits)
    return tokens_of(learned.messages).join(learned.tokens.select("token"), "token", "left_semi").select("oid").distinct()


def restored(commits: DataFrame) -> DataFrame:
    """(oid, message, restored, complete, steps): damaged messages with their damaged tokens replaced, each where it is a token of its own.

    ``complete``: none remained unknown. ``steps``: which steps found the damage ("strict": a run
    reads strictly as UTF-8 or Japanese double bytes; "twin": a near-twin; "mapping": a learned
    mapping without a twin; "lost", "control": signs that no clean text has).
    """
    learned = Learned(commits)
    each = tokens_of(learned.messages).join(learned.tokens, "token")
    swaps = each.groupBy("oid").agg(F.map_from_entries(F.collect_set(F.struct("token", F.coalesce("restored", "token").alias("to")))).alias("swaps"), F.min("whole").alias("complete"), F.array_sort(F.collect_set("step")).alias("steps"))

    @F.pandas_udf("string")
    def replaced(message: pd.Series, swaps: pd.Series) -> pd.Series:
        return pd.Series([re.sub(r"[^\x00-\x20]+", lambda m, t=dict(t): t.get(m.group(), m.group()), x) for x, t in zip(message, swaps)])

    return learned.messages.join(swaps, "oid").select("oid", "message", replaced("message", "swaps").alias("restored"), "complete", "steps")


def steps(commits: DataFrame) -> DataFrame:
    """(step, commits, tokens): how many distinct commits and tokens each step of the method found damaged."""
    learned = Learned(commits)
    return tokens_of(learned.messages).join(learned.tokens, "token").groupBy("step").agg(F.count_distinct("oid").alias("commits"), F.count_distinct("token").alias("tokens"))


def mappings(commits: DataFrame) -> DataFrame:
    """(garbled, clean, pair, words): the character mappings learned from near-twins, with the distinct words that show them."""
    return Learned(commits).twins.groupBy("garbled", "clean", "pair").agg(F.count_distinct("word").alias("words"))
