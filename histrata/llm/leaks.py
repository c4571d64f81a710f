"""Evaluation texts leaking into training text.

1. A suite's standing instruction - a first paragraph shared by items of the suite - is cut off.
2. Item and document words are canonicalised: layout, markup, case and punctuation go, numbers,
   identifiers and units become typed placeholders. A second form also has a placeholder for names of
   persons, places and products: capitalised words that the items never write small.
3. Windows of five canonical words are hash-joined: items are the query side, taken in blocks of
   bounded size whose window table is shipped to the executors, and every document probes it in
   one pass. No pair of documents is formed and nothing is shuffled. One common window makes a
   candidate, however many items share it, so neither the blocks nor the number of items matter.
4. A document and a candidate item are aligned word by word (local alignment) where the document is
   dense in words of the item, and the slots under the placeholders are compared: ``replaced`` slots
   hold something else than the item's, ``odd`` ones not the same thing wherever they come up.

A leak of kind "text" is an aligned passage, or a part of one, of at least MIN_WORDS successive words of
the item of which at least MIN_SAME agree literally. If instead the placeholders agree and slots were
replaced, all consistently, the pair is a re-parameterised item (kind "template").

Not found: passages without any five words in a row unaltered (every fifth word altered).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window; words and share of agreeing words of a leak.
WINDOW = 5
MIN_WORDS, MIN_SAME = 24, 0.8
#: For re-parameterised items: the share of canonical words that agree.
MIN_TEMPLATE = 0.9
#: The share of the document's words across the passage that must agree, so that scattered pieces are no passage.
MIN_DENSE = 0.65
#: Words that the ends of a passage may lack to alterations.
SLACK = 2
#: Item words shipped at once.
ITEM_WORDS_PER_BLOCK = 2_000_000
#: A passage of MIN_WORDS words of which MIN_TEMPLATE agree has at least so many common windows.
TEMPLATE_WINDOWS = int(MIN_WORDS * (1 - WINDOW * (1 - MIN_TEMPLATE))) - WINDOW + 1
#: The longest item, and the longest stretch of a document, that is aligned in one piece; longer ones are cut along the diagonals of their common windows.
LONG_ITEM, LONG = 1_000, 2_000
#: Words that begin sentences and are no names.
FUNCTION_WORDS = frozenset("a an the this that these those it its he she they we you i his her their our my your who what when where why how which if then else and or but so as at by for from in of on to with not no do does did is are was were be been has have had can could will would should may might must after before while each every all some any there here let given find".split())
#: Alignment scores and the words looked at beyond the first and last common window.
SAME, OTHER, GAP, MARGIN = 2, -1, -1, 40

#: Units of measure that follow a number.
UNITS = frozenset("ns us ms s sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years b kb mb gb tb kib mib gib byte bytes bit bits px pt em m cm mm km g kg lb lbs % percent row rows line lines time times word words".split())

_TAG = re.compile(r"""</?[a-zA-Z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))*\s*/?>|<!--.*?-->""", re.S)
_LINK = re.compile(r"\]\([^()\s]+\)")
_LEAD = re.compile(r"(?m)^[ \t]*(?:\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?[ \t]+[A-Z]{3,8}\b|\d{1,4}[.):](?=\s)|[-+*>#/|;%]+(?=\s))[ \t]*")
_OUT = re.compile(r"[\W_]+")
_NUMBER = re.compile(r"[+-]?\d[\d.,:]*")
_NAME = re.compile(r"[a-z0-9][A-Z]|[A-Za-z0-9]_[A-Za-z0-9]|\w/\w|\w\(\)|\w\.\w")


#: Words whose forms are remembered within a process, at most so many at a time.
KNOWN_WORDS = 200_000
_KNOWN: dict[str, tuple[str, str]] = {}


def _word(raw: str) -> tuple[str, str]:
    """A raw word without markup and case ("" if nothing is left), and its canonical form but for units."""
    w = _OUT.sub("", raw).casefold()
    core = raw.strip("*_`~\"'“”‘’()[]{}<>.,;:!?")
    return w, "<num>" if _NUMBER.fullmatch(core) else "<name>" if w not in UNITS and _NAME.search(core) else w


def pieces_of(text: str) -> list[str]:
    """The raw words of a text without markup and line heads."""
    return _LEAD.sub(" ", _LINK.sub("] ", _TAG.sub("", html.unescape(text) if "&" in text else text))).split()


def words_of(text: str | None) -> tuple[list[str], list[str]]:
    """The words of a text without layout and markup, and the canonical form of each."""
    if not text:
        return [], []
    words, canon = [], []
    for raw in pieces_of(text):
        got = _KNOWN.get(raw)
        if got is None:
            got = _KNOWN[raw] = _word(raw)
            if len(_KNOWN) > KNOWN_WORDS:
                _KNOWN.clear()
        w, c = got
        if w:
            words.append(w)
            canon.append("<unit>" if w in UNITS and canon and canon[-1] == "<num>" and c != "<num>" else c)
    return words, canon


def window_hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each window of canonical word numbers."""
    if len(ids) < WINDOW:
        return np.zeros(0, dtype=np.uint64)
    n = len(ids) - WINDOW + 1
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            out = out * np.uint64(0x100000001B3) + ids[k : k + n].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Windows:
    """The windows of items, ready for probing."""

    def __init__(self, canon: list[list[int]]):
        h = [window_hashes(np.array(c, dtype=np.int64)) for c in canon]
        keys = np.concatenate([*h, np.zeros(0, np.uint64)])
        item, at = np.repeat(np.arange(len(h)), [len(x) for x in h]), np.concatenate([*(np.arange(len(x)) for x in h), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        self.item, self.at = item[order], at[order]
        self.keys, self.start, self.n = np.unique(keys[order], return_index=True, return_counts=True)

    def hits(self, canon: list[int], least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Items that share at least so many windows with a document: item number, and the places of the windows in the document and in the item."""
        h = window_hashes(np.array(canon, dtype=np.int64))
        if not len(h) or not len(self.keys):
            return
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[k] == h)
        if not len(at):
            return
        k = k[at]
        n = self.n[k]
        flat = np.repeat(self.start[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, place, own = self.item[flat], np.repeat(at, n), self.at[flat]
        order = np.argsort(item, kind="stable")
        place, own = place[order], own[order]
        edges = np.flatnonzero(np.diff(item[order])) + 1
        item = item[order].tolist()
        for first, last in zip(cut := [0, *edges.tolist()], [*cut[1:], len(item)]):
            if last - first >= least:
                yield item[first], place[first:last], own[first:last]


class Items:
    """A block of items: words, canonical words with and without placeholders for names, and their windows."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        self.small = FUNCTION_WORDS | {w.strip("*_`~\"'“”‘’()[]{}<>.,;:!?") for t in texts for w in pieces_of(t) if w[:1].islower()}
        self.vocabulary: dict[str, int] = {"<unit>": 1}
        self.numbers: dict[str, int] = {}
        self.known: dict[str, tuple] = {}
        self.open = True
        self.words, self.canon, self.named, self.word_ids, self.canon_ids, self.named_ids = (list(x) for x in zip(*map(self.encode, texts))) if texts else ([], [], [], [], [], [])
        self.open = False
        self.known.clear()
        self.word_numbers = [np.array(x, dtype=np.int64) for x in self.word_ids]
        self.word_sets, self.named_sets = [frozenset(x) for x in self.word_ids], [frozenset(x) for x in self.named_ids]
        self.plain, self.template = Windows(self.canon_ids), Windows(self.named_ids)

    def _number(self, table: dict[str, int], word: str) -> int:
        """The number of a word; 0 for one in no item."""
        return table.setdefault(word, len(table) + 1) if self.open else table.get(word, 0)

    def encode(self, text: str) -> tuple[list[str], list[str], list[str], list[int], list[int], list[int]]:
        """Words, canonical words, canonical words with names replaced, and the numbers of all three."""
        rows, known, number = [], self.known, False
        for raw in pieces_of(text):
            got = known.get(raw)
            if got is None:
                w, c = _word(raw)
                core = raw.strip("*_`~\"'“”‘’()[]{}<>.,;:!?")
                n = "<name>" if c == w and core[:1].isupper() and core.lower() not in self.small and core.removesuffix("'s").isalpha() else c
                i = self._number(self.numbers, w)
                plain = (w, c, n, i, self._number(self.vocabulary, c), self._number(self.vocabulary, n))
                got = known[raw] = (plain if w else None, (w, "<unit>", "<unit>", i, 1, 1) if w in UNITS and c != "<num>" else plain, c == "<num>")
                if len(known) > KNOWN_WORDS:
                    known.clear()
            if got[0] is not None:
                rows.append(got[number])
                number = got[2]
        return tuple(map(list, zip(*rows))) if rows else ([], [], [], [], [], [])


def dense(ids: list[int], own: frozenset[int], least: float) -> bool:
    """Whether some MIN_WORDS + SLACK successive words hold at least ``least`` words of the item, as every passage to be found does."""
    inside = list(accumulate(map(own.__contains__, ids), initial=0))
    width = MIN_WORDS + SLACK
    return inside[-1] >= least and (len(ids) <= width or max(map(sub, inside[width:], inside)) >= least)


def align(a: list[str], b: list[str]) -> tuple[int, int, list[tuple[int, int]]]:
    """The best local alignment of words a (document) and b (item): item span (first, last) and the aligned positions."""
    if len(a) > 2 * len(b):  # the table is made row by row, over the shorter side
        pairs = [(j, i) for i, j in align(b, a)[2]]
        return (pairs[0][1], pairs[-1][1], pairs) if pairs else (0, -1, pairs)
    number: dict[str, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in a], dtype=np.int64)
    y = np.array([number.setdefault(w, len(number)) for w in b], dtype=np.int64)
    m = len(b)
    table = np.zeros((len(a) + 1, m + 1), dtype=np.int32)
    ramp = np.arange(m + 1, dtype=np.int32) * -GAP
    for i in range(1, len(a) + 1):
        row = np.maximum(table[i - 1, 1:] + GAP, table[i - 1, :-1] + np.where(y == x[i - 1], SAME, OTHER))
        row = np.concatenate(([0], np.maximum(row, 0)))
        table[i] = np.maximum.accumulate(row + ramp) - ramp
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    pairs, last = [], int(j) - 1
    while i > 0 and j > 0 and table[i, j] > 0:
        if table[i, j] == table[i - 1, j - 1] + (SAME if x[i - 1] == y[j - 1] else OTHER):
            pairs.append((int(i) - 1, int(j) - 1))
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    pairs.reverse()
    return (pairs[0][1] if pairs else 0), last, pairs


def consistent(words: list[str], item: list[str], canon: list[str], pairs: list[tuple[int, int]]) -> tuple[int, int]:
    """Of aligned slots: how many were replaced, and how many of these not the same way throughout."""
    seen: dict[str, str] = {}
    replaced = odd = 0
    for p, q in pairs:
        if canon[q].startswith("<") and words[p] != item[q]:
            replaced += 1
            odd += seen.setdefault(item[q], words[p]) != words[p]
    return replaced, odd


def passage(words: list[str], ids: list[int], item: list[str], own: frozenset[int]) -> tuple[int, int] | None:
    """(words of the item's passage, agreeing words) if some words of a document hold a passage of an item.

    The best alignment counts as a whole, or else by the part of it that has most agreeing words among those of
    MIN_WORDS or more that meet the thresholds; if there is none, what lies before and after it is aligned too.
    """
    if not dense(ids, own, MIN_SAME * (MIN_WORDS - SLACK)):
        return None
    j0, j1, pairs = align(words, item)
    if not pairs:
        return None
    agree = [words[p] == item[q] for p, q in pairs]
    same, span = sum(agree), j1 - j0 + 1
    if span >= MIN_WORDS - SLACK and same >= MIN_SAME * max(span, MIN_WORDS - SLACK) and same >= MIN_DENSE * (pairs[-1][0] - pairs[0][0] + 1):
        return span, same
    met = [x for x, f in zip(pairs, agree) if f]
    at, to, k = np.array([p for p, _ in met]), np.array([q for _, q in met]), np.arange(len(met))
    best = None
    for first in range(len(met)):
        n, wide, across = k[first:] - first + 1, to[first:] - to[first] + 1, at[first:] - at[first] + 1
        good = np.flatnonzero((wide >= MIN_WORDS) & (n >= MIN_SAME * wide) & (n >= MIN_DENSE * across))
        if len(good) and (best is None or n[good[-1]] > best[1]):
            best = int(wide[good[-1]]), int(n[good[-1]])
    if best:
        return best
    first, last = pairs[0][0], pairs[-1][0] + 1
    return passage(words[:first], ids[:first], item, own) or passage(words[last:], ids[last:], item, own)


def stretches(places: list[int], reach: int) -> list[tuple[int, int]]:
    """Window positions joined to stretches whose gaps are at most ``reach``."""
    places = sorted(places)
    out, first = [], places[0]
    for a, b in zip(places, places[1:] + [None]):
        if b is None or b - a > reach:
            out.append((first, a))
            first = b
    return out


def pieces(place: np.ndarray, own: np.ndarray, n: int, item: int) -> Iterator[tuple[int, int, int, int]]:
    """(first and last word of the document, of the item) to align, from the places of common windows.

    Stretches of windows with a margin, against the whole item. Where either is long, stretches are
    made of windows on neighbouring diagonals and cut into pieces that overlap by more than a
    passage's length, each against the part of the item that its diagonals lead to. So what is
    aligned at once is bounded whatever the lengths.
    """
    def short(at: np.ndarray) -> Iterator[tuple[int, int]]:
        for first, last in stretches(at.tolist(), MARGIN):
            yield max(0, first - MARGIN), min(n, last + WINDOW + MARGIN)

    if item <= LONG_ITEM:
        whole = list(short(place))
        yield from ((low, high, 0, item) for low, high in whole if high - low <= LONG)
        rest = [(low, high) for low, high in whole if high - low > LONG]
        if not rest:
            return
        keep = np.zeros(len(place), dtype=bool)
        for low, high in rest:
            keep |= (place >= low) & (place < high)
        place, own = place[keep], own[keep]
    diagonal = place - own
    order = np.argsort(diagonal, kind="stable")
    place, diagonal = place[order], diagonal[order]
    for s, e in zip(cut := [0, *(np.flatnonzero(np.diff(diagonal) > MARGIN) + 1).tolist()], [*cut[1:], len(place)]):
        for low, high in short(place[s:e]):
            while low < high:
                end = min(high, low + LONG)
                here = diagonal[s:e][(place[s:e] >= low) & (place[s:e] < end)]
                if len(here):
                    yield low, end, max(0, low - int(here.max()) - MARGIN), min(item, end - int(here.min()) + MARGIN)
                if end == high:
                    break
                low = end - 4 * MARGIN


def literal(place: np.ndarray, own: np.ndarray, ids: np.ndarray, item: np.ndarray) -> int:
    """The length of the longest run of windows on one diagonal whose words are literally the item's, in words; 0 if none reaches MIN_WORDS."""
    if len(place) < MIN_WORDS - WINDOW + 1:
        return 0
    order = np.lexsort((place, place - own))
    p, q = place[order], own[order]
    ends = [0, *(np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1).tolist(), len(p)]
    best = 0
    for s, e in zip(ends, ends[1:]):
        n = e - s + WINDOW - 1
        if n > max(best, MIN_WORDS - 1):
            odd = np.flatnonzero(ids[p[s] : p[s] + n] != item[q[s] : q[s] + n])
            run = int(np.diff([-1, *odd.tolist(), n]).max()) - 1
            best = max(best, run if run >= MIN_WORDS else 0)
    return best


def judge(items: Items, text: str | None) -> list[tuple[int, str, int, int, int, int]]:
    """(item_id, kind, words of the item's passage, agreeing words, replaced slots, odd slots) of every item that leaked into a text."""
    if not text:
        return []
    words, canon, named, ids, slots, names = items.encode(text)
    numbers, out, told = np.array(ids, dtype=np.int64), [], set()
    for n, place, own in items.plain.hits(slots):
        low, high = max(0, int(place[0]) - MARGIN), int(place[-1]) + WINDOW + MARGIN
        if high - low < 4 * MARGIN and sum(map(items.word_sets[n].__contains__, ids[low:high])) < MIN_SAME * (MIN_WORDS - SLACK):
            continue  # too few words of the item near any common window
        run = literal(place, own, numbers, items.word_numbers[n])
        best = (run, run, 0, 0) if run else None
        if not run:
            for low, high, i, j in pieces(place, own, len(words), len(items.words[n])):
                got = None
                if dense(ids[low:high], items.word_sets[n], MIN_SAME * (MIN_WORDS - SLACK)):
                    got = passage(words[low:high], ids[low:high], items.words[n][i:j], items.word_sets[n])
                if got and (best is None or got[1] > best[1]):
                    pairs = align(canon[low:high], items.canon[n][i:j])[2]
                    best = (*got, *consistent(words[low:high], items.words[n][i:j], items.canon[n][i:j], pairs))
        if best:
            told.add(n)
            out.append((items.ids[n], "text", *best))
    for n, place, own in items.template.hits(names, TEMPLATE_WINDOWS):
        best = None
        for low, high, i, j in pieces(place, own, len(words), len(items.words[n])) if n not in told else ():
            if dense(names[low:high], items.named_sets[n], MIN_TEMPLATE * MIN_WORDS):
                item, slots = items.words[n][i:j], items.named[n][i:j]
                j0, j1, pairs = align(named[low:high], slots)
                agree = sum(named[low + p] == slots[q] for p, q in pairs)
                replaced, odd = consistent(words[low:high], item, slots, pairs)
                if j1 - j0 + 1 >= MIN_WORDS and agree >= MIN_TEMPLATE * (j1 - j0 + 1) and replaced and not odd and (best is None or agree > best[1]):
                    best = (j1 - j0 + 1, agree, replaced, odd)
        if best:
            out.append((items.ids[n], "template", *best))
    return out


def own_wording(items: DataFrame) -> DataFrame:
    """(item_id, text) without the standing instruction: a first paragraph that two or more items of a suite begin with."""
    parts = items.select("item_id", "suite", F.col("text"), F.regexp_extract("text", r"(?s)^(.*?)\n[ \t]*\n", 1).alias("head"))
    shared = parts.where(F.col("head") != "").groupBy("suite", "head").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(F.col("suite").alias("_s"), F.col("head").alias("_h"))
    both = parts.join(shared, parts["suite"].eqNullSafe(shared["_s"]) & (parts["head"] == shared["_h"]), "left")
    return both.select("item_id", F.when(F.col("_h").isNotNull(), F.expr("substring(text, length(_h) + 1)")).otherwise(F.col("text")).alias("text"))


def leaks(docs: DataFrame, items: DataFrame, words_per_block: int = ITEM_WORDS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id, kind, span, same, replaced, odd) of every document and item that leaked into it.

    ``docs``: doc_id, text; ``items``: item_id, suite, text. Null and empty texts and items of
    fewer than 24 words of their own give nothing. Repeated rows of either side are reported as
    often as they occur; an empty side gives an empty result. Items beyond ``words_per_block``
    words are taken in further passes over the documents, so what is shipped stays bounded.
    """
    own = own_wording(items).where(F.col("text").isNotNull())
    own = own.withColumn("_n", F.size(F.split("text", r"\s+")).cast("bigint"))
    total = own.agg(F.sum("_n")).first()[0] or 0
    blocks = max(1, -(-total // words_per_block))
    out = None
    for b in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").orderBy("item_id").collect()  # one block of bounded size
        block = docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        def run(it: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            ready = Items(*block.value)
            for pdf in it:
                found = [(d, *x) for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()) for x in judge(ready, t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "kind", "span", "same", "replaced", "odd"])

        part = docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, item_id bigint, kind string, span int, same int, replaced int, odd int")
        out = part if out is None else out.unionByName(part)
    return out
