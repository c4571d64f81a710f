import random

import numpy as np

from histrata.llm import leaks as L

WORDS = [f"{a}{b}{c}" for a in "br kl st fl".split() for b in "aeiou" for c in "nd rk ve lp mish torn".split()]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_own_wording(spark):
    rows = [(1, "s", "Do this now.\n\nown one"), (2, "s", "Do this now.\n\nown two"), (3, "s", "own three\n\nmore"), (4, None, "Do this now.\n\nx"), (5, "s", None)]
    got = {r["item_id"]: (r["text"] or "").strip() for r in L.own_wording(spark.createDataFrame(rows, "item_id bigint, suite string, text string")).collect()}
    assert got == {1: "own one", 2: "own two", 3: "own three\n\nmore", 4: "Do this now.\n\nx", 5: ""}


def test_found_and_not_found(spark):
    r = random.Random(3)
    head = "Answer the question from the paragraph below and give only the letter of the one right answer please do so."
    items = [(i, "s", f"{head}\n\n{sentence(r, 60)}.") for i in range(30)] + [(90, "t", "too short to leak"), (91, "t", None)]
    own = {i: t.split("\n\n")[1].rstrip(".").split() for i, _, t in items[:30]}
    docs, want = [], set()

    def doc(text, *hit):
        docs.append((len(docs), text))
        want.update((len(docs) - 1, h) for h in hit)

    noise = lambda n=40: sentence(r, n)
    doc(None)
    doc("")
    doc(noise(900))
    doc(f"{noise()} {' '.join(own[0])} {noise()}", 0)
    doc(f"{noise()} {' '.join(own[1][10:36])} {noise()}", 1)
    doc(f"{noise()} {' '.join(own[2][10:22])} {noise()}")
    doc("\n".join(f"> **{w.upper()}**," for w in own[3][:40]), 3)
    doc("# " + " ".join(f"<b>{w}</b>" for w in own[4][5:40]), 4)
    alt = list(own[5][:50])
    for k in (4, 13, 21, 30, 38):
        alt[k] = "zzz"
    del alt[26]
    doc(" ".join(alt), 5)
    doc(head + " " + noise())
    doc(f"{' '.join(own[6])} {noise(300)} {' '.join(own[7])}", 6, 7)
    doc(" ".join(noise(5) + " " + " ".join(own[8][k : k + 5]) for k in range(0, 60, 5)))
    doc("\n12. ".join(" ".join(own[9][k : k + 8]) for k in range(0, 56, 8)), 9)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as item_id")
    it = spark.createDataFrame(items, "item_id bigint, suite string, text string")
    for per in (2_000_000, 400):
        got = {(x["doc_id"], x["item_id"]) for x in L.leaks(df, it, per).where("kind = 'text'").collect()}
        assert got == want
    assert L.leaks(df.where("false"), it).count() == 0 and L.leaks(df, it.where("false")).count() == 0


def test_reparameterised_items(spark):
    item = "A train of 120 carriages leaves for build_alpha at 7 ms past the start and meets parser_one after 33 rows while the second of 45 trains waits for parser_one near the yard until the signal of build_alpha shows that 90 rows were read"
    swap = item.replace("120", "77").replace("33", "21").replace("45", "3").replace("90", "12").replace("build_alpha", "load_beta").replace("parser_one", "lexer_two")
    odd = swap.replace("load_beta", "load_gamma", 1)
    it = spark.createDataFrame([(1, "s", item)], "item_id bigint, suite string, text string")
    df = spark.createDataFrame([(1, swap), (2, odd), (3, item)], "doc_id bigint, text string")
    got = {x["doc_id"]: x["kind"] for x in L.leaks(df, it).collect()}
    assert got[3] == "text" and got.get(1) in ("template", "text") and (2 not in got or got[2] == "text")


def test_long_texts_are_cut_with_overlap():
    n = np.arange(9000)
    parts = list(L.pieces(n, n + 5, 9050, 20_000))
    assert all(h - g <= L.LONG and j - i <= L.LONG + 2 * L.MARGIN + 5 for g, h, i, j in parts) and parts[-1][1] == 9044
    assert all(b[0] == a[1] - 4 * L.MARGIN for a, b in zip(parts, parts[1:]))
    assert list(L.pieces(np.array([50]), np.array([3]), 500, 60)) == [(10, 95, 0, 60)]


def test_very_long_item_and_document():
    r = random.Random(8)
    item = sentence(r, 20_000).split()
    items = L.Items([7], [" ".join(item)])
    alter = lambda ws: [w if k % 8 else "zzz" for k, w in enumerate(ws)]
    doc = sentence(r, 3000).split() + alter(item[15_000:18_000]) + sentence(r, 3000).split()
    assert [x[:2] for x in L.judge(items, " ".join(doc))] == [(7, "text")]
    assert L.judge(items, sentence(r, 9000)) == []


def test_siblings_hide_nothing(spark):
    """A quotation with altered words is found however many items share its words, and however the items are cut into blocks."""
    r = random.Random(4)
    own = sentence(r, 24).split()
    items = [(i, "s", " ".join([*own, *sentence(r, 20).split()])) for i in range(12)]
    quote = list(own)
    for k in (6, 12, 18):
        quote[k] = "zzz"
    df = spark.createDataFrame([(0, sentence(r, 30) + " " + " ".join(quote) + " " + sentence(r, 30))], "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, suite string, text string")
    for per in (2_000_000, 100):
        assert {x["item_id"] for x in L.leaks(df, it, per).collect()} == set(range(12))


def test_names_and_numbers_as_slots():
    item = "Alice has 12 apples. She gives 5 to Robert and walks to Bristol, where Robert sells them for 3 coins each. How many coins does Robert have after Alice takes 2 of them back to Bristol and Robert meets Alice with 5 more?"
    new = item.replace("Alice", "Maria").replace("Robert", "Stephen").replace("Bristol", "Leeds").replace("12", "14").replace("5", "9").replace("3 coins", "8 coins").replace("takes 2", "takes 6")
    items = L.Items([7], [item])
    assert [x[:2] for x in L.judge(items, new)] == [(7, "template")]
    assert L.judge(items, new.replace("Stephen", "Peter", 1)) == []
    assert [x[:2] for x in L.judge(items, item)] == [(7, "text")]


def test_exact_passage_before_a_reworded_rest():
    """An exact passage counts, however much of the words after it is changed; scattered agreement alone does not."""
    r = random.Random(5)
    for exact, keep in ((24, 4), (24, 5), (24, 6), (32, 5)):
        item = sentence(r, 60).split()
        rest = [w if k % 10 < keep else f"other{k}" for k, w in enumerate(item[exact:])]
        items = L.Items([7], [" ".join(item)])
        for words in (item[:exact] + rest, [f"x{k}" for k in range(50)] + item[:exact] + rest + [f"y{k}" for k in range(50)]):
            assert [x[:2] for x in L.judge(items, " ".join(words))] == [(7, "text")], (exact, keep)
    items = L.Items([7], [" ".join(item)])
    assert L.judge(items, " ".join(w if k % 10 < 6 else f"other{k}" for k, w in enumerate(item))) == []
    assert L.judge(items, " ".join(item[:14] + [f"z{k}" for k in range(46)])) == []
