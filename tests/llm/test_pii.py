import itertools
import random
from collections import Counter

import pytest

from histrata.llm import pii as P
from histrata.llm import pii_train as T


@pytest.fixture(scope="module")
def tagger():
    return P.Tagger(P.load_weights(), T.lexicon(4))


def test_held_out_accuracy(tagger):
    right, extra, missing = Counter(), Counter(), Counter()
    for text, spans in T.sentences(777, 1200):
        got, gold = {k for _, _, k in tagger.find(text)}, {k for _, _, k in spans}
        for k in P.KINDS:
            right[k] += k in got and k in gold
            extra[k] += k in got and k not in gold
            missing[k] += k in gold and k not in got
    for k in P.KINDS:
        assert right[k] / (right[k] + extra[k]) > 0.95 and right[k] / (right[k] + missing[k]) > 0.93, (k, right, extra, missing)


@pytest.mark.parametrize("text,kinds", [("Contact: a.soto@x.test", {"email"}), ("ask a.soto (at) x (dot) test", {"email"}), ("git@host.example:a/b.git", set()), ("ssh://git@host.example:22/x", set()), ("Bump anvil@1.2.3 to 1.3.0", set()), ("call +49 30 23125-555 now", {"phone"}), ("10.0.17.12:9418", set()), ("SSN 913-26-9890 was found", {"id_number"}), ("order 221-45-7212 of the queue", set()), ("ships to 12 Birch Lane, Elmsford", {"address"}), ("Main Street tile set has 20 blobs.", set()), ("Signed-off-by: Ravi Soto <r@x.test>", {"person", "email"}), ("Paired with nobody.", set()), ("", set())])
def test_cases(tagger, text, kinds):
    assert {k for _, _, k in tagger.find(text)} == kinds


def test_best_is_optimal():
    r = random.Random(2)
    for _ in range(200):
        spans = [(s, s + r.randint(1, 5), "k", r.uniform(-1, 3)) for s in (r.randint(0, 12) for _ in range(7))]
        spans = list(dict.fromkeys(spans))
        top = max(sum(x[3] for x in c) for n in range(len(spans) + 1) for c in itertools.combinations(spans, n) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2)))
        score = {x[:3]: max(y[3] for y in spans if y[:3] == x[:3]) for x in spans}
        got = P.best(spans)
        assert sum(score[x] for x in got) == pytest.approx(top)


def test_gradient_is_the_derivative():
    spans = [(0, 3, ["a"]), (2, 5, ["b"]), (3, 6, ["c", "a"]), (6, 7, ["d"])]
    w = {"a": 0.3, "b": -0.2, "c": 0.5, "d": 0.1}
    _, grad = P.lattice_gradient(spans, {0, 2}, w)
    for f in w:
        up, _ = P.lattice_gradient(spans, {0, 2}, w | {f: w[f] + 1e-5})
        down, _ = P.lattice_gradient(spans, {0, 2}, w | {f: w[f] - 1e-5})
        assert (up - down) / 2e-5 == pytest.approx(sum(g for (_, _, fs), g in zip(spans, grad) if f in fs), abs=1e-5)


def test_in_spark(spark):
    rows = [("a", "Contact: a.soto@x.test\ncall +49 30 23125-555 now", "Ravi Soto", "x"), ("a", "Contact: a.soto@x.test\ncall +49 30 23125-555 now", "Ravi Soto", "x"), ("b", None, None, None), (None, "a@b.test", "q", "q"), ("c", "plain " * 20000, "Ravi Mando", "z"), ("d", "", "Ravi Lun", "Ravi Toko")]
    df = spark.createDataFrame(rows, "oid string, message string, author_name string, committer_name string").selectExpr("*", "1 as pii_kind")
    assert sorted(map(tuple, P.kinds(df).collect())) == [("a", "email"), ("a", "phone")]
    red = {r["oid"]: r["redacted"] for r in P.redacted(df).collect()}
    assert red["a"] == "Contact: [EMAIL]\ncall [PHONE] now" and red["c"] == "plain " * 20000 and set(red) == {"a", "c", "d"}
    assert "ravi" in P.given_names(df)
    assert P.kinds(df.where("false")).count() == 0


def test_given_names_in_any_script(spark, monkeypatch):
    """Names with letters beyond ASCII are learned, and those beyond the shipped number are joined."""
    names = ["Łucja", "Inês", "Zoë", "Çelik", "Борис"]
    rows = [(f"{n}{s}", f"Paired with {n} Fokatrefeld", f"{n} {s}", None) for n in names for s in ("Soto", "Çakır", "Müller")]
    df = spark.createDataFrame(rows, "oid string, message string, author_name string, committer_name string")
    want = {P.fold(n) for n in names}
    assert want <= P.given_names(df)
    full = sorted(map(tuple, P.redacted(df).collect()))
    assert {r[1] for r in full} == {"Paired with [PERSON]"} and {r[1] for r in P.kinds(df).collect()} == {"person"}
    monkeypatch.setattr(P, "LEXICON", 2)
    assert P.given_names(df) is None and sorted(map(tuple, P.redacted(df).collect())) == full
    assert {r[1] for r in P.kinds(df).collect()} == {"person"}


def test_words_asked_for_are_enough():
    weights, given = P.load_weights(), T.lexicon(4)
    for text, _ in T.sentences(778, 400):
        assert P.Tagger(weights, given & P.asked(text)).find(text) == P.Tagger(weights, given).find(text), text
