import itertools

import pytest

from histrata.llm import names as N


@pytest.mark.parametrize("name,want", [("Krisestart, J", ("p", "j", "krisestart")), ("J. Krisestart", ("p", "j", "krisestart")), ("AL-SHODI Wanjiru", ("p", "wanjiru", "alshodi")), ("l.fahutam", ("p", "l", "fahutam")), ("Jörg van der Veve Jr.", ("p", "jorg", "vanderveve")), ("Dr. Ana B. Soto-Ruiz [x1]", ("p", "ana", "sotoruiz")), ("The Acme Rel. Tm", ("o", "release team", "acme")), ("Research Institute (Stag)", ("o", "institute research", "stag")), ("", None), (None, None), ("  ", None), ("123", None)])
def test_parse(name, want):
    assert N.parse(name) == want


def test_edit_tests():
    for a, b, want in (("abcd", "abdc", True), ("abcd", "abc", True), ("abcd", "abxd", True), ("abcd", "acbd", True), ("abcd", "badc", False), ("", "", True)):
        assert N.near(a, b) is want and (N.edits(a, b) <= 1) is want
    assert N.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and N.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert N.jaro_winkler("", "a") == 0.0


def test_codes_one_error_apart_meet():
    for word in ("medrashesen", "frederick", "kriferitte", "oluwaseun"):
        for i in range(len(word)):
            for w in {word[:i] + word[i + 1 :], word[:i] + "t" + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + word[i : i + 2][::-1] + word[i + 2 :]}:
                if len(w) > 3:
                    assert N.blocks(word) & N.blocks(w) or len(N.sound(word)) - len(N.sound(w)) > 1, (word, w)


def test_groups(spark):
    groups = [
        [("Abigail Medrashesen", "abigail.medrashesen@a.test"), ("MEDRASHESEN Abigail", None), ("Abby Medrashesen", ""), ("abigail medrasheesn", "root@localhost"), ("A. Medrashesen", "x@y")],
        [("Jörg Veveduberg", "owl1@p.test"), ("Joerg Veveduberg", None), ("Veveduberg, Jörg", None)],
        [("Thomas Krokrukrus", "thomas.krokrukrus@a.test"), ("Tom Krokrukrus", None)], [("Theodore Krokrukrus", "theodore@b.test"), ("Ted Krokrukrus", None), ("T. Krokrukrus", "theodore@b.test")],
        [("William Kafeposki", "shared@c.test")], [("Edward Kafeposki", "shared@c.test"), ("Edawrd Kafeposki", None)],
        [("Gadichend Infrastructure Department", "i@g"), ("Infra Dept., Gadichend", None), ("The Gadichemd Infrastructure Department", None)], [("Gadichend Release Team", "i@g"), ("gadichend-rel.-tm", None)],
        [(None, "a@b")], [("", "a@b")],
    ]
    rows, want, k = [], set(), 0
    for g in groups:
        ids = []
        for n, e in g:
            rows.append((k, n, e, "x"))
            ids.append(k)
            k += 1
        want |= set(itertools.combinations(ids, 2))
    df = spark.createDataFrame(rows, "sig_id bigint, name string, email string, entity string")
    assert {tuple(r) for r in N.variants(df).collect()} == want
    assert {r["sig_id"] for r in N.entities(df).collect()} == set(range(k))
    assert N.variants(df.where("false")).count() == 0


def test_many_copies_of_one_name(spark):
    df = spark.range(600).selectExpr("id as sig_id", "case when id % 3 = 0 then 'Ravi Shupol' else concat('Ravi Nam', id) end as name", "cast(null as string) as email")
    assert N.variants(df).where("sig_a % 3 = 0 AND sig_b % 3 = 0").count() == 200 * 199 // 2


def test_more_data_changes_no_decision():
    """Whether two given names are one misspelt depends on how often they occur beside each other, not on how much there is."""
    for scale in (1, 10, 1000):
        assert N.same_given("marek", "marrek", 120 * scale, 3 * scale) == "typo"
        assert N.same_given("jana", "jara", 120 * scale, 80 * scale) == ""


def test_blocks_meet_one_letter_apart():
    import random

    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randint(3, 11)))
        k, c = r.randrange(len(t)), r.choice(letters)
        for u in (t[:k] + t[k + 1 :], t[:k] + c + t[k:], t[:k] + c + t[k + 1 :], t[:k] + t[k : k + 2][::-1] + t[k + 2 :]):
            if N.similar(t, u):
                assert N.blocks(t) & N.blocks(u), (t, u)


def test_any_script(spark):
    rows = [(1, "Борис Иванов", "a@x.test"), (2, "Иванов, Борис", None), (3, "Борис Петров", None)]
    assert [tuple(x) for x in N.variants(spark.createDataFrame(rows, "sig_id bigint, name string, email string")).collect()] == [(1, 2)]
