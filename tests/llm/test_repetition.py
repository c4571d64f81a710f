import random

from histrata.llm import repetition as R


def brute(text):
    w = R.words_of(text)
    seen, hit = set(), [False] * len(w)
    for i in range(len(w) - 3):
        g = tuple(w[i : i + 4])
        if g in seen:
            hit[i : i + 4] = [True] * 4
        seen.add(g)
    return len(w), sum(hit)


def test_counts_against_brute_force():
    r = random.Random(1)
    texts = [None, "", "a", "a a a", "a a a a a", "A1B a_b é É 12 3", "x y z w " * 3] + [" ".join(r.choice("abcde") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["spam and eggs for you " * 3000]
    n, k = R.repeated_counts(texts)
    assert list(zip(n, k)) == [brute(t) for t in texts]
    assert [x.tolist() for x in R.repeated_counts([])] == [[], []]


def test_words():
    assert R.words_of("Foo1bar 22 x_y ÜBER, it's") == ["foobar", "x_y", "über", "it", "s"]


def test_bounds():
    assert abs(R.binomial_tail(0, 100, 0.03) - 0.97**100) < 1e-12
    assert R.binomial_tail(5, 0, 0.1) == 1.0 and R.upper_bound(3, 3, 0.05) == 1.0
    u = R.upper_bound(2, 200, 0.05)
    assert abs(R.binomial_tail(2, 200, u) - 0.05) < 1e-6


def test_cutoffs_keep_their_promise(spark):
    """On data whose true false-rejection rate is known, chosen cutoffs exceed alpha in at most about delta of the trials."""
    r = random.Random(5)
    wrong = 0
    for trial in range(8):
        rows = [("s", min(1.0, abs(r.gauss(0, 0.22))), True) for _ in range(1500)] + [("s", 0.9, False)] * 20 + [(None, None, True), (None, 0.1, True)]
        got = {x[0]: x for x in R.cutoffs(spark.createDataFrame(rows, "k string, score double, wanted boolean"), "k", "score", "wanted").collect()}
        cut = got["s"][2]
        assert cut is not None and got[None][2] is None
        truth = sum(min(1.0, abs(r.gauss(0, 0.22))) >= cut for _ in range(40000)) / 40000
        wrong += truth > R.ALPHA
    assert wrong <= 2
    assert R.cutoffs(spark.createDataFrame([], "k string, score double, wanted boolean"), "k", "score", "wanted").collect() == []


def test_repetitive_documents(spark):
    rows = [(1, "log", "a b c d " * 9, 0.0), (2, "log", "all words here differ from each other", 1.0), (3, None, None, None), (4, "x", "", 0.0), (5, "x", "one two three four five one two three four", 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, doc_kind string, text string, share double")
    assert {x["doc_id"] for x in R.repetitive(df).collect()} == {1, 5} - ({5} if 5 * brute(rows[4][2])[1] < 2 * brute(rows[4][2])[0] else set())
    assert R.repetitive(df.where("false")).count() == 0
    m = {x["doc_id"]: x for x in R.measure(df).collect()}
    assert m[3]["words"] == 0 and m[3]["share"] == 0.0 and m[1]["line_share"] == 0.0


def test_pieces_of_long_texts():
    texts = ["ab" * 5, None, "c" * 30, "", "d"]
    assert list(R.pieces_of(texts, 12)) == [["ab" * 5, None], ["c" * 30], ["", "d"]] and list(R.pieces_of([])) == [[]]


def test_cutoffs_on_labels_that_the_score_does_not_make(spark):
    """Repeated lines of few words are no repetition by the definition: the cutoff has to rise above what such documents score."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda lines, again: "\n".join(x for x in ([" ".join(word() for _ in range(30)) for _ in range(lines)] + ["ok"] * again))
    rows = [(i, "plain", text(8, 4)) for i in range(2500)] + [(3000 + i, "plain", "\n".join([" ".join(word() for _ in range(9))] * 20)) for i in range(40)] + [(9000, "few", "a b c d " * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, doc_kind string, text string")
    cut = {x["doc_kind"]: x for x in R.cutoffs(R.holdout(R.measure(df), "doc_id"), "doc_kind", R.SCORE, "wanted").collect()}
    assert "few" not in cut and 0.25 < cut["plain"]["cutoff"] < 0.95 and cut["plain"]["bound"] <= R.ALPHA
    steps = {x["doc_id"]: x["step"] for x in R.repetitive(df).collect()}
    assert set(steps) == {9000, *range(3000, 3040)} and steps[9000] == "check" and {steps[k] for k in range(3000, 3040)} == {"cutoff"}
    told = {x["doc_kind"]: x for x in R.risk(df).collect()}["plain"]
    assert told["false_rejections"] == 0 and told["caught"] == told["repetitive"] > 0
