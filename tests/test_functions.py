import re

import pytest
from pyspark.sql import functions as F

from histrata.functions import names as N
from histrata.functions import objects as O
from histrata.functions.revision import parse
from histrata.operators import rules as R


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first()[0]


def test_object_ids(spark):
    assert one(spark, "", lambda c: O.object_id("blob", c)) == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    assert one(spark, None, lambda c: O.object_id("blob", c)) is None
    assert len(one(spark, "x", lambda c: O.object_id("blob", c, "sha256"))) == 64


@pytest.mark.parametrize("text,good", [("a/b", True), ("a/.git/b", False), ("a/../b", False), ("", False), ("/a", False), ("a//b", False), ("GIT~1/x", False), (".gitignore", True), ("a/.GiT", False), ("a/b.git", True), (".git. /x", False)])
def test_valid_path(spark, text, good):
    assert one(spark, text, O.valid_path) is good


@pytest.mark.parametrize("name,good", [("refs/heads/a", True), ("HEAD", True), ("head", False), ("refs/heads/a.lock", False), ("refs/heads/.a", False), ("refs/heads/a..b", False), ("refs/heads/a b", False), ("refs/heads/a@{1}", False), ("refs/heads/", False), ("refs/heads/a.", False)])
def test_valid_name(spark, name, good):
    assert one(spark, name, N.valid_name) is good


def test_signatures(spark):
    s = one(spark, "A <b> C <x@y> 1700000000 -0330", O.parse_signature)
    assert (s["name"], s["email"], s["epoch"], s["tz_min"]) == ("A <b> C", "x@y", 1700000000, -210)
    assert one(spark, "A <x@y> nonsense", O.parse_signature)["epoch"] is None
    assert one(spark, "-----BEGIN SSH SIGNATURE-----\nx", O.signature_kind) == "ssh"
    assert one(spark, "text\n-----BEGIN PGP SIGNATURE-----\nx\n", O.split_signature)["text"] == "text\n"
    raw = "tree a\ngpgsig x\n y\n z\nauthor b\n\nm\n"
    assert one(spark, raw, O.strip_header_signatures) == "tree a\nauthor b\n\nm\n"


def test_text_functions(spark):
    assert one(spark, "a\nb\n", O.lines) == ["a", "b"]
    assert one(spark, "", O.lines) == []
    assert one(spark, "a\n\n", O.lines) == ["a", ""]
    assert one(spark, "a\r\nb\n", O.to_crlf) == "a\r\nb\r\n"
    s = one(spark, "a\r\nb\rc\n\0", O.stat)
    assert (s["crlf"], s["lone_cr"], s["lone_lf"], s["nul"]) == (1, 1, 1, 1)
    assert one(spark, "a\0b", O.is_binary) is True
    assert one(spark, "x" * 8000 + "\0", O.is_binary) is False


def test_modes_and_kinds(spark):
    assert one(spark, "100755", O.parse_mode) == 0o100755
    assert one(spark, "9x", O.parse_mode) is None
    assert one(spark, 0o100664, O.canonical_mode, "int") == 0o100644
    assert one(spark, "tag", O.kind_code) == 4
    assert one(spark, "xyz", O.kind_code) is None
    assert one(spark, 0o120000, O.os_mode, "int")["kind"] == "l"


def test_refspecs(spark):
    spec, name = "+refs/heads/*:refs/remotes/o/*", "refs/heads/a/b"
    df = spark.createDataFrame([(spec, name)], "s string, n string")
    s, n = F.col("s"), F.col("n")
    r = df.select(N.spec_match(s, n), N.spec_dst(s, n), N.spec_reverse(s), N.spec_force(s), N.spec_valid(s)).first()
    assert tuple(r) == (True, "refs/remotes/o/a/b", "+refs/remotes/o/*:refs/heads/*", True, True)
    assert one(spark, "refs/heads/*:refs/heads/x", N.spec_valid) is False
    assert one(spark, ":refs/heads/x", N.spec_delete) is True


@pytest.mark.parametrize("url,kind", [("https://h/x", "url"), ("git@h:a/b", "scp"), ("h:2222/a", "scp"), ("/a/b", "local"), ("./a:b", "local"), ("C:\\x", "local")])
def test_urls(spark, url, kind):
    assert one(spark, url, N.url_kind) == kind


@pytest.mark.parametrize("glob,path,hit", [("*.go", "a.go", True), ("*.go", "d/a.go", False), ("**/a", "x/y/a", True), ("**/a", "a", True), ("a/**", "a/b/c", True), ("a/**/b", "a/b", True), ("a?c", "a/c", False), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("[[:digit:]]", "7", True), ("\\*", "*", True), ("[a", "a", False)])
def test_globs(glob, path, hit):
    rx = N.glob_regex(glob).replace(r"\p{Digit}", "0-9")
    assert bool(re.match(rx, path)) is hit


def test_ignore(spark):
    rules = R.parse_ignores("# c\n*.log\n!keep.log\nbuild/\n/top\nout/*\n!out/a\n")
    paths = {"a.log": True, "d/keep.log": False, "build/x/y": True, "x/build": False, "top": True, "d/top": False, "out/b": True, "out/a": False, "build/keep.log": True}
    df = spark.createDataFrame(list(paths.items()), "p string, want boolean")
    assert df.where(R.ignored(F.col("p"), rules) != F.col("want")).collect() == []
    assert one(spark, "x", lambda c: R.ignored(c, [])) is False
    assert R.parse_ignore("   ") is None and R.parse_ignore("\\#x")["regex"].startswith("^(?:.*/)?")


def test_attributes(spark):
    rules = R.parse_attributes("*.png binary\n*.txt text=auto -diff\na.txt !diff\n[attr]mine foo -bar\n*.m mine\n")
    at = lambda p, n: one(spark, p, lambda c: R.attribute(c, n, rules))
    assert at("x.png", "diff") == "unset" and at("x.png", "binary") == "set"
    assert at("b.txt", "text") == "auto" and at("a.txt", "diff") == "unspecified"
    assert at("x.m", "foo") == "set" and at("x.m", "bar") == "unset"


def test_revision_parser():
    assert parse("HEAD~2^{/fix}^2") == [("ref", "HEAD"), ("~", 2), ("^{/", "fix"), ("^", 2)]
    assert parse("@") == [("ref", "HEAD")] and parse("v1^0")[1] == ("^", 0)
    for bad in ("", "a^3", "a@{1}", "a:b", ":/x", "a^{tree}", "a..b"):
        with pytest.raises(ValueError):
            parse(bad)
