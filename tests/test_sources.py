import os
import random
import tarfile
import zipfile

import pytest

from histrata.functions.runtime import Scratch
from histrata.sources import codecs as C
from histrata.sources import readers as R


def test_deltas():
    r = random.Random(1)
    for _ in range(60):
        base = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 400)))
        target = base[: r.randint(0, 200)] + bytes(r.choice(b"xyz") for _ in range(r.randint(0, 300))) + base[r.randint(0, 300) :]
        assert C.apply_delta(base, C.make_delta(base, target)) == target
    big = bytes(range(256)) * 1000
    assert C.apply_delta(big, C.make_delta(big, big + b"x")) == big + b"x"
    for bad in (b"", b"\x01", b"\x00\x01\x00", C.make_delta(b"a", b"b")[:-1]):
        with pytest.raises((ValueError, IndexError)):
            C.apply_delta(b"a", bad)


def test_texts():
    commit = {"tree_oid": "a" * 40, "parents": ["b" * 40, "c" * 40], "author": "A <a@b> 1 +0000", "committer": "A <a@b> 1 +0000", "encoding": "latin1", "signature": "-----BEGIN PGP SIGNATURE-----\nx\n-----END PGP SIGNATURE-----", "signature_sha256": None, "extra_headers": [("mergetag", "object x\ntype y")], "message": "m\n\nn\n"}
    back = C.read_commit(C.write_commit(commit))
    assert back == commit
    assert C.read_commit(C.write_commit(commit, signed=False))["signature"] is None
    tag = {"target_oid": "a" * 40, "target_type": "commit", "name": "v1", "tagger": "A <a@b> 1 +0000", "message": "m\n", "signature": "-----BEGIN SSH SIGNATURE-----\nx\n"}
    assert C.read_tag(C.write_tag(tag)) == tag
    refs = [("refs/heads/a", "1" * 40, None), ("refs/tags/b", "2" * 40, "3" * 40)]
    assert C.read_packed_refs(C.write_packed_refs(refs)) == refs
    log = [("0" * 40, "1" * 40, "A <a@b> 1 +0000", "commit: x")]
    assert C.read_reflog(C.write_reflog(log)) == log


def test_graph_file():
    ids = [f"{i:02x}" * 20 for i in range(6)]
    cs = [{"oid": ids[i], "tree_oid": "d" * 40, "parents": p, "generation": i + 1, "when": 2**33 + i} for i, p in enumerate([[], [ids[0]], [ids[0]], [ids[1], ids[2]], [ids[1], ids[2], ids[3]], [ids[3], ids[0], ids[1], ids[4]]])]
    assert C.read_graph(C.write_graph(cs)) == cs


def test_bad_bytes():
    pack, rows = C.write_pack([("blob", b"x" * 100)])
    for bad in (b"", pack[:-1], b"PACK" + pack[5:], pack[:20] + bytes([pack[20] ^ 255]) + pack[21:]):
        with pytest.raises((ValueError, IndexError)):
            C.parse_pack(bad)
    with pytest.raises(ValueError):
        C.read_idx(b"\xfftOc")
    with pytest.raises(ValueError):
        C.read_loose(b"nope")


def test_folder_through_spark(spark, tmp_path):
    R.register(spark)
    root = tmp_path / "repo" / ".git"
    (root / "refs" / "heads").mkdir(parents=True)
    (root / "logs" / "refs" / "heads").mkdir(parents=True)
    blobs = [(f"content {i}\n" * (5 + i)).encode() for i in range(20)]
    ids = [C.object_id("blob", b) for b in blobs]
    sub = C.write_tree([(33188, f"f{i}", ids[i]) for i in range(10)])
    tree = C.write_tree([(0o40000, "d", C.object_id("tree", sub)), (0o100755, "x", ids[11]), (0o160000, "m", "9" * 40), (0o40000, "gone", "8" * 40)])
    commit = C.write_commit({"tree_oid": C.object_id("tree", tree), "parents": [], "author": "A <a@b> 1 +0000", "committer": "A <a@b> 1 +0000", "message": "m\n"})
    tag = C.write_tag({"target_oid": C.object_id("commit", commit), "target_type": "commit", "name": "v", "tagger": "A <a@b> 1 +0000", "message": "t\n"})
    objects = [("blob", b) for b in blobs] + [("tree", sub), ("tree", tree), ("commit", commit), ("tag", tag)]
    for kind, content in objects[:3]:
        oid = C.object_id(kind, content)
        (root / "objects" / oid[:2]).mkdir(parents=True, exist_ok=True)
        (root / "objects" / oid[:2] / oid[2:]).write_bytes(C.write_loose(kind, content))
    rows = [(C.object_id(k, c), k, len(c), bytearray(c), None, None, 0) for k, c in objects[3:]]
    spark.createDataFrame(rows, R.OBJECTS).coalesce(2).write.format("vcs_objects").mode("append").save(str(tmp_path / "repo"))
    got = spark.read.format("vcs_objects").load(str(tmp_path / "repo"))
    assert {(r["oid"], bytes(r["content"])) for r in got.collect()} == {(C.object_id(k, c), c) for k, c in objects}
    assert os.path.exists(root / "objects" / "info" / "packs")
    s = Scratch(spark, "test")
    entries = s.save(R.tree_entries_of(got))
    files = R.files_of(entries, R.commits_of(got).select("tree_oid").withColumnRenamed("tree_oid", "root_tree"), s).collect()
    assert {(r["path"], r["oid"]) for r in files if r["oid"]} == {(f"d/f{i}", ids[i]) for i in range(10)} | {("x", ids[11])}
    assert [r["path"] for r in files if r["oid"] is None] == ["gone/"]
    assert R.tags_of(got).first()["target_oid"] == C.object_id("commit", commit)
    (root / "HEAD").write_text("ref: refs/heads/main\n")
    (root / "refs" / "heads" / "main").write_text("1" * 40 + "\n")
    (root / "packed-refs").write_text(C.write_packed_refs([("refs/heads/main", "2" * 40, None), ("refs/tags/v", "3" * 40, "4" * 40)]))
    (root / "logs" / "refs" / "heads" / "main").write_text(C.write_reflog([("0" * 40, "1" * 40, "A <a@b> 1 +0000", "x")]))
    (root / "index").write_bytes(C.write_index([{"path": "x", "mode": 33188, "oid": ids[0], "size": 3}]))
    load = lambda f: spark.read.format(f).load(str(tmp_path / "repo")).collect()
    assert {(r["name"], r["oid"] or r["target"]) for r in load("vcs_refs")} == {("HEAD", "refs/heads/main"), ("refs/heads/main", "1" * 40), ("refs/tags/v", "3" * 40)}
    assert [r["ref_name"] for r in load("vcs_reflog")] == ["refs/heads/main"]
    assert [r["path"] for r in load("vcs_index")] == ["x"]
    content = got.select("oid", "content")
    out = spark.createDataFrame([(r["path"], r["mode"], r["oid"]) for r in files if r["oid"]], "path string, mode int, oid string").join(content, "oid")
    assert R.write_archive(out, str(tmp_path / "a.tar"), "tar", "p/", comment="c") == 11
    with tarfile.open(tmp_path / "a.tar") as t:
        assert t.extractfile("p/d/f3").read() == blobs[3] and t.getmember("p/x").mode == 0o755
    R.write_archive(out, str(tmp_path / "a.zip"), "zip")
    assert zipfile.ZipFile(tmp_path / "a.zip").read("d/f4") == blobs[4]


def test_index_extensions_and_chains():
    base = C.write_index([{"path": f"d/{i}", "mode": 33188, "oid": "%040x" % i} for i in range(3)])
    tree = b"\x003 1\n" + bytes(20) + b"d\0-1 0\n"
    more = C.add_index_extension(C.add_index_extension(base, "TREE", tree), "REUC", b"d/1\x00100644\x000\x00100755\x00" + b"\x01" * 20 + b"\x02" * 20)
    got = C.read_index_extensions(more)
    assert got["TREE"] == [("", 3, 1, "0" * 40), ("d", -1, 0, None)]
    assert got["REUC"] == [("d/1", {1: (33188, "01" * 20), 3: (33261, "02" * 20)})]
    assert len(C.read_index(more)) == 3
    a = {"oid": "aa" * 20, "tree_oid": "d" * 40, "parents": [], "generation": 1, "when": 5}
    b = {"oid": "bb" * 20, "tree_oid": "e" * 40, "parents": [], "generation": 1, "when": 6}
    assert C.read_graph_chain([C.write_graph([a]), C.write_graph([b])]) == [a, b]
    from histrata.operators.config import decode

    assert C.submodules(decode('[submodule "x"]\n\tpath = p\n\turl = ../u\n')) == [{"name": "x", "path": "p", "url": "../u", "branch": None}]
