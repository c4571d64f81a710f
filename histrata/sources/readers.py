"""Spark data sources over repository folders, sinks, and decoding of object tables.

``register(spark)`` makes the formats known; ``spark.read.format("vcs_objects").load(folder)``
reads loose and packed objects. One partition is one pack or one group of loose files; packs are
the unit of work because deltas refer within a pack.
"""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import codecs as C

OBJECTS = "oid string, type string, size bigint, content binary, pack string, pack_offset bigint, depth int"


class Part(InputPartition):
    def __init__(self, kind: str, path: str):
        self.kind, self.path = kind, path


def _root(options: dict) -> str:
    path = options.get("path") or ""
    inner = os.path.join(path, ".git")
    return inner if os.path.isdir(inner) else path


class ObjectsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = _root(options)
        self.algorithm = options.get("algorithm", "sha1")

    def partitions(self) -> list[Part]:
        base = os.path.join(self.root, "objects")
        out = []
        for name in sorted(os.listdir(base)) if os.path.isdir(base) else []:
            if len(name) == 2 and all(c in "0123456789abcdef" for c in name):
                out.append(Part("loose", os.path.join(base, name)))
        packs = os.path.join(base, "pack")
        out += [Part("pack", os.path.join(packs, n)) for n in (sorted(os.listdir(packs)) if os.path.isdir(packs) else []) if n.endswith(".pack")]
        return out or [Part("none", "")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.kind == "loose":
            for name in sorted(os.listdir(partition.path)):
                with open(os.path.join(partition.path, name), "rb") as f:
                    kind, content = C.read_loose(f.read())
                yield os.path.basename(partition.path) + name, kind, len(content), content, None, None, 0
        elif partition.kind == "pack":
            with open(partition.path, "rb") as f:
                data = f.read()
            pack = os.path.basename(partition.path)[: -len(".pack")]
            for o in C.parse_pack(data, self.algorithm):
                yield o["oid"], o["kind"], o["size"], o["content"], pack, o["offset"], o["depth"]


class Packed(WriterCommitMessage):
    def __init__(self, name: str, rows: int):
        self.name, self.rows = name, rows


class PackWriter(DataSourceWriter):
    """Every partition becomes one pack with its index and reverse index."""

    def __init__(self, options: dict):
        self.root, self.algorithm = _root(options), options.get("algorithm", "sha1")
        self.ref_deltas = options.get("refdeltas", "false") == "true"

    def write(self, rows: Iterator) -> Packed:
        seen: dict[str, tuple[str, bytes]] = {}
        for r in rows:
            seen.setdefault(r["oid"], (r["type"], bytes(r["content"])))
        if not seen:
            return Packed("", 0)
        pack, index = C.write_pack(list(seen.values()), self.algorithm, ref_deltas=self.ref_deltas)
        end = pack[-C.width(self.algorithm) :]
        folder = os.path.join(self.root, "objects", "pack")
        os.makedirs(folder, exist_ok=True)
        name = f"pack-{end.hex()}"
        for suffix, data in ((".pack", pack), (".idx", C.write_idx(index, end, self.algorithm)), (".rev", C.write_rev(index, end, self.algorithm))):
            tmp = os.path.join(folder, f".{name}{suffix}.{os.getpid()}")
            with open(tmp, "wb") as f:
                f.write(data)
            os.replace(tmp, os.path.join(folder, name + suffix))
        return Packed(name, len(seen))

    def commit(self, messages: list) -> None:
        folder = os.path.join(self.root, "objects", "info")
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, "packs"), "w") as f:
            f.writelines(f"P {m.name}.pack\n" for m in messages if m and m.name)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.name:
                for suffix in (".pack", ".idx", ".rev"):
                    p = os.path.join(self.root, "objects", "pack", m.name + suffix)
                    if os.path.exists(p):
                        os.remove(p)


class ObjectsSource(DataSource):
    """Loose and packed objects of a repository folder; writing makes packs."""

    @classmethod
    def name(cls) -> str:
        return "vcs_objects"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema) -> ObjectsReader:
        return ObjectsReader(self.options)

    def writer(self, schema, overwrite: bool) -> PackWriter:
        return PackWriter(self.options)


class RefsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = _root(options)

    def read(self, partition) -> Iterator[tuple]:
        loose: dict[str, str] = {}
        for name in ("HEAD",):
            p = os.path.join(self.root, name)
            if os.path.isfile(p):
                with open(p) as f:
                    loose[name] = f.read().strip()
        for folder, _, files in os.walk(os.path.join(self.root, "refs")):
            for n in files:
                p = os.path.join(folder, n)
                with open(p) as f:
                    loose[os.path.relpath(p, self.root).replace(os.sep, "/")] = f.read().strip()
        for name, value in sorted(loose.items()):
            if value.startswith("ref:"):
                yield name, "symbolic", None, value[4:].strip(), None
            else:
                yield name, "hash", value, None, None
        packed = os.path.join(self.root, "packed-refs")
        if os.path.isfile(packed):
            with open(packed) as f:
                for name, oid, peeled in C.read_packed_refs(f.read()):
                    if name not in loose:
                        yield name, "hash", oid, None, peeled


class RefsSource(DataSource):
    """References of a repository folder: loose ones, and packed ones that no loose one shadows."""

    @classmethod
    def name(cls) -> str:
        return "vcs_refs"

    def schema(self) -> str:
        return "name string, kind string, oid string, target string, peeled string"

    def reader(self, schema) -> RefsReader:
        return RefsReader(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = _root(options)

    def partitions(self) -> list[Part]:
        base = os.path.join(self.root, "logs")
        out = [Part("log", os.path.join(d, n)) for d, _, files in os.walk(base) for n in sorted(files)]
        return out or [Part("none", "")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.kind == "log":
            name = os.path.relpath(partition.path, os.path.join(self.root, "logs")).replace(os.sep, "/")
            with open(partition.path, encoding="utf-8", errors="surrogateescape") as f:
                for seq, (old, new, who, message) in enumerate(C.read_reflog(f.read())):
                    yield name, seq, old, new, who, message


class ReflogSource(DataSource):
    """Reference logs of a repository folder, oldest first."""

    @classmethod
    def name(cls) -> str:
        return "vcs_reflog"

    def schema(self) -> str:
        return "ref_name string, seq bigint, old_oid string, new_oid string, committer string, message string"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


class IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.algorithm = _root(options), options.get("algorithm", "sha1")

    def read(self, partition) -> Iterator[tuple]:
        p = os.path.join(self.root, "index")
        if os.path.isfile(p):
            with open(p, "rb") as f:
                for e in C.read_index(f.read(), self.algorithm):
                    yield e["path"], e["stage"], e["mode"], e["oid"], e["size"], e["skip_worktree"], e["intent_to_add"]


class IndexSource(DataSource):
    """The staging file of a repository folder."""

    @classmethod
    def name(cls) -> str:
        return "vcs_index"

    def schema(self) -> str:
        return "path string, stage int, mode bigint, oid string, size bigint, skip_worktree boolean, intent_to_add boolean"

    def reader(self, schema) -> IndexReader:
        return IndexReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats vcs_objects, vcs_refs, vcs_reflog and vcs_index known to a session."""
    for source in (ObjectsSource, RefsSource, ReflogSource, IndexSource):
        spark.dataSource.register(source)


COMMITS = "oid string, tree_oid string, parents array<string>, author string, committer string, encoding string, signature string, message string, error string"


def commits_of(objects: DataFrame) -> DataFrame:
    """Decoded commits of an object table; what cannot be decoded keeps its id and the reason."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for oid, content in zip(pdf["oid"], pdf["content"]):
                try:
                    c = C.read_commit(bytes(content))
                    rows.append((oid, c["tree_oid"], c["parents"], c["author"], c["committer"], c["encoding"], c["signature"], c["message"], None))
                except (ValueError, IndexError) as e:
                    rows.append((oid, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in COMMITS.split(", ")])

    return objects.where("type = 'commit'").select("oid", "content").mapInPandas(run, COMMITS)


def tree_entries_of(objects: DataFrame) -> DataFrame:
    """(tree_oid, ord, name, mode, oid) of all trees of an object table."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(t, i, n, m, o) for t, content in zip(pdf["oid"], pdf["content"]) for i, (m, n, o) in enumerate(C.read_tree(bytes(content), "sha256" if len(t) == 64 else "sha1"))]
            yield pd.DataFrame(rows, columns=["tree_oid", "ord", "name", "mode", "oid"])

    return objects.where("type = 'tree'").select("oid", "content").mapInPandas(run, "tree_oid string, ord int, name string, mode int, oid string")


def tags_of(objects: DataFrame) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for oid, content in zip(pdf["oid"], pdf["content"]):
                t = C.read_tag(bytes(content))
                rows.append((oid, t["name"], t["tagger"], t["message"], t["signature"], t["target_type"], t["target_oid"]))
            yield pd.DataFrame(rows, columns=["oid", "name", "tagger", "message", "signature", "target_type", "target_oid"])

    return objects.where("type = 'tag'").select("oid", "content").mapInPandas(run, "oid string, name string, tagger string, message string, signature string, target_type string, target_oid string")


def files_of(entries: DataFrame, roots: DataFrame, scratch, depth: int = 1024) -> DataFrame:
    """(root_tree, path, mode, oid): files below root trees (root_tree); folders are opened level by level, submodules passed over.

    A subtree that is missing shows as a row with a null oid.
    """
    level = roots.select("root_tree", F.lit("").alias("prefix"), F.col("root_tree").alias("tree")).distinct()
    out = None
    for _ in range(depth):
        if level.isEmpty():
            break
        rows = scratch.save(level.join(entries.withColumnRenamed("tree_oid", "tree"), "tree", "left").select("root_tree", F.concat("prefix", F.coalesce("name", F.lit(""))).alias("path"), "mode", "oid"))
        files = rows.where("mode IS NULL OR mode NOT IN (16384, 57344)")
        out = files if out is None else out.unionByName(files)
        level = scratch.save(rows.where("mode = 16384").select("root_tree", F.concat("path", F.lit("/")).alias("prefix"), F.col("oid").alias("tree")))
    return out


def write_archive(files: DataFrame, path: str, kind: str = "tar", prefix: str = "", when: int = 0, comment: str | None = None) -> int:
    """Files (path, mode, content) as a tar, tgz or zip archive, sorted by path; returns how many. Streams rows to the driver one by one."""
    rows = files.select("path", "mode", "content").orderBy("path").toLocalIterator()
    n = 0
    if kind == "zip":
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            if comment:
                z.comment = comment.encode()
            for r in rows:
                info = zipfile.ZipInfo(prefix + r["path"], (1980, 1, 1, 0, 0, 0))
                info.external_attr = (0o755 if r["mode"] == 0o100755 else 0o644) << 16
                z.writestr(info, bytes(r["content"] or b""))
                n += 1
        return n
    with tarfile.open(path, "w:gz" if kind == "tgz" else "w", format=tarfile.PAX_FORMAT, pax_headers={"comment": comment} if comment else {}) as t:
        for r in rows:
            info = tarfile.TarInfo(prefix + r["path"])
            body = bytes(r["content"] or b"")
            info.mtime = when
            if r["mode"] == 0o120000:
                info.type, info.linkname = tarfile.SYMTYPE, body.decode("utf-8", "surrogateescape")
                t.addfile(info)
            else:
                info.size, info.mode = len(body), 0o755 if r["mode"] == 0o100755 else 0o644
                t.addfile(info, io.BytesIO(body))
            n += 1
    return n
