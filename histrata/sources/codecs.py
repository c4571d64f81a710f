"""Byte formats of objects, packs, indexes and staging files: reading and writing.

Plain functions over bytes; ``readers`` wraps them as Spark data sources and sinks. Sizes and
counts in the input are checked before they are believed; malformed input raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

#: Pack codes of object kinds, magic numbers, deepest delta chain.
CODES = {"commit": 1, "tree": 2, "blob": 3, "tag": 4, "ofs-delta": 6, "ref-delta": 7}
NAMES = {v: k for k, v in CODES.items()}
PACK, IDX, REV, INDEX, GRAPH = b"PACK", b"\xfftOc", b"RIDX", b"DIRC", b"CGPH"
DEEPEST = 4095


def _new(algorithm: str):
    return hashlib.sha256() if algorithm == "sha256" else hashlib.sha1()


def width(algorithm: str) -> int:
    return 32 if algorithm == "sha256" else 20


def object_id(kind: str, content: bytes, algorithm: str = "sha1") -> str:
    h = _new(algorithm)
    h.update(f"{kind} {len(content)}\0".encode() + content)
    return h.hexdigest()


# loose objects


def read_loose(data: bytes) -> tuple[str, bytes]:
    """(kind, content) of a loose object file."""
    try:
        raw = zlib.decompress(data)
    except zlib.error as e:
        raise ValueError(f"not a loose object: {e}") from None
    head, nul, content = raw.partition(b"\0")
    kind, _, size = head.partition(b" ")
    if not nul or kind.decode("ascii", "replace") not in ("commit", "tree", "blob", "tag") or not size.isdigit() or int(size) != len(content):
        raise ValueError("bad loose object header")
    return kind.decode(), content


def write_loose(kind: str, content: bytes) -> bytes:
    return zlib.compress(f"{kind} {len(content)}\0".encode() + content)


# integers of varying length


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """A little-endian base-128 integer: (value, next position)."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad integer")
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def write_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out + bytes([value]))


def read_offset(data: bytes, at: int) -> tuple[int, int]:
    """The distance of an offset delta: big-endian base 128, each continued byte adding one."""
    value = data[at] & 127
    while data[at] & 128:
        at += 1
        if at >= len(data):
            raise ValueError("bad distance")
        value = (value + 1) << 7 | data[at] & 127
    return value, at + 1


def write_offset(value: int) -> bytes:
    out = [value & 127]
    value >>= 7
    while value:
        value -= 1
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(reversed(out))


# deltas


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The target a delta makes of its base."""
    size, at = read_varint(delta, 0)
    if size != len(base):
        raise ValueError("delta is for another base")
    want, at = read_varint(delta, at)
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            offset = length = 0
            for k in range(4):
                if op >> k & 1:
                    offset |= delta[at] << 8 * k
                    at += 1
            for k in range(3):
                if op >> (4 + k) & 1:
                    length |= delta[at] << 8 * k
                    at += 1
            length = length or 0x10000
            if offset + length > len(base):
                raise ValueError("copy beyond the base")
            out += base[offset : offset + length]
        elif op:
            if at + op > len(delta):
                raise ValueError("insert beyond the delta")
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("unknown delta instruction")
        if len(out) > want:
            raise ValueError("delta makes too much")
    if len(out) != want:
        raise ValueError("delta makes too little")
    return bytes(out)


def make_delta(base: bytes, target: bytes, block: int = 16) -> bytes:
    """A delta from base to target: copies found by blocks of the base, grown both ways, and inserts between."""
    where: dict[bytes, int] = {}
    for i in range(0, len(base) - block + 1, block):
        where.setdefault(base[i : i + block], i)
    out, pending, at = bytearray(write_varint(len(base)) + write_varint(len(target))), bytearray(), 0

    def flush() -> None:
        for i in range(0, len(pending), 127):
            part = pending[i : i + 127]
            out.append(len(part))
            out.extend(part)
        pending.clear()

    while at < len(target):
        src = where.get(target[at : at + block]) if at + block <= len(target) else None
        if src is None:
            pending.append(target[at])
            at += 1
            continue
        back = 0
        while back < len(pending) and back < src and base[src - back - 1] == pending[-1 - back]:
            back += 1
        if back:
            del pending[-back:]
        src, start = src - back, at - back
        n = back + block
        while src + n < len(base) and start + n < len(target) and base[src + n] == target[start + n]:
            n += 1
        flush()
        at = start + n
        while n:
            size = min(n, 0x10000)
            op, args = 128, bytearray()
            for k in range(4):
                if b := src >> 8 * k & 255:
                    op |= 1 << k
                    args.append(b)
            if size != 0x10000:
                for k in range(3):
                    if b := size >> 8 * k & 255:
                        op |= 16 << k
                        args.append(b)
            out.append(op)
            out += args
            src, n = src + size, n - size
    flush()
    return bytes(out)


# packs


def scan_pack(data: bytes, algorithm: str = "sha1") -> Iterator[dict]:
    """The entries of a pack in order: offset, kind, size, base_offset or base_oid, crc32, data (inflated)."""
    if data[:4] != PACK or len(data) < 12 + width(algorithm):
        raise ValueError("not a pack")
    version, count = struct.unpack(">II", data[4:12])
    if version not in (2, 3):
        raise ValueError("unknown pack version")
    h = _new(algorithm)
    h.update(data[: -width(algorithm)])
    if h.digest() != data[-width(algorithm) :]:
        raise ValueError("pack checksum differs")
    at = 12
    for _ in range(count):
        start, b = at, data[at]
        at += 1
        code, size, shift = b >> 4 & 7, b & 15, 4
        while b & 128:
            b = data[at]
            size |= (b & 127) << shift
            at, shift = at + 1, shift + 7
        if code not in NAMES:
            raise ValueError("unknown kind of entry")
        base_offset = base_oid = None
        if code == 6:
            far, at = read_offset(data, at)
            base_offset = start - far
            if far <= 0 or base_offset < 12:
                raise ValueError("bad base offset")
        elif code == 7:
            base_oid = data[at : at + width(algorithm)].hex()
            at += width(algorithm)
        z = zlib.decompressobj()
        try:
            body = z.decompress(data[at:], size + 1)
        except zlib.error as e:
            raise ValueError(f"bad entry: {e}") from None
        if len(body) != size:
            raise ValueError("entry of another size")
        if not z.eof:
            z.decompress(b"" if not z.unconsumed_tail else z.unconsumed_tail, 1)
        at = len(data) - len(z.unused_data)
        yield {"offset": start, "kind": NAMES[code], "size": size, "base_offset": base_offset, "base_oid": base_oid, "crc32": zlib.crc32(data[start:at]), "data": body}
    if at != len(data) - width(algorithm):
        raise ValueError("bytes after the last entry")


def parse_pack(data: bytes, algorithm: str = "sha1", outside: dict[str, tuple[str, bytes]] | None = None) -> list[dict]:
    """All objects of a pack with deltas resolved: offset, oid, kind, size, depth, crc32, content. ``outside`` gives bases of thin packs."""
    entries = list(scan_pack(data, algorithm))
    done: dict[int, dict] = {}
    by_oid: dict[str, dict] = {k: {"kind": v[0], "content": v[1], "depth": 0} for k, v in (outside or {}).items()}
    waiting = entries
    while waiting:
        rest = []
        for e in waiting:
            if e["kind"] in ("ofs-delta", "ref-delta"):
                base = done.get(e["base_offset"]) if e["kind"] == "ofs-delta" else by_oid.get(e["base_oid"])
                if base is None:
                    rest.append(e)
                    continue
                kind, content, depth = base["kind"], apply_delta(base["content"], e["data"]), base["depth"] + 1
                if depth > DEEPEST:
                    raise ValueError("delta chain too deep")
            else:
                kind, content, depth = e["kind"], e["data"], 0
            oid = object_id(kind, content, algorithm)
            done[e["offset"]] = by_oid[oid] = {"offset": e["offset"], "oid": oid, "kind": kind, "size": len(content), "depth": depth, "crc32": e["crc32"], "content": content}
        if len(rest) == len(waiting):
            raise ValueError("base of a delta is missing")
        waiting = rest
    return [done[e["offset"]] for e in entries]


def _entry_head(code: int, size: int) -> bytes:
    out, b, size = bytearray(), code << 4 | size & 15, size >> 4
    while size:
        out.append(b | 128)
        b, size = size & 127, size >> 7
    return bytes(out + bytes([b]))


def write_pack(objects: list[tuple[str, bytes]], algorithm: str = "sha1", deltas: bool = True, ref_deltas: bool = False, window: int = 10, depth: int = 50) -> tuple[bytes, list[tuple[str, int, int]]]:
    """A pack of (kind, content) and its index rows (oid, offset, crc32). Bases come before what is a delta of them.

    Per kind, larger objects first; a delta to one of the ``window`` before is taken if it is less than half the object.
    """
    order = sorted(range(len(objects)), key=lambda i: (CODES[objects[i][0]], -len(objects[i][1])))
    out, rows, done = bytearray(PACK + struct.pack(">II", 2, len(objects))), [], []
    for i in order:
        kind, content = objects[i]
        oid, best = object_id(kind, content, algorithm), None
        if deltas and len(content) >= 32:
            for old in done[-window:]:
                if old["kind"] == kind and old["depth"] < depth:
                    d = make_delta(old["content"], content)
                    if len(d) < len(content) // 2 and (best is None or len(d) < len(best[1])):
                        best = (old, d)
        start = len(out)
        if best and ref_deltas:
            entry = _entry_head(7, len(best[1])) + bytes.fromhex(best[0]["oid"]) + zlib.compress(best[1])
        elif best:
            entry = _entry_head(6, len(best[1])) + write_offset(start - best[0]["offset"]) + zlib.compress(best[1])
        else:
            entry = _entry_head(CODES[kind], len(content)) + zlib.compress(content)
        out += entry
        rows.append((oid, start, zlib.crc32(entry)))
        done.append({"kind": kind, "content": content, "oid": oid, "offset": start, "depth": best[0]["depth"] + 1 if best else 0})
    h = _new(algorithm)
    h.update(out)
    return bytes(out) + h.digest(), rows


# pack indexes


def write_idx(rows: list[tuple[str, int, int]], pack_checksum: bytes, algorithm: str = "sha1") -> bytes:
    """A version 2 index of (oid, offset, crc32)."""
    rows = sorted(rows)
    fan, k = [], 0
    for b in range(256):
        while k < len(rows) and int(rows[k][0][:2], 16) <= b:
            k += 1
        fan.append(k)
    large = [o for _, o, _ in rows if o >= 1 << 31]
    offsets = b"".join(struct.pack(">I", o if o < 1 << 31 else 1 << 31 | large.index(o)) for _, o, _ in rows)
    body = IDX + struct.pack(">I256I", 2, *fan) + b"".join(bytes.fromhex(o) for o, _, _ in rows) + b"".join(struct.pack(">I", c) for _, _, c in rows) + offsets + b"".join(struct.pack(">Q", o) for o in large) + pack_checksum
    h = _new(algorithm)
    h.update(body)
    return body + h.digest()


def read_idx(data: bytes, algorithm: str = "sha1") -> list[tuple[str, int, int]]:
    """(oid, offset, crc32) of a version 2 index, in id order."""
    w = width(algorithm)
    if data[:4] != IDX or data[4:8] != b"\0\0\0\2":
        raise ValueError("not a version 2 index")
    h = _new(algorithm)
    h.update(data[:-w])
    if h.digest() != data[-w:]:
        raise ValueError("index checksum differs")
    fan = struct.unpack(">256I", data[8:1032])
    n = fan[255]
    if any(a > b for a, b in zip(fan, fan[1:])) or len(data) < 1032 + n * (w + 8) + 2 * w:
        raise ValueError("bad fan-out")
    at = 1032
    ids = [data[at + i * w : at + (i + 1) * w].hex() for i in range(n)]
    at += n * w
    crcs = struct.unpack(f">{n}I", data[at : at + 4 * n])
    offsets = struct.unpack(f">{n}I", data[at + 4 * n : at + 8 * n])
    at += 8 * n
    return [(o, x if x < 1 << 31 else struct.unpack(">Q", data[at + 8 * (x & 0x7FFFFFFF) :][:8])[0], c) for o, x, c in zip(ids, offsets, crcs)]


def write_rev(rows: list[tuple[str, int, int]], pack_checksum: bytes, algorithm: str = "sha1") -> bytes:
    """The reverse index: positions in id order, listed in offset order."""
    order = sorted(range(len(rows)), key=lambda i: sorted(rows)[i][1])
    body = REV + struct.pack(">II", 1, 2 if algorithm == "sha256" else 1) + struct.pack(f">{len(rows)}I", *order) + pack_checksum
    h = _new(algorithm)
    h.update(body)
    return body + h.digest()


def read_rev(data: bytes, count: int, algorithm: str = "sha1") -> list[int]:
    w = width(algorithm)
    if data[:4] != REV or len(data) != 12 + 4 * count + 2 * w:
        raise ValueError("not a reverse index of this size")
    return list(struct.unpack(f">{count}I", data[12 : 12 + 4 * count]))


# trees, commits, tags


def read_tree(content: bytes, algorithm: str = "sha1") -> list[tuple[int, str, str]]:
    """(mode, name, oid) of a tree's entries in order."""
    out, at, w = [], 0, width(algorithm)
    while at < len(content):
        sp, nul = content.find(b" ", at), content.find(b"\0", at)
        if sp < 0 or nul < sp or nul + 1 + w > len(content):
            raise ValueError("bad tree")
        out.append((int(content[at:sp], 8), content[sp + 1 : nul].decode("utf-8", "surrogateescape"), content[nul + 1 : nul + 1 + w].hex()))
        at = nul + 1 + w
    return out


def write_tree(entries: list[tuple[int, str, str]]) -> bytes:
    """A tree of (mode, name, oid), sorted as trees are."""
    key = lambda e: (e[1] + "/" if e[0] == 0o40000 else e[1]).encode("utf-8", "surrogateescape")
    return b"".join(f"{m:o} {n}".encode("utf-8", "surrogateescape") + b"\0" + bytes.fromhex(o) for m, n, o in sorted(entries, key=key))


def read_headers(content: bytes) -> tuple[list[tuple[str, str]], str]:
    """(headers in order, message) of a commit or tag; continued header lines are joined by line breaks."""
    text = content.decode("utf-8", "surrogateescape")
    head, gap, message = text.partition("\n\n")
    if not gap and text.endswith("\n"):
        head, message = text[:-1], ""
    headers: list[tuple[str, str]] = []
    for line in head.split("\n"):
        if line.startswith(" ") and headers:
            headers[-1] = (headers[-1][0], headers[-1][1] + "\n" + line[1:])
        elif line:
            k, _, v = line.partition(" ")
            headers.append((k, v))
    return headers, message


def read_commit(content: bytes) -> dict:
    """A commit as a row: tree_oid, parents, author, committer, encoding, signature, extra_headers, message."""
    headers, message = read_headers(content)
    first = dict(reversed(headers))
    known = ("tree", "parent", "author", "committer", "encoding", "gpgsig", "gpgsig-sha256")
    if "tree" not in first:
        raise ValueError("commit without a tree")
    return {"tree_oid": first["tree"], "parents": [v for k, v in headers if k == "parent"], "author": first.get("author"), "committer": first.get("committer"), "encoding": first.get("encoding"), "signature": first.get("gpgsig"), "signature_sha256": first.get("gpgsig-sha256"), "extra_headers": [(k, v) for k, v in headers if k not in known], "message": message}


def write_commit(c: dict, signed: bool = True) -> bytes:
    """The bytes of a commit row, with or without its signatures."""
    rows = [("tree", c["tree_oid"])] + [("parent", p) for p in c.get("parents") or []] + [(k, c[k]) for k in ("author", "committer", "encoding") if c.get(k)]
    rows += list(c.get("extra_headers") or [])
    if signed:
        rows += [(k, c[n]) for k, n in (("gpgsig", "signature"), ("gpgsig-sha256", "signature_sha256")) if c.get(n)]
    return ("".join(f"{k} " + v.replace("\n", "\n ") + "\n" for k, v in rows) + "\n" + (c.get("message") or "")).encode("utf-8", "surrogateescape")


def read_tag(content: bytes) -> dict:
    headers, message = read_headers(content)
    h = dict(headers)
    if "object" not in h or "type" not in h:
        raise ValueError("bad tag")
    at = message.rfind("-----BEGIN ")
    return {"target_oid": h["object"], "target_type": h["type"], "name": h.get("tag"), "tagger": h.get("tagger"), "message": message[:at] if at >= 0 else message, "signature": message[at:] if at >= 0 else None}


def write_tag(t: dict, signed: bool = True) -> bytes:
    rows = [("object", t["target_oid"]), ("type", t["target_type"]), ("tag", t["name"])] + ([("tagger", t["tagger"])] if t.get("tagger") else [])
    return ("".join(f"{k} {v}\n" for k, v in rows) + "\n" + (t.get("message") or "") + ((t.get("signature") or "") if signed else "")).encode("utf-8", "surrogateescape")


# staging file


def read_index(data: bytes, algorithm: str = "sha1") -> list[dict]:
    """The entries of a staging file, versions 2 to 4."""
    w = width(algorithm)
    if data[:4] != INDEX:
        raise ValueError("not a staging file")
    version, count = struct.unpack(">II", data[4:12])
    if version not in (2, 3, 4):
        raise ValueError("unknown version")
    at, out, name = 12, [], b""
    for _ in range(count):
        start = at
        cs, cn, ms, mn, dev, ino, mode, uid, gid, size = struct.unpack(">10I", data[at : at + 40])
        oid = data[at + 40 : at + 40 + w].hex()
        flags = struct.unpack(">H", data[at + 40 + w : at + 42 + w])[0]
        at += 42 + w
        extra = 0
        if flags & 0x4000:
            if version < 3:
                raise ValueError("extended entry in version 2")
            extra = struct.unpack(">H", data[at : at + 2])[0]
            at += 2
        if version == 4:
            cut, at = read_offset(data, at)
            end = data.index(b"\0", at)
            name = name[: len(name) - cut] + data[at:end]
            at = end + 1
        else:
            end = data.index(b"\0", at)
            name = data[at:end]
            at = start + (end - start + 8) // 8 * 8
        out.append({"path": name.decode("utf-8", "surrogateescape"), "stage": flags >> 12 & 3, "mode": mode, "oid": oid, "size": size, "ctime": cs * 10**9 + cn, "mtime": ms * 10**9 + mn, "dev": dev, "inode": ino, "uid": uid, "gid": gid, "skip_worktree": bool(extra & 0x4000), "intent_to_add": bool(extra & 0x2000)})
    return out


def write_index(entries: list[dict], version: int = 2, algorithm: str = "sha1") -> bytes:
    """A staging file, entries sorted by path and stage."""
    es = sorted(entries, key=lambda e: (e["path"].encode("utf-8", "surrogateescape"), e.get("stage", 0)))
    out, before = bytearray(INDEX + struct.pack(">II", version, len(es))), b""
    for e in es:
        name = e["path"].encode("utf-8", "surrogateescape")
        extra = (0x4000 if e.get("skip_worktree") else 0) | (0x2000 if e.get("intent_to_add") else 0)
        if extra and version < 3:
            raise ValueError("extended flags need version 3")
        start = len(out)
        c, m = e.get("ctime", 0), e.get("mtime", 0)
        out += struct.pack(">10I", c // 10**9, c % 10**9, m // 10**9, m % 10**9, e.get("dev", 0), e.get("inode", 0), e["mode"], e.get("uid", 0), e.get("gid", 0), e.get("size", 0)) + bytes.fromhex(e["oid"])
        out += struct.pack(">H", (0x4000 if extra else 0) | e.get("stage", 0) << 12 | min(len(name), 0xFFF)) + (struct.pack(">H", extra) if extra else b"")
        if version == 4:
            k = 0
            while k < min(len(before), len(name)) and before[k] == name[k]:
                k += 1
            out += write_offset(len(before) - k) + name[k:] + b"\0"
            before = name
        else:
            out += name + b"\0" * (8 - (len(out) - start + len(name)) % 8)
    h = _new(algorithm)
    h.update(out)
    return bytes(out) + h.digest()


# commit graphs


def write_graph(commits: list[dict]) -> bytes:
    """A commit-graph file (SHA-1) of commits (oid, tree_oid, parents, generation, committer epoch)."""
    cs = sorted(commits, key=lambda c: c["oid"])
    place = {c["oid"]: i for i, c in enumerate(cs)}
    fan = struct.pack(">256I", *[sum(int(c["oid"][:2], 16) <= b for c in cs) for b in range(256)])
    ids, data, edges = b"".join(bytes.fromhex(c["oid"]) for c in cs), bytearray(), []
    for c in cs:
        p = [place[x] for x in c["parents"] if x in place]
        second = 0x70000000 if len(p) < 2 else p[1] if len(p) == 2 else 0x80000000 | len(edges)
        if len(p) > 2:
            edges += [*p[1:-1], 0x80000000 | p[-1]]
        data += bytes.fromhex(c["tree_oid"]) + struct.pack(">III", p[0] if p else 0x70000000, second, c["generation"] << 2 | c["when"] >> 32 & 3) + struct.pack(">I", c["when"] & 0xFFFFFFFF)
    chunks = [(b"OIDF", fan), (b"OIDL", ids), (b"CDAT", bytes(data))] + ([(b"EDGE", struct.pack(f">{len(edges)}I", *edges))] if edges else [])
    at, table = 8 + 12 * (len(chunks) + 1), b""
    for name, body in chunks:
        table += name + struct.pack(">Q", at)
        at += len(body)
    out = GRAPH + bytes([1, 1, len(chunks), 0]) + table + b"\0\0\0\0" + struct.pack(">Q", at) + b"".join(b for _, b in chunks)
    return out + hashlib.sha1(out).digest()


def read_graph(data: bytes) -> list[dict]:
    """The commits of a commit-graph file: oid, tree_oid, parents, generation, when."""
    if data[:4] != GRAPH or data[4] != 1 or hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise ValueError("not a commit graph")
    chunks = {}
    for k in range(data[6]):
        name, start = data[8 + 12 * k : 12 + 12 * k], struct.unpack(">Q", data[12 + 12 * k : 20 + 12 * k])[0]
        chunks[name] = (start, struct.unpack(">Q", data[24 + 12 * k : 32 + 12 * k])[0])
    part = lambda n: data[slice(*chunks[n])]
    n = struct.unpack(">I", part(b"OIDF")[-4:])[0]
    ids = [part(b"OIDL")[20 * i : 20 * i + 20].hex() for i in range(n)]
    edges = struct.unpack(f">{len(part(b'EDGE')) // 4}I", part(b"EDGE")) if b"EDGE" in chunks else ()
    out = []
    for i in range(n):
        row = part(b"CDAT")[36 * i : 36 * i + 36]
        a, b, g, t = struct.unpack(">IIII", row[20:])
        parents = [ids[a]] if a != 0x70000000 else []
        if b & 0x80000000:
            k = b & 0x7FFFFFFF
            while True:
                parents.append(ids[edges[k] & 0x7FFFFFFF])
                if edges[k] & 0x80000000:
                    break
                k += 1
        elif b != 0x70000000:
            parents.append(ids[b])
        out.append({"oid": ids[i], "tree_oid": row[:20].hex(), "parents": parents, "generation": g >> 2, "when": (g & 3) << 32 | t})
    return out


# references and logs


def read_packed_refs(text: str) -> list[tuple[str, str, str | None]]:
    """(name, oid, peeled) of a packed-refs file."""
    out: list[tuple[str, str, str | None]] = []
    for line in text.split("\n"):
        if line.startswith("^") and out:
            out[-1] = (*out[-1][:2], line[1:].strip())
        elif line and not line.startswith("#"):
            oid, _, name = line.partition(" ")
            if not name:
                raise ValueError("bad packed reference")
            out.append((name.strip(), oid, None))
    return out


def write_packed_refs(rows: list[tuple[str, str, str | None]]) -> str:
    return "# pack-refs with: peeled fully-peeled sorted \n" + "".join(f"{o} {n}\n" + (f"^{p}\n" if p else "") for n, o, p in sorted(rows))


def read_reflog(text: str) -> list[tuple[str, str, str, str]]:
    """(old_oid, new_oid, committer line, message) of a log, oldest first."""
    out = []
    for line in text.split("\n"):
        if line:
            head, _, message = line.partition("\t")
            old, new, who = head.split(" ", 2)
            out.append((old, new, who, message))
    return out


def write_reflog(rows: list[tuple[str, str, str, str]]) -> str:
    return "".join(f"{o} {n} {w}\t{m}\n" for o, n, w, m in rows)


# extensions of staging files, chains of graphs, submodules


def read_index_extensions(data: bytes, algorithm: str = "sha1") -> dict[str, list]:
    """The extensions of a staging file: TREE as (path, entries, subtrees, oid), REUC as (path, {stage: (mode, oid)}), EOIE as (offset, oid); others by size."""
    w, entries = width(algorithm), read_index(data, algorithm)
    version = struct.unpack(">I", data[4:8])[0]
    at, end = len(write_index(entries, max(version, 3) if version == 3 else version, algorithm)) - w, len(data) - w
    out: dict[str, list] = {}
    while at + 8 <= end:
        name, size = data[at : at + 4].decode("ascii", "replace"), struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if at + 8 + size > end:
            raise ValueError("extension beyond the file")
        rows: list = []
        k = 0
        if name == "TREE":
            while k < len(body):
                z = body.index(b"\0", k)
                path, rest = body[k:z].decode("utf-8", "surrogateescape"), body[z + 1 :].split(b"\n", 1)[0]
                n, sub = map(int, rest.split(b" "))
                k = z + 1 + len(rest) + 1
                oid = body[k : k + w].hex() if n >= 0 else None
                k += w if n >= 0 else 0
                rows.append((path, n, sub, oid))
        elif name == "REUC":
            while k < len(body):
                z = body.index(b"\0", k)
                path, k, modes = body[k:z].decode("utf-8", "surrogateescape"), z + 1, []
                for _ in range(3):
                    z = body.index(b"\0", k)
                    modes.append(int(body[k:z], 8))
                    k = z + 1
                stages = {}
                for s, m in enumerate(modes, 1):
                    if m:
                        stages[s] = (m, body[k : k + w].hex())
                        k += w
                rows.append((path, stages))
        elif name == "EOIE":
            rows.append((struct.unpack(">I", body[:4])[0], body[4:].hex()))
        else:
            rows.append(size)
        out[name] = rows
        at += 8 + size
    return out


def index_extension(name: str, body: bytes) -> bytes:
    return name.encode() + struct.pack(">I", len(body)) + body


def add_index_extension(data: bytes, name: str, body: bytes, algorithm: str = "sha1") -> bytes:
    """A staging file with one more extension, its checksum made anew."""
    w = width(algorithm)
    whole = data[:-w] + index_extension(name, body)
    h = _new(algorithm)
    h.update(whole)
    return whole + h.digest()


def read_graph_chain(files: list[bytes]) -> list[dict]:
    """The commits of graph files that build on each other, base first; a later file's row wins."""
    rows: dict[str, dict] = {}
    for f in files:
        for c in read_graph(f):
            rows[c["oid"]] = c
    return sorted(rows.values(), key=lambda c: c["oid"])


def submodules(rows: list[tuple]) -> list[dict]:
    """Submodules of configuration rows (section, subsection, key, ord, value): name, path, url, branch."""
    out: dict[str, dict] = {}
    for section, name, key, _, value in rows:
        if section == "submodule" and name and key in ("path", "url", "branch"):
            out.setdefault(name, {"name": name, "path": None, "url": None, "branch": None})[key] = value
    return list(out.values())
