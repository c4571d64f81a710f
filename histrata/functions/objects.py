"""Column functions over object ids, kinds, modes, signatures and contents. All stay in the JVM; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Object kinds with their codes in packs, and tree entry modes (octal).
KINDS = {"commit": 1, "tree": 2, "blob": 3, "tag": 4, "ofs-delta": 6, "ref-delta": 7}
DIR, REGULAR, DEPRECATED, EXECUTABLE, SYMLINK, SUBMODULE = 0o40000, 0o100644, 0o100664, 0o100755, 0o120000, 0o160000
#: Bytes looked at for a NUL when a content is sniffed.
SNIFF = 8000


def object_id(kind: str | Column, content: Column, algorithm: str = "sha1") -> Column:
    """The id of an object: hash of ``<kind> <size> NUL <content>``; ``content`` is binary, or text taken as UTF-8."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    body = content.cast("binary")
    whole = F.concat(F.encode(F.concat(kind, F.lit(" "), F.octet_length(body).cast("string")), "UTF-8"), F.unhex(F.lit("00")), body)
    return F.sha1(whole) if algorithm == "sha1" else F.sha2(whole, 256)


def is_hash(c: Column) -> Column:
    """Whether a text is a full id: 40 or 64 hexadecimal digits."""
    return c.rlike("^([0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")


def is_zero(c: Column) -> Column:
    """Whether an id is the zero id, "no object"."""
    return c.rlike("^0+$")


def has_prefix(c: Column, prefix: Column | str) -> Column:
    """Whether an id begins with a prefix of any number of digits, case disregarded."""
    return F.lower(c).startswith(F.lower(F.lit(prefix) if isinstance(prefix, str) else prefix))


def kind_code(c: Column) -> Column:
    """The code of an object kind; null for what is no kind."""
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.element_at(table, c)


def is_delta(c: Column) -> Column:
    return c.isin("ofs-delta", "ref-delta")


def parse_mode(c: Column) -> Column:
    """A mode from octal text; null for other text."""
    return F.when(c.rlike("^[0-7]+$"), F.conv(c, 8, 10).cast("int"))


def mode_text(c: Column) -> Column:
    """A mode as octal text, as trees write it (directories have five digits)."""
    return F.when(c == DIR, F.lit("40000")).otherwise(F.conv(c.cast("string"), 10, 8))


def is_file(c: Column) -> Column:
    """Regular, deprecated regular, executable or symbolic link."""
    return c.isin(REGULAR, DEPRECATED, EXECUTABLE, SYMLINK)


def is_regular(c: Column) -> Column:
    return c.isin(REGULAR, DEPRECATED)


def is_malformed(c: Column) -> Column:
    return ~c.isin(DIR, REGULAR, DEPRECATED, EXECUTABLE, SYMLINK, SUBMODULE)


def canonical_mode(c: Column) -> Column:
    """The mode as compared: the deprecated regular mode counts as regular."""
    return F.when(c == DEPRECATED, REGULAR).otherwise(c)


def os_mode(c: Column) -> Column:
    """Permission bits and kind letter of a mode: (d|-|l|m, permissions)."""
    kind = F.when(c == DIR, "d").when(c == SYMLINK, "l").when(c == SUBMODULE, "m").otherwise("-")
    bits = F.when(c == EXECUTABLE, 0o755).when(is_regular(c), 0o644).when(c.isin(DIR, SYMLINK), 0o777).otherwise(0o777)
    return F.struct(kind.alias("kind"), bits.alias("permissions"))


def is_binary(content: Column) -> Column:
    """Whether a NUL lies within the first bytes of a content."""
    return F.contains(F.substring(content.cast("binary"), 1, SNIFF), F.unhex(F.lit("00")))


def stat(text: Column) -> Column:
    """Counts of NUL, lone CR, lone LF and CRLF in a text."""
    count = lambda c, s: (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / len(s)
    crlf = count(text, "\r\n").cast("bigint")
    return F.struct(count(text, "\0").cast("bigint").alias("nul"), (count(text, "\r").cast("bigint") - crlf).alias("lone_cr"), (count(text, "\n").cast("bigint") - crlf).alias("lone_lf"), crlf.alias("crlf"))


def to_lf(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def to_crlf(text: Column) -> Column:
    """LF to CRLF; a CRLF that is there stays."""
    return F.regexp_replace(text, r"(?<!\r)\n", "\r\n")


def lines(text: Column) -> Column:
    """The lines of a text; a final line break makes no empty last line, and an empty text has none."""
    parts = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def signature_text(name: Column, email: Column, when: Column, tz_min: Column) -> Column:
    """``Name <email> epoch ±hhmm``; missing parts are empty or zero."""
    tz = F.coalesce(tz_min, F.lit(0))
    zone = F.concat(F.when(tz < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(tz) / 60).cast("string"), 2, "0"), F.lpad((F.abs(tz) % 60).cast("string"), 2, "0"))
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" <"), F.coalesce(email, F.lit("")), F.lit("> "), F.coalesce(F.unix_timestamp(when), F.lit(0)).cast("string"), F.lit(" "), zone)


def parse_signature(line: Column) -> Column:
    """(name, email, epoch, tz_min) of such a line: the e-mail lies between the last < and the last >; a malformed time leaves nulls."""
    pattern = r"^(.*)<([^<>]*)>[^<>]*$"
    tail = F.regexp_extract(line, r">\s*(-?\d+)\s+([+-]\d{4})\s*$", 0)
    zone = F.regexp_extract(line, r">\s*-?\d+\s+([+-]\d{4})\s*$", 1)
    minutes = (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
    good = tail != ""
    return F.struct(F.trim(F.regexp_extract(line, pattern, 1)).alias("name"), F.regexp_extract(line, pattern, 2).alias("email"), F.when(good, F.regexp_extract(line, r">\s*(-?\d+)\s+[+-]\d{4}\s*$", 1).cast("bigint")).alias("epoch"), F.when(good, minutes).alias("tz_min"))


def signature_kind(block: Column) -> Column:
    """The kind of a signature block by its first line: openpgp, x509, ssh, or unknown."""
    return (
        F.when(block.startswith("-----BEGIN PGP SIGNATURE-----") | block.startswith("-----BEGIN PGP MESSAGE-----"), "openpgp")
        .when(block.startswith("-----BEGIN CERTIFICATE-----") | block.startswith("-----BEGIN SIGNED MESSAGE-----"), "x509").when(block.startswith("-----BEGIN SSH SIGNATURE-----"), "ssh").otherwise("unknown")
    )


def split_signature(payload: Column) -> Column:
    """(text, signature) of a signed text: the signature begins at the last line that opens a block."""
    at = r"(?s)^(.*?)(-----BEGIN (?:PGP SIGNATURE|PGP MESSAGE|SIGNED MESSAGE|CERTIFICATE|SSH SIGNATURE)-----.*)$"
    sig = F.regexp_extract(payload, at, 2)
    return F.struct(F.when(sig != "", F.regexp_extract(payload, at, 1)).otherwise(payload).alias("text"), sig.alias("signature"))


def strip_header_signatures(raw: Column) -> Column:
    """A raw commit without its gpgsig headers and their continuation lines."""
    return F.regexp_replace(raw, r"(?m)^gpgsig(?:-sha256)? [^\n]*\n(?: [^\n]*\n)*", "")


def valid_path(path: Column) -> Column:
    """Whether no component of a path is empty, ``.``, ``..``, or an alias of the repository folder on some file system."""
    part = r"(?:^|[/\\])"
    end = r"(?:$|[/\\])"
    ignorable = "[‌‍‎‏‪-‮⁪-⁯﻿]*"
    alias = part + "(?i:" + ignorable.join(["", r"\.", "g", "i", "t", ""]) + r"|git~[0-9]+|\.git[ .]*(?::[^/\\]*)?)" + end
    return ~(path.rlike(r"^/|//|/$|^$|[\x00]") | path.rlike(part + r"\.{1,2}" + end) | path.rlike(alias))
