"""Column functions over reference names, refspecs, URLs and glob patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a short reference name is looked for, in order.
SEARCH = ("{}", "refs/{}", "refs/tags/{}", "refs/heads/{}", "refs/remotes/{}", "refs/remotes/{}/HEAD")


def is_branch(c: Column) -> Column:
    return c.startswith("refs/heads/")


def is_tag(c: Column) -> Column:
    return c.startswith("refs/tags/")


def is_remote(c: Column) -> Column:
    return c.startswith("refs/remotes/")


def is_note(c: Column) -> Column:
    return c.startswith("refs/notes/")


def is_peeled(c: Column) -> Column:
    return c.endswith("^{}")


def short_name(c: Column) -> Column:
    """The shortest form by the search rules: the rule with the longest prefix that matches is taken off."""
    head = F.regexp_extract(c, r"^refs/remotes/(.+)/HEAD$", 1)
    rest = F.regexp_extract(c, r"^refs/(?:tags|heads|remotes)/(.+)$", 1)
    plain = F.regexp_extract(c, r"^refs/(.+)$", 1)
    return F.when(head != "", head).when(rest != "", rest).when(plain != "", plain).otherwise(c)


def branch_name(c: Column) -> Column:
    return F.concat(F.lit("refs/heads/"), c)


def tag_name(c: Column) -> Column:
    return F.concat(F.lit("refs/tags/"), c)


def note_name(c: Column) -> Column:
    return F.concat(F.lit("refs/notes/"), c)


def remote_name(remote: Column, c: Column) -> Column:
    return F.concat(F.lit("refs/remotes/"), remote, F.lit("/"), c)


def remote_head(remote: Column) -> Column:
    return F.concat(F.lit("refs/remotes/"), remote, F.lit("/HEAD"))


def valid_name(c: Column) -> Column:
    """Whether a reference name keeps the format rules."""
    bad = (
        c.rlike(r"(^|/)\.") | c.rlike(r"\.lock(/|$)") | c.contains("..") | c.rlike(r"[\x00-\x20\x7f~^:?*\[\\]") | c.rlike(r"^/|/$|//") | c.endswith(".") | c.contains("@{") | (c == "@") | (c == "")
        | (~c.contains("/") & ~c.rlike(r"^[A-Z][A-Z_]*$"))
    )
    return ~bad


def spec_part(spec: Column, part: str) -> Column:
    """"src" or "dst" of a refspec without its force mark."""
    bare = F.regexp_replace(spec, r"^\+", "")
    return F.when(bare.contains(":"), F.regexp_extract(bare, r"^([^:]*):(.*)$", 1 if part == "src" else 2)).otherwise(bare)


def spec_force(spec: Column) -> Column:
    return spec.startswith("+")


def spec_delete(spec: Column) -> Column:
    return F.regexp_replace(spec, r"^\+", "").startswith(":")


def spec_wildcard(spec: Column) -> Column:
    return spec.contains("*")


def spec_exact(spec: Column) -> Column:
    """Whether the source is a full object id."""
    return spec_part(spec, "src").rlike("^([0-9a-f]{40}|[0-9a-f]{64})$")


def spec_valid(spec: Column) -> Column:
    """One separator at most besides the force mark, and as many ``*`` (none or one) on either side."""
    stars = lambda c: F.length(c) - F.length(F.replace(c, F.lit("*"), F.lit("")))
    src, dst = spec_part(spec, "src"), spec_part(spec, "dst")
    colons = F.length(spec) - F.length(F.replace(spec, F.lit(":"), F.lit("")))
    return (colons == 1) & (stars(src) <= 1) & (stars(src) == stars(dst)) & (dst != "")


def spec_match(spec: Column, name: Column) -> Column:
    """Whether a name is a refspec's source: equal, or of the form prefix*suffix."""
    src = spec_part(spec, "src")
    pre, post = F.substring_index(src, "*", 1), F.regexp_extract(src, r"\*(.*)$", 1)
    fits = name.startswith(pre) & name.endswith(post) & (F.length(name) >= F.length(pre) + F.length(post))
    return F.when(src.contains("*"), fits).otherwise(name == src)


def spec_dst(spec: Column, name: Column) -> Column:
    """The destination of a matched name."""
    src, dst = spec_part(spec, "src"), spec_part(spec, "dst")
    pre, post = F.substring_index(src, "*", 1), F.regexp_extract(src, r"\*(.*)$", 1)
    star = F.substring(name, F.length(pre) + 1, F.length(name) - F.length(pre) - F.length(post))
    return F.when(src.contains("*"), F.replace(dst, F.lit("*"), star)).otherwise(dst)


def spec_reverse(spec: Column) -> Column:
    """Source and destination swapped; the force mark stays."""
    return F.concat(F.when(spec_force(spec), "+").otherwise(""), spec_part(spec, "dst"), F.lit(":"), spec_part(spec, "src"))


def url_kind(url: Column) -> Column:
    """"url" with a scheme, "scp" for host:path forms, "local" else."""
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), "url").when(url.rlike(r"^(?:[^@/\\]+@)?[^:/\\\s]+:(?!\\)[^:]*.*$") & ~url.rlike(r"^[A-Za-z]:[\\/]"), "scp").otherwise("local")


def url_parts(url: Column) -> Column:
    """(kind, user, host, port, path) of a repository address."""
    kind = url_kind(url)
    full = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:([^@/]*)@)?(\[[^\]]*\]|[^/:]*)(?::(\d+))?(/.*)?$"
    scp = r"^(?:([^@/\\]+)@)?([^:/\\\s]+):(?:(\d{1,5})(?=/))?(.*)$"
    pick = lambda k: F.when(kind == "url", F.regexp_extract(url, full, k)).when(kind == "scp", F.regexp_extract(url, scp, k)).otherwise("" if k < 4 else url)
    return F.struct(kind.alias("kind"), pick(1).alias("user"), pick(2).alias("host"), pick(3).alias("port"), pick(4).alias("path"))


def glob_regex(pattern: str, separator: bool = True) -> str:
    """A glob as a regular expression for whole names: ``*``, ``?``, classes with POSIX names, escapes; ``**`` crosses separators."""
    out, i, any_one = [], 0, "[^/]" if separator else "."
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            if pattern[i : i + 2] == "**":
                j = i
                while j < len(pattern) and pattern[j] == "*":
                    j += 1
                before, after = i == 0 or pattern[i - 1] == "/", j == len(pattern) or pattern[j] == "/"
                if before and after and j < len(pattern):
                    out.append("(?:.*/)?")
                    j += 1
                else:
                    out.append(".*" if before and after else f"{any_one}*")
                i = j
                continue
            out.append(f"{any_one}*")
        elif c == "?":
            out.append(any_one)
        elif c == "[":
            j = i + 1
            if j < len(pattern) and pattern[j] in "!^":
                j += 1
            if j < len(pattern) and pattern[j] == "]":
                j += 1
            while j < len(pattern) and pattern[j] != "]":
                if pattern[j : j + 2] == "[:":
                    end = pattern.find(":]", j)
                    j = end + 1 if end > 0 else j
                j += 1 + (pattern[j : j + 1] == "\\")
            if j >= len(pattern):
                return r"(?!)"
            body = pattern[i + 1 : j]
            negate = body[:1] in ("!", "^")
            body = body[1:] if negate else body
            body = re.sub(r"\[:(\w+):\]", lambda m: {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}"}.get(m.group(1), ""), body)
            body = re.sub(r"(?<!\\)([\[&])", r"\\\1", body)
            out.append(f"[{'^' if negate else ''}{body}]" if not separator or not negate else f"[^/{body}]")
            i = j
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"
