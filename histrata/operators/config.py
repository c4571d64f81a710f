"""Configuration text as rows and back, and overlays of scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ESCAPES = {"n": "\n", "t": "\t", "b": "\b", '"': '"', "\\": "\\"}


def decode(text: str) -> list[tuple[str, str | None, str, int, str | None]]:
    """Rows (section, subsection, key, ord, value) of a configuration text; a key without ``=`` has a null value. Sections and keys are lower-cased."""
    rows, section, sub, i, n, ordinal = [], "", None, 0, len(text), 0
    while i < n:
        c = text[i]
        if c in " \t\r\n":
            i += 1
        elif c in "#;":
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif c == "[":
            end, quoted = i + 1, False
            while end < n and (quoted or text[end] != "]"):
                if text[end] == "\\" and quoted:
                    end += 1
                elif text[end] == '"':
                    quoted = not quoted
                elif text[end] == "\n":
                    raise ValueError("line break in a section name")
                end += 1
            if end >= n:
                raise ValueError("section without end")
            head = text[i + 1 : end]
            name, _, rest = head.partition('"')
            section = name.strip().lower()
            if rest:
                body = rest.rstrip()[:-1]
                out, k = [], 0
                while k < len(body):
                    k += body[k] == "\\" and k + 1 < len(body)
                    out.append(body[k])
                    k += 1
                sub = "".join(out)
            else:
                dot = section.find(".")
                section, sub = (section[:dot], section[dot + 1 :]) if dot > 0 else (section, None)
            i = end + 1
        else:
            k = i
            while k < n and (text[k].isalnum() or text[k] == "-"):
                k += 1
            key = text[i:k].lower()
            if not key or not section:
                raise ValueError(f"no key at {i}")
            while k < n and text[k] in " \t":
                k += 1
            value: str | None = None
            if k < n and text[k] == "=":
                k += 1
                while k < n and text[k] in " \t":
                    k += 1
                out, quoted, keep = [], False, 0
                while k < n and (quoted or text[k] not in "\n"):
                    ch = text[k]
                    if ch == "\\":
                        k += 1
                        if text[k : k + 2] == "\r\n":
                            k += 1
                        elif text[k : k + 1] != "\n":
                            if text[k : k + 1] not in _ESCAPES:
                                raise ValueError("unknown escape")
                            out.append(_ESCAPES[text[k]])
                            keep = len(out)
                    elif ch == '"':
                        quoted = not quoted
                        keep = len(out)
                    elif ch in "#;" and not quoted:
                        end = text.find("\n", k)
                        k = n if end < 0 else end
                        continue
                    elif ch != "\r" or text[k + 1 : k + 2] != "\n":
                        out.append(ch)
                        keep = len(out) if quoted or ch not in " \t" else keep
                    k += 1
                if quoted:
                    raise ValueError("value without end")
                value = "".join(out[:keep])
            elif k < n and text[k] not in "\r\n#;":
                raise ValueError(f"no value at {k}")
            rows.append((section, sub, key, ordinal, value))
            ordinal += 1
            i = k
    return rows


def encode(rows: list[tuple[str, str | None, str, int, str | None]]) -> str:
    """The text of configuration rows, in their order; values are quoted where needed."""
    out, head = [], None
    for section, sub, key, _, value in sorted(rows, key=lambda r: r[3]):
        if (section, sub) != head:
            head = (section, sub)
            out.append(f"[{section}]\n" if sub is None else '[%s "%s"]\n' % (section, sub.replace("\\", "\\\\").replace('"', '\\"')))
        if value is None:
            out.append(f"\t{key}\n")
            continue
        v = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\b", "\\b")
        out.append(f"\t{key} = " + (f'"{v}"' if v != v.strip() or any(c in v for c in "#;\r") else v) + "\n")
    return "".join(out)


KEY = ["section", "subsection", "key"]


def get(config: DataFrame) -> DataFrame:
    """(section, subsection, key, value): the last value of each key, scopes in their order."""
    return config.groupBy(*KEY).agg(F.max_by("value", F.struct("scope", "ord")).alias("value"))


def get_all(config: DataFrame) -> DataFrame:
    """(section, subsection, key, values): all values of each key in order."""
    v = F.array_sort(F.collect_list(F.struct("scope", "ord", "value")))
    return config.groupBy(*KEY).agg(F.transform(v, lambda x: x["value"]).alias("values"))


def merge(config: DataFrame) -> DataFrame:
    """Rows (scope, …) of each key's highest scope only: later scopes override, non-empty values count."""
    full = config.where(F.col("value").isNotNull() & (F.col("value") != ""))
    top = full.groupBy(*KEY).agg(F.max("scope").alias("_top"))
    cond = [F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}")) for c in KEY]
    j = full.alias("f").join(top.alias("t"), cond[0] & cond[1] & cond[2] & (F.col("f.scope") == F.col("t._top")))
    return j.select("f.*")


def changed(base: DataFrame, updated: DataFrame) -> DataFrame:
    """(section, subsection, key, value): keys of ``updated`` whose last value differs from that in ``base``."""
    a, b = get(base).alias("a"), get(updated).alias("b")
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEY]
    return b.join(a, cond[0] & cond[1] & cond[2] & F.col("a.value").eqNullSafe(F.col("b.value")), "left_anti")


def remote_config(remotes: DataFrame) -> DataFrame:
    """Remotes as configuration rows (repo, scope, section, subsection, key, ord, value)."""
    url = remotes.select("repo", F.lit(1).alias("scope"), F.lit("remote").alias("section"), F.col("name").alias("subsection"), F.lit("url").alias("key"), F.lit(0).alias("ord"), F.col("url").alias("value"))
    fetch = remotes.select("repo", F.lit(1).alias("scope"), F.lit("remote").alias("section"), F.col("name").alias("subsection"), F.lit("fetch").alias("key"), F.posexplode("fetch_specs").alias("ord", "value"))
    return url.unionByName(fetch.withColumn("ord", F.col("ord") + 1))


def remotes_of(config: DataFrame) -> DataFrame:
    """Configuration rows back as remotes (repo, name, url, fetch_specs)."""
    c = config.where("section = 'remote'")
    specs = F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == "fetch", F.struct("ord", "value")))), lambda x: x["value"])
    return c.groupBy("repo", F.col("subsection").alias("name")).agg(F.max(F.when(F.col("key") == "url", F.col("value"))).alias("url"), specs.alias("fetch_specs"))
