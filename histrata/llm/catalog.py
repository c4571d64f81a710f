"""The pN queries of this subpackage, and the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import parts_for, table
from . import leaks, mojibake, names, packing, pii, repetition, seen_before

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its equivalent for DuckDB, where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_SEEN = r"""
WITH p AS (SELECT arrival, oid, lower(regexp_replace(oid, '^\s+|\s+$', '', 'g')) AS k FROM pack_entries),
h AS (SELECT DISTINCT lower(regexp_replace(oid, '^\s+|\s+$', '', 'g')) AS k FROM haves WHERE oid IS NOT NULL),
f AS (SELECT k, min(arrival) AS first FROM p WHERE k IS NOT NULL GROUP BY k),
s AS (SELECT p.arrival, coalesce(p.arrival > f.first OR h.k IS NOT NULL, false) AS seen FROM p LEFT JOIN f ON p.k = f.k LEFT JOIN h ON p.k = h.k)
"""


@query("p4_found", _SEEN + "SELECT arrival FROM s WHERE seen")
def p4_found(spark, base):
    return seen_before.seen_before(table(spark, base, "pack_entries"), table(spark, base, "haves")).where("seen").select("arrival")


@query("p4_seen", _SEEN + "SELECT arrival, seen FROM s")
def p4_seen(spark, base):
    return seen_before.seen_before(table(spark, base, "pack_entries"), table(spark, base, "haves"))


@query("p4_batches", _SEEN + "SELECT arrival, seen FROM s")
def p4_batches(spark, base):
    """The stream in four batches: each reads the sealed filters of those before it from disk, not their keys."""
    entries = table(spark, base, "pack_entries").select("arrival", "oid")
    low, high, n = entries.agg(F.min("arrival"), F.max("arrival"), F.count(F.lit(1))).first()
    cuts = [(low or 0) + k * (((high or 0) - (low or 0)) // 4 + 1) for k in range(5)]
    batches = [entries.where((F.col("arrival") >= a) & (F.col("arrival") < b)) for a, b in zip(cuts, cuts[1:])]
    return seen_before.seen_in_batches(batches, table(spark, base, "haves"), parts_for(n, seen_before.ROWS_PER_SHARD, 8))


@query("p4_error_rates")
def p4_error_rates(spark, base):
    return seen_before.error_rates(table(spark, base, "pack_entries"), table(spark, base, "haves"))


@query("p6_pack")
def p6_pack(spark, base):
    return packing.pack_documents(table(spark, base, "documents"), table(spark, base, "containers"))


@query("p6_valid", "SELECT container_id, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents) AS packed, 0 AS overfull, 0 AS needless_cuts, 0 AS broken FROM containers")
def p6_valid(spark, base):
    """Per capacity: documents, documents packed, containers above the capacity, documents cut though they fit, and documents whose pieces don't add up."""
    docs, containers = table(spark, base, "documents"), table(spark, base, "containers")
    return packing.validity(packing.pack_documents(docs, containers), docs, containers)


@query("p6_fill")
def p6_fill(spark, base):
    containers = table(spark, base, "containers")
    return packing.fill(packing.pack_documents(table(spark, base, "documents"), containers), containers)


_REPEATS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '\d', '', 'g'), '[\pL\pM_]+') AS ws FROM documents),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 3) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1 AS again FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS repeated FROM (SELECT doc_id, i, unnest([0, 1, 2, 3]) AS k FROM r WHERE again) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS words, CAST(coalesce(c.repeated, 0) AS BIGINT) AS repeated FROM w LEFT JOIN c ON c.doc_id = w.doc_id)
"""


@query("p8_found", _REPEATS + "SELECT doc_id FROM m WHERE words > 0 AND repeated * 5 >= words * 2")
def p8_found(spark, base):
    return repetition.repetitive(table(spark, base, "documents")).select("doc_id")


@query("p8_shares", _REPEATS + "SELECT doc_id, words, repeated, CASE WHEN words > 0 THEN repeated / words ELSE 0.0 END AS share FROM m")
def p8_shares(spark, base):
    return repetition.measure(table(spark, base, "documents").select("doc_id", "text")).select("doc_id", "words", "repeated", "share")


@query("p8_cutoffs")
def p8_cutoffs(spark, base):
    scored = repetition.measure(table(spark, base, "documents").select("doc_id", "doc_kind", "text"))
    return repetition.cutoffs(repetition.holdout(scored, "doc_id"), "doc_kind", repetition.SCORE, "wanted")


@query("p8_risk")
def p8_risk(spark, base):
    return repetition.risk(table(spark, base, "documents"))


@query("p7_found")
def p7_found(spark, base):
    return leaks.leaks(table(spark, base, "documents"), table(spark, base, "eval_items")).where("kind = 'text'").select("doc_id", "item_id")


@query("p7_leaks")
def p7_leaks(spark, base):
    return leaks.leaks(table(spark, base, "documents"), table(spark, base, "eval_items"))


@query("p1_found")
def p1_found(spark, base):
    return names.variants(table(spark, base, "signatures"))


@query("p1_entities")
def p1_entities(spark, base):
    return names.entities(table(spark, base, "signatures"))


@query("p3_found")
def p3_found(spark, base):
    return mojibake.damaged(table(spark, base, "commits"))


@query("p3_restored")
def p3_restored(spark, base):
    return mojibake.restored(table(spark, base, "commits"))


@query("p3_steps")
def p3_steps(spark, base):
    return mojibake.steps(table(spark, base, "commits"))


@query("p3_mappings")
def p3_mappings(spark, base):
    return mojibake.mappings(table(spark, base, "commits"))


@query("p5_found")
def p5_found(spark, base):
    return pii.kinds(table(spark, base, "commits"))


@query("p5_redacted")
def p5_redacted(spark, base):
    return pii.redacted(table(spark, base, "commits"))
