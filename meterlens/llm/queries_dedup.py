"""Queries of the duplicate operators over the whole documents table."""

from __future__ import annotations

from meterlens.llm import exact_dedup, jaccard, simhash, substring_dedup
from meterlens.llm.registry import query
from meterlens.llm.tables import table

EXACT = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""


@query("op1_substring_dedup")
def _(spark, sf):
    return substring_dedup.repeat_digests(table(spark, sf, "documents"))


@query("op10_exact_dedup", EXACT)
def _(spark, sf):
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


@query("op9_simhash_near_dedup")
def _(spark, sf):
    return simhash.near_groups(table(spark, sf, "documents"))


@query("op13_jaccard_join")
def _(spark, sf):
    return jaccard.jaccard_classes(table(spark, sf, "documents"))
