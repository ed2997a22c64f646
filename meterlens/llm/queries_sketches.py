"""Query of the document fingerprints over the whole documents table."""

from __future__ import annotations

from meterlens.llm import sketches
from meterlens.llm.registry import query
from meterlens.llm.tables import table


@query("op5_fingerprints")
def _(spark, sf):
    return sketches.fingerprint_digests(table(spark, sf, "documents"))
