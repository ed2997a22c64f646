"""Query of the secret scan over the whole documents table."""

from __future__ import annotations

from meterlens.llm import secret_scan
from meterlens.llm.registry import query
from meterlens.llm.tables import table


@query("op7_secret_scan")
def _(spark, sf):
    return secret_scan.findings(table(spark, sf, "documents"))
