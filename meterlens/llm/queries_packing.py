"""Query of the packing over the whole documents table."""

from __future__ import annotations

from meterlens.llm import packing
from meterlens.llm.registry import query
from meterlens.llm.tables import table


@query("op6_best_fit_packing")
def _(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"))
