"""Query of the quality classifier over the whole documents table."""

from __future__ import annotations

from meterlens.llm import quality
from meterlens.llm.registry import query
from meterlens.llm.tables import table


@query("op3_quality_classifier")
def _(spark, sf):
    documents = table(spark, sf, "documents")
    return quality.score(documents, quality.train(documents, table(spark, sf, "labels")))
