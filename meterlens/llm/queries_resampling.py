"""Query of the importance resampling over the whole documents table."""

from __future__ import annotations

from meterlens.llm import resampling
from meterlens.llm.registry import query
from meterlens.llm.tables import table


@query("op11_importance_resampling")
def _(spark, sf):
    drawn = resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
