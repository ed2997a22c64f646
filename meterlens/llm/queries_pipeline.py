"""Query of the corpus pipeline."""

from __future__ import annotations

import corpus_pipeline

from meterlens.llm.registry import query


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def _(spark, sf):
    return corpus_pipeline.run(spark, sf)
