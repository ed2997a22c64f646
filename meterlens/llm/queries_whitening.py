"""Query of the embedding whitening over the whole embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlens.llm import whitening
from meterlens.llm.registry import query
from meterlens.llm.tables import table


@query("op12_embedding_whitening")
def _(spark, sf):
    white = whitening.whiten(table(spark, sf, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))
