"""All named queries of this folder."""

from meterlens.llm import (  # noqa: F401
    queries_chat,
    queries_dedup,
    queries_packing,
    queries_pipeline,
    queries_quality,
    queries_resampling,
    queries_secrets,
    queries_sketches,
    queries_tokens,
    queries_whitening,
)
from meterlens.llm.registry import ORACLES, QUERIES  # noqa: F401
