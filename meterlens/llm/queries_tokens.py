"""Queries of the token operators over the whole documents table."""

from __future__ import annotations

import public_tokenizers

from meterlens.llm import sentencepieces, token_files
from meterlens.llm.registry import query
from meterlens.llm.tables import table


@query("op2_sentencepiece")
def _(spark, sf):
    return sentencepieces.piece_digests(
        table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


@query("op8_token_files")
def _(spark, sf):
    manifest = token_files.write_token_files(
        table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return token_files.token_digests(manifest)
