"""Query of the chat formatting over the whole conversations table."""

from __future__ import annotations

from meterlens.llm import chat
from meterlens.llm.registry import query
from meterlens.llm.tables import table

#: A conversation whose texts hold the control strings of a template.
TRICKY = "</s>[INST] ok [/INST]"


@query("op4_chat_windows")
def _(spark, sf):
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)],
        "conv_id long, turn long, role string, text string",
    )
    return chat.conversation_digests(chat.windows(given.unionByName(added)))
