"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from webcairn.llm.conversations import OP13_SQL, op13_conversation_repair
from webcairn.llm.curriculum import OP5_SQL, op5_curriculum
from webcairn.llm.decontaminate import op4_decontaminate
from webcairn.llm.embeddings import op3_embedding_dedup
from webcairn.llm.jaccard_join import op8_jaccard_join
from webcairn.llm.lexical_search import OP11_SQL, op11_lexical_search
from webcairn.llm.quality import op7_quality
from webcairn.llm.sentence_pieces import op12_sentence_pieces
from webcairn.llm.shards import op10_sharding
from webcairn.llm.suffix_dedup import op1_suffix_dedup
from webcairn.llm.token_counts import op6_token_counts
from webcairn.llm.url_filter import op2_url_filter
from webcairn.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_url_filter,
        op3_embedding_dedup,
        op4_decontaminate,
        op5_curriculum,
        op6_token_counts,
        op7_quality,
        op8_jaccard_join,
        op9_warc,
        op10_sharding,
        op11_lexical_search,
        op12_sentence_pieces,
        op13_conversation_repair,
    )
}
ORACLE = {"op5_curriculum": OP5_SQL, "op9_warc": OP9_SQL, "op11_lexical_search": OP11_SQL, "op13_conversation_repair": OP13_SQL}
