"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from convrecall.llm import audit, chat, lexical, linededup, mixing, urls
from convrecall.llm.ann import op4_cross_polytope
from convrecall.llm.bpe import op7_byte_bpe
from convrecall.llm.langid import op9_language
from convrecall.llm.simhash import op8_simhash
from convrecall.llm.suffix import op10_suffix_dedup
from convrecall.llm.tokenstore import op12_token_store
from convrecall.llm.vecdedup import op6_embedding_dedup


def queries() -> dict:
    made = (
        chat.op1_chat_format, linededup.op2_line_dedup, mixing.op3_mixture, op4_cross_polytope, urls.op5_url_filter, op6_embedding_dedup,
        op7_byte_bpe, op8_simhash, op9_language, op10_suffix_dedup, audit.op11_filter_audit, op12_token_store, lexical.op13_lexical_search,
    )
    return {f.__name__: f for f in made} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {
        "op1_chat_format": chat.OP1_SQL, "op2_line_dedup": linededup.OP2_SQL, "op3_mixture": mixing.OP3_SQL, "op5_url_filter": urls.OP5_SQL,
        "op11_filter_audit": audit.OP11_SQL, "op13_lexical_search": lexical.OP13_SQL,
    }
