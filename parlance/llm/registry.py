"""The queries of this subpackage by name, and the DuckDB SQL of those that
SQL can express."""

from . import sql as _sql
from . import alignment, bpe, chat, embedding_graph, mixing, ngram_join, pii, quality, secrets, sharding, tokens, toxicity, vector_codes

QUERIES = {
    "op1_token_counts": tokens.op1,
    "op2_secret_scans": secrets.op2,
    "op3_quality_rules": quality.op3,
    "op4_ngram_jaccard_join": ngram_join.op4,
    "op5_embedding_near_dedup": embedding_graph.op5,
    "op6_bpe_codec": bpe.op6,
    "op7_chat_formatting": chat.op7,
    "op8_sharding": sharding.op8,
    "op9_toxicity": toxicity.op9,
    "op10_source_mixing": mixing.op10,
    "op11_alignment": alignment.op11,
    "op12_private_data": pii.op12,
    "op13_vector_codes": vector_codes.op13,
}

ORACLE: dict[str, str] = dict(_sql.ORACLE)
