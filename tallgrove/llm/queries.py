"""The training-data queries and their SQL."""
from __future__ import annotations

from tallgrove.llm import alignment, bpe, chat, fingerprints, langid, lmscore, merkle, mixing, ngram_join, quality, secrets, simhash, suffix_dedup

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_mix": mixing.op4_mix,
    "op5_quality": quality.op5_quality,
    "op6_chat": chat.op6_chat,
    "op7_language": langid.op7_language,
    "op8_bpe_round_trip": bpe.op8_bpe_round_trip,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_lm_score": lmscore.op10_lm_score,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_simhash": simhash.op12_simhash,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

#: DuckDB SQL for those that SQL can express.
SQL: dict[str, str] = {
    "op4_mix": mixing.SQL,
    "op5_quality": quality.SQL,
    "op6_chat": chat.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
