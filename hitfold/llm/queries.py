"""The operators as queries over the given tables, and SQL where it can express them."""

from __future__ import annotations

from hitfold.llm import lines, merkle, warc
from hitfold.llm.align import op12_token_alignment
from hitfold.llm.digests import op5_document_fingerprints
from hitfold.llm.idfile import op4_token_ids
from hitfold.llm.katz import op9_lm_scoring
from hitfold.llm.language import op6_language_id
from hitfold.llm.lines import op3_line_dedup
from hitfold.llm.media import op7_media_chunks
from hitfold.llm.merkle import op13_merkle_manifest
from hitfold.llm.minhash import op2_near_duplicates
from hitfold.llm.mixing import op10_mix_sources
from hitfold.llm.packing import op1_best_fit_packing
from hitfold.llm.secrets import op8_secret_scan
from hitfold.llm.warc import op11_warc_segments

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_ids": op4_token_ids,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_language_id": op6_language_id,
    "op7_media_chunks": op7_media_chunks,
    "op8_secret_scan": op8_secret_scan,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_mix_sources": op10_mix_sources,
    "op11_warc_segments": op11_warc_segments,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE: dict[str, str] = {**lines.ORACLE, **merkle.ORACLE, **warc.ORACLE}
