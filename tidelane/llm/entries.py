"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import brown_lm, exact_dedup, langid, mixing, near_join, packing, quality, token_files, transport_stream, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_token_files": token_files.op3_token_files,
    "op4_transport_stream": transport_stream.op4_transport_stream,
    "op5_brown_lm": brown_lm.op5_brown_lm,
    "op6_packing": packing.op6_packing,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_near_join": near_join.op8_near_join,
    "op9_language_id": langid.op9_language_id,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
