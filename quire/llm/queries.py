"""The queries of this subpackage and, where SQL can say the same, their SQL."""

import corpus_pipeline
from quire.llm import exact_dedup, hilbert, minhash, mixing, packing, pii, quality, substring_dedup, token_counts, url_filter

QUERIES = {
    "op1_quality": quality.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_minhash": minhash.query,
    "op4_url_filter": url_filter.query,
    "op5_token_counts": token_counts.query,
    "op6_hilbert_ann": hilbert.query,
    "op7_pii": pii.query,
    "op8_mixing": mixing.query,
    "op9_packing": packing.query,
    "op10_substring_dedup": substring_dedup.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op2_exact_dedup": exact_dedup.SQL, "op3_minhash": minhash.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
