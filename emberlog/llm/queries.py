"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from emberlog.llm import bitplanes, collocations, decontaminate, language, line_dedup, minhash, packing, pii, quality, records, simhash, substrings, url_filter

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_token_records": records.op2_token_records,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_pii_pseudonyms": pii.op6_pii_pseudonyms,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_centroid_clusters": bitplanes.op12_centroid_clusters,
    "op13_minhash_near_dedup": minhash.op13_minhash_near_dedup,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op3_benchmark_decontamination": decontaminate.SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_substring_dedup": substrings.SQL,
    "op7_quality_rules": quality.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_collocations": collocations.SQL,
    "op12_centroid_clusters": bitplanes.SQL,
    "op13_minhash_near_dedup": minhash.SQL,
}
