"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from quernstone.llm import annulus, chunkprint, collocations, columndedup, decontaminate, divergence, fmdedup, linedup, packing, quality, secrets, simhash, toxicity


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_packing": packing.op3_packing,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_secrets": secrets.op5_secrets,
        "op6_simhash": simhash.op6_simhash,
        "op7_line_dedup": linedup.op7_line_dedup,
        "op8_chunk_fingerprints": chunkprint.op8_chunk_fingerprints,
        "op9_suffix_dedup": columndedup.op9_suffix_dedup,
        "op10_substring_dedup": fmdedup.op10_substring_dedup,
        "op11_collocations": collocations.op11_collocations,
        "op12_quality_rules": divergence.op12_quality_rules,
        "op13_centroid_clusters": annulus.op13_centroid_clusters,
    }


def oracle_sql() -> dict:
    return {"op11_collocations": collocations.SQL, "op12_quality_rules": divergence.SQL, "op13_centroid_clusters": annulus.SQL}
