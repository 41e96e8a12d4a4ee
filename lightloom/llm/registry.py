"""The corpus queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bisector, collocations, decontaminate, hnsw, langid, licenses, neardup, packing, quality, secrets, tokens, toxicity, warc


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_nearest_neighbours": hnsw.op1_nearest_neighbours,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_quality": quality.op3_quality,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_near_duplicates": neardup.op5_near_duplicates,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_token_counts": tokens.op7_token_counts,
        "op8_warc": warc.op8_warc,
        "op9_language_id": langid.op9_language_id,
        "op10_packing": packing.op10_packing,
        "op11_collocations": collocations.op11_collocations,
        "op12_license_scan": licenses.op12_license_scan,
        "op13_bisector_clusters": bisector.op13_bisector_clusters,
    }


def oracle_sql() -> dict:
    return {
        "op4_decontamination": decontaminate.ORACLE,
        "op8_warc": warc.ORACLE,
        "op11_collocations": collocations.ORACLE,
        "op12_license_scan": licenses.ORACLE,
        "op13_bisector_clusters": bisector.oracle(),
    }
