"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_ngram_jaccard_join": "ngram_join",
    "op2_mixing": "mixing",
    "op3_token_counts": "lengths",
    "op4_toxicity": "toxicity",
    "op5_chat_formatting": "chat",
    "op6_license_scans": "licenses",
    "op7_line_dedup": "linededup",
    "op8_sharding": "sharding",
    "op9_embedding_near_dedup": "embeddings",
    "op10_decontamination": "decontam",
    "op11_fill_in_middle": "fim",
    "op12_packing": "packing",
    "op13_centroid_clustering": "centroids",
    # op7 on words instead of lines
    "passage_dedup": "passages",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
