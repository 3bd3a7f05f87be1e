"""The registered queries of this subpackage: each reads its whole table and returns its full result."""

from __future__ import annotations

from . import lexical, minhash, mixing, shared, suffix_dedup, topk_join, url_filters, vector_codes
from .bpe import op8_bpe
from .language_id import op7_language_id
from .lexical import op12_lexical_search
from .minhash import op1_minhash_dedup
from .mixing import op11_source_mix
from .packing import op9_packing
from .paragraph_dedup import op10_paragraph_dedup
from .quality_classifier import op6_quality_classifier
from .quality_rules import op3_quality_rules
from .suffix_dedup import op4_suffix_dedup
from .topk_join import op2_topk_search
from .url_filters import op5_url_filters
from .vector_codes import op13_vector_codes


def _over(table: str, operator):
    return lambda spark, sf_dir: operator(shared.table(spark, sf_dir, table))


QUERIES = {
    "op1_minhash_dedup": _over("documents", op1_minhash_dedup),
    "op2_topk_search": _over("embeddings", op2_topk_search),
    "op3_quality_rules": _over("documents", op3_quality_rules),
    "op4_suffix_dedup": _over("documents", op4_suffix_dedup),
    "op5_url_filters": _over("pages", op5_url_filters),
    "op6_quality_classifier": lambda spark, sf_dir: op6_quality_classifier(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")),
    "op7_language_id": _over("documents", op7_language_id),
    "op8_bpe": _over("documents", op8_bpe),
    "op9_packing": _over("documents", op9_packing),
    "op10_paragraph_dedup": _over("documents", op10_paragraph_dedup),
    "op11_source_mix": _over("documents", op11_source_mix),
    "op12_lexical_search": lambda spark, sf_dir: op12_lexical_search(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark")),
    "op13_vector_codes": _over("embeddings", op13_vector_codes),
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": minhash.ORACLE,
    "op2_topk_search": topk_join.ORACLE,
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op5_url_filters": url_filters.ORACLE,
    "op11_source_mix": mixing.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
