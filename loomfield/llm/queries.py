"""The registered queries of this subpackage, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_byte_bpe
from .decontaminate import op8_decontaminate
from .digests import op12_rare_feature_digest
from .lexical import ORACLE_SQL as LEXICAL_SQL
from .lexical import op11_reversed_search
from .licenses import op4_license_scan
from .line_quality import op3_quality_rules
from .sharding import op1_vector_packing
from .simhash import op2_simhash_bktree
from .line_templates import op9_line_templates
from .lm_trie import op6_lm_trie
from .quality_nbsvm import op10_quality_nbsvm
from .toxicity import op7_toxicity_bigru
from .variants import op13_spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_packing": op1_vector_packing,
    "op2_simhash_bktree": op2_simhash_bktree,
    "op3_quality_rules": op3_quality_rules,
    "op4_license_scan": op4_license_scan,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_lm_trie": op6_lm_trie,
    "op7_toxicity_bigru": op7_toxicity_bigru,
    "op8_decontaminate": op8_decontaminate,
    "op9_line_templates": op9_line_templates,
    "op10_quality_nbsvm": op10_quality_nbsvm,
    "op11_reversed_search": op11_reversed_search,
    "op12_rare_feature_digest": op12_rare_feature_digest,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {"op11_reversed_search": LEXICAL_SQL}
