"""All queries of this subpackage, the pipeline included."""

import corpus_pipeline

from . import (  # noqa: F401
    language_id,
    lexical,
    mixing,
    prefix_trie,
    quality_knn,
    quality_rules,
    registry,
    shards,
    simhash,
    tier_packing,
    token_matrices,
    topk,
    toxicity_fm,
    warc,
)

registry.query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
