"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chunks, impact, mixing, packing, pii, quality, secrets, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": ann.query,
    "op2_credential_links": secrets.query,
    "op3_impact_topk": impact.query,
    "op4_chunk_repeats": chunks.query,
    "op5_toxicity": toxicity.query,
    "op6_quality": quality.query,
    "op7_packing": packing.query,
    "op8_simhash": simhash.query,
    "op9_pii_sanitise": pii.query,
    "op10_pareto_mix": mixing.query,
}

#: DuckDB SQL where SQL can express the query: the others rest on hashes, fitted models or a tokenizer.
ORACLE_SQL: dict[str, str] = {
    "op3_impact_topk": """
        WITH clean AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: x::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
        ),
        impacts AS (SELECT vec_id, list_transform(x, lambda v: floor(64 * v)) AS z FROM clean),
        scores AS (
            SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.z, r.z)::BIGINT AS score
            FROM impacts q JOIN impacts r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
}
