"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.neighbours import nearest_of_hundredths

    return nearest_of_hundredths(read(spark, sf_dir, "embeddings"))


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.linededup import dedup_lines

    return dedup_lines(read(spark, sf_dir, "documents"), counts=True).select("doc_id", "n_lines", "n_dropped", "text")


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.mixing import score_documents

    return score_documents(read(spark, sf_dir, "documents"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marlstone.llm.bpe import encode_documents

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.ngramjoin import link_documents

    return link_documents(read(spark, sf_dir, "documents"))


def op10_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"), shards=8)


def op1_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.toxicity import toxicity_report

    return toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.secrets import find_secrets

    return find_secrets(read(spark, sf_dir, "documents"))


def op3_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.decontaminate import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.quality import quality_report

    return quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.centroids import cluster_vectors

    return cluster_vectors(read(spark, sf_dir, "embeddings"))


def op12_wavelet_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marlstone.llm.wavelet import index_documents

    return index_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marlstone.llm.crosstok import align_documents

    return align_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict:
    return {
        "op1_conv_toxicity": op1_conv_toxicity,
        "op3_seeded_alignment": op3_seeded_alignment,
        "op4_quality_rules": op4_quality_rules,
        "op2_secret_scan": op2_secret_scan,
        "op5_collision_counting": op5_collision_counting,
        "op6_fuzzy_line_dedup": op6_fuzzy_line_dedup,
        "op7_context_mixing": op7_context_mixing,
        "op8_bpe_transducer": op8_bpe_transducer,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_hash_tree_sharding": op10_hash_tree_sharding,
        "op11_centroid_clusters": op11_centroid_clusters,
        "op12_wavelet_index": op12_wavelet_index,
        "op13_token_alignment": op13_token_alignment,
    }


def _clusters_sql(clusters: int = 8, rounds: int = 10) -> str:
    """The rounds one after another; distances over exploded components would be slow, so lists are combined in place."""
    nearest = """(select p.*, arg_min(c.j, struct_pack(d := {d}, j := c.j)) as cluster, min({d}) as distance from pts p, {c} c group by all)"""
    d = "cast(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    steps = [
        """pts as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
 from embeddings where len(embedding) = 64 and list_count(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || vec_id), v) - 1 as j, v from pts qualify j < {clusters})",
    ]
    for k in range(rounds):
        steps.append(f"a{k} as materialized {nearest.format(d=d, c=f'c{k}')}")
        steps.append(
            f"""c{k + 1} as materialized (with e as (select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from a{k}),
 m as (select cluster, i, cast(sum(x) as hugeint) as s, count(*) as n from e group by cluster, i),
 q as (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from m group by cluster)
 select c.j, coalesce(q.v, c.v) as v from c{k} c left join q on q.cluster = c.j)"""
        )
    steps.append(f"last as materialized {nearest.format(d=d, c=f'c{rounds}')}")
    return (
        "with "
        + ", ".join(steps)
        + f""" select vec_id, cast(cluster as integer) as cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
 cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256 from last join c{rounds} c on c.j = cluster"""
    )


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clusters": _clusters_sql()}
