"""Queries of the training-data problems over the driver's tables, and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .clusters import cluster_vectors, describe
from .encodings import garbled
from .leaks import leaked_passages, leaks
from .mixture import mixture
from .near_duplicates import duplicate_classes, similar_pairs, similar_texts
from .neighbours import most_similar, similar_pairs as neighbour_pairs
from .repetition import repetition, repetitive
from .term_weights import characteristic, label_weights, term_weights


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _p1(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cluster_vectors(table(spark, sf_dir, "vectors"), "file_id", "vec")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1(spark, sf_dir)[0].select(F.col("id").alias("file_id"), "cluster_id")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(*_p1(spark, sf_dir)).withColumn("mean_similarity", F.round("mean_similarity", 6))


def _p2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return similar_texts(table(spark, sf_dir, "extracted"), "file_id", "text", size=3, least=0.5, least_words=20)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(*_p2(spark, sf_dir)).select(F.col("id_a").alias("file_id_a"), F.col("id_b").alias("file_id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(*_p2(spark, sf_dir)).withColumnRenamed("id", "file_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characteristic(term_weights(table(spark, sf_dir, "terms"))).select(F.col("record").alias("file_id"), "term")


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_weights(table(spark, sf_dir, "terms")).select(F.col("record").alias("file_id"), "term", "n", "total", "df", F.round("score", 6).alias("score"))


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = term_weights(table(spark, sf_dir, "terms"))
    judged = label_weights(weights, table(spark, sf_dir, "cluster_labels"), table(spark, sf_dir, "clusters"))
    return judged.withColumn("mean_score", F.round("mean_score", 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "extracted")).where("damaged").select(F.col("id").alias("file_id")).distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = garbled(table(spark, sf_dir, "extracted")).where("damaged")
    return found.select(F.col("id").alias("file_id"), "restorable", "chains", "restored")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors are queries; pairs below 0.6 don't count, so the index is enough."""
    near = most_similar(table(spark, sf_dir, "embedding_cache"), "vec_id", "vector", "model", far=False)
    return neighbour_pairs(near).select(F.col("id_a").alias("vec_id_a"), F.col("id_b").alias("vec_id_b"))


def every_fiftieth(row_id: Column) -> Column:
    """The stated query set of searches."""
    return row_id % 50 == 0


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = most_similar(table(spark, sf_dir, "embedding_cache"), "vec_id", "vector", "model", asked=every_fiftieth)
    return near.select(F.col("grp").alias("model"), F.col("id").alias("vec_id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 4).alias("similarity"), "rank")


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = most_similar(table(spark, sf_dir, "vectors"), "file_id", "vec", asked=every_fiftieth)
    return near.select(F.col("id").alias("file_id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 4).alias("similarity"), "rank")


def _p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6(spark, sf_dir).where(F.col("longest") >= 12).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_p6(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitive(repetition(table(spark, sf_dir, "documents"))).select("doc_id").distinct()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents")).withColumn("repeated_share", F.round("repeated_share", 9)).distinct()


def p8_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact counts behind p8_found, for every document."""
    return repetition(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "sequences", "distinct_sequences").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries; of each problem pN_found comes first."""
    own = (
        p1_found, p1_clusters, p2_found, p2_classes, p3_found, p3_scores, p3_labels, p4_found, p4_restored,
        p5_found, p5_neighbours, p5_files, p6_found, p6_leaks, p7_mix, p7_shares, p8_found, p8_shares, p8_sequences,
    )
    return {f.__name__: f for f in own}


WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
PAIRS = """
pairs AS (SELECT file_id, term, sum(n)::BIGINT AS n FROM (SELECT file_id, trim(lower(term)) AS term, n FROM (SELECT DISTINCT file_id, term, n FROM terms WHERE file_id IS NOT NULL AND term IS NOT NULL AND n > 0))
  WHERE term <> '' GROUP BY file_id, term),
weighted AS (SELECT file_id, term, n, (sum(n) OVER (PARTITION BY file_id))::BIGINT AS total, count(*) OVER (PARTITION BY term) AS df, (SELECT count(DISTINCT file_id) FROM pairs) AS records FROM pairs),
scored AS (SELECT *, n / total * ln((1.0 + records) / (1.0 + df)) + n / total AS score FROM weighted)"""
SHINGLES = f"""
words AS (SELECT DISTINCT file_id, {WORDS.format("text")} AS w FROM extracted WHERE text IS NOT NULL),
grams AS (SELECT DISTINCT file_id, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT file_id, w, unnest(range(1, len(w) - 1)) AS k FROM words WHERE len(w) >= 20)),
counts AS (SELECT file_id, count(*) AS n FROM grams GROUP BY file_id),
shared AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.file_id < b.file_id GROUP BY 1, 2)"""
RUNS = f"""
item_runs AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT item_id, {WORDS.format("text")} AS w FROM eval_items))),
doc_runs AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents)))"""
SEQUENCES = f"""
words AS (SELECT DISTINCT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
counted AS (SELECT doc_id, len(w)::INT AS n_words, greatest(0, len(w) - 4)::INT AS sequences, len(list_distinct(list_transform(range(1, greatest(1, len(w) - 3)), lambda k: array_to_string(w[k:k + 4], ' '))))::INT AS distinct_sequences FROM words)"""

def usable_vectors(source: str, row_id: str, vector: str, group: str = "''") -> str:
    """(id, grp, v): unit vectors in double precision, one for each id and group."""
    bad = f"len(list_filter({vector}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({vector}, lambda x: x <> 0)) > 0"
    return f"""units AS (SELECT id, grp, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM
  (SELECT {row_id} AS id, coalesce({group}, '') AS grp, max({vector})::DOUBLE[] AS v FROM {source} WHERE {row_id} IS NOT NULL AND len({vector}) = 128 AND {bad} GROUP BY ALL))"""


NEAREST = """
near AS (SELECT a.grp, a.id, b.id AS other, list_inner_product(a.v, b.v) AS similarity FROM units a JOIN units b ON a.grp = b.grp AND a.id <> b.id WHERE {which}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp, id ORDER BY round(similarity, 7) DESC, other) AS rank FROM near QUALIFY rank <= 5)"""
CLUSTERS = """
links AS (SELECT a.id AS a, b.id AS b FROM units a JOIN units b ON a.id <> b.id WHERE list_inner_product(a.v, b.v) >= 0.66),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
labels AS (SELECT a AS id, min(b) AS cluster_id FROM reached GROUP BY a),
sized AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS size FROM labels)"""
CLASSES = """
texts AS (SELECT DISTINCT file_id, w FROM words WHERE len(w) >= 20),
reps AS (SELECT w, min(file_id) AS rep, count(DISTINCT file_id) AS copies FROM texts GROUP BY w),
held AS (SELECT file_id, rep, copies FROM texts JOIN reps USING (w)),
linked AS (SELECT a, b FROM shared JOIN counts x ON x.file_id = a JOIN counts y ON y.file_id = b WHERE 2 * c >= x.n + y.n - c AND a IN (SELECT rep FROM reps) AND b IN (SELECT rep FROM reps)),
ties AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
degrees AS (SELECT a AS rep, count(*) AS links FROM ties GROUP BY a),
reached AS (SELECT a, b FROM ties UNION SELECT r.a, t.b FROM reached r JOIN ties t ON r.b = t.a),
labels AS (SELECT a AS rep, min(b) AS label FROM reached GROUP BY a)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that DuckDB can express. Problem 5 by brute force: an index has to find all of them at the small size."""
    return {
        "p1_found": f"WITH RECURSIVE {usable_vectors('vectors', 'file_id', 'vec')}, {CLUSTERS} SELECT id AS file_id, cluster_id FROM sized WHERE size >= 3",
        "p2_classes": f"WITH RECURSIVE {SHINGLES}, {CLASSES} SELECT file_id, coalesce(label, rep) AS class_id, copies, coalesce(links, 0)::BIGINT AS links FROM held LEFT JOIN degrees USING (rep) LEFT JOIN labels USING (rep) WHERE copies > 1 OR links IS NOT NULL",
        "p5_found": f"WITH {usable_vectors('embedding_cache', 'vec_id', 'vector', 'model')}, {NEAREST.format(which='true')} SELECT DISTINCT least(id, other) AS vec_id_a, greatest(id, other) AS vec_id_b FROM ranked WHERE similarity >= 0.6",
        "p5_neighbours": f"WITH {usable_vectors('embedding_cache', 'vec_id', 'vector', 'model')}, {NEAREST.format(which='a.id % 50 = 0')} SELECT grp AS model, id AS vec_id, other AS neighbour_id, round(similarity, 4) AS similarity, rank::INT AS rank FROM ranked",
        "p5_files": f"WITH {usable_vectors('vectors', 'file_id', 'vec')}, {NEAREST.format(which='a.id % 50 = 0')} SELECT id AS file_id, other AS neighbour_id, round(similarity, 4) AS similarity, rank::INT AS rank FROM ranked",
        "p2_found": f"WITH {SHINGLES} SELECT a AS file_id_a, b AS file_id_b FROM shared JOIN counts x ON x.file_id = a JOIN counts y ON y.file_id = b WHERE 2 * c >= x.n + y.n - c",
        "p3_found": f"WITH {PAIRS} SELECT file_id, term FROM scored WHERE n >= 3 AND 20 * n >= total AND df BETWEEN 3 AND 20",
        "p3_scores": f"WITH {PAIRS} SELECT file_id, term, n, total, df, round(score, 6) AS score FROM scored",
        "p3_labels": f"""WITH {PAIRS},
            wording AS (SELECT DISTINCT folder, cluster, label FROM (SELECT folder, cluster, unnest(labels) AS label FROM cluster_labels WHERE cluster >= 0 AND folder IS NOT NULL) WHERE label IS NOT NULL),
            members AS (SELECT DISTINCT folder, cluster, file_id FROM clusters WHERE cluster >= 0 AND file_id IS NOT NULL)
            SELECT w.folder, w.cluster, w.label, round(avg(s.score), 6) AS mean_score, count(s.score) AS files FROM wording w LEFT JOIN members m USING (folder, cluster)
            LEFT JOIN scored s ON s.file_id = m.file_id AND s.term = trim(lower(w.label)) GROUP BY w.folder, w.cluster, w.label""",
        "p6_found": f"WITH {RUNS} SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (g)",
        "p8_found": f"WITH {SEQUENCES} SELECT doc_id FROM counted WHERE n_words >= 50 AND 10 * (sequences - distinct_sequences) >= 3 * sequences",
        "p8_sequences": f"WITH {SEQUENCES} SELECT doc_id, n_words, sequences, distinct_sequences FROM counted",
    }
