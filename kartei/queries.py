"""The operators over the driver's tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kartei import planted
from kartei.functions import kinds, scoring, text as T, tokens as K, vectors as V
from kartei.operators import clustering as C
from kartei.operators.ancestry import ancestry, first_report, outermost, rollup
from kartei.operators.embedding import HashedEmbedder, MarkerEmbedder, composite, encode_distinct, name_phrases
from kartei.operators.score import scores, visible, worst_first
from kartei.plans.lineage import materialise
from kartei.plans.ranking import evenly_sampled
from kartei.settings import Settings, Thresholds
from kartei.signals import Frames, leftovers, shape, time as strata, topics
from kartei.sources.ignore import compile_rule, hidden, in_ignored_folder, without_ignored
from kartei.sources.tables import excerpts, files_of, latest_files, table

MARKERS = ("report", "their", "near", "every")
MARKER = MarkerEmbedder(MARKERS)
#: Rules as they might stand in a rule file; (folder, line).
RULES = (("/srv/share", "Inbox/"), ("/home", "*.tmp"), ("/home", "*/Downloads/**"), ("/home", "scan0*"), ("/srv", "/share/**/old/"))
SCALE = 0.9
LIMITS = Thresholds.derive(SCALE, Settings())
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def written_files(spark: SparkSession, sf: str) -> DataFrame:
    """The latest files with their text ("" without one)."""
    files = files_of(spark, sf)
    return files.join(excerpts(table(spark, sf, "extracted")), "file_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def placed(files: DataFrame) -> DataFrame:
    """files with pos, the file's id: unique, and the same order wherever it is used."""
    return files.where("folder is not null").withColumn("pos", F.col("file_id"))


def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(folder, pos, vec, topical): usable vectors at unit length."""
    rows = table(spark, sf, "vectors").where(V.is_usable(F.col("vec"), 128) & F.col("folder").isNotNull() & F.col("file_id").isNotNull())
    one = rows.groupBy("folder", F.col("file_id").alias("pos")).agg(F.max("vec").alias("vec"), F.max(F.coalesce("topical", F.lit(False))).alias("topical"))
    return one.select("folder", "pos", V.normalised(F.col("vec")).alias("vec"), "topical")


def bounded(vectors: DataFrame) -> DataFrame:
    """Folders over the limit are sampled evenly, as before any audit: average linkage holds a folder in one task."""
    return evenly_sampled(vectors, ["folder"], ["pos"], Settings().max_files_per_folder, "_at").drop("_at", "truncated")


def table_members(spark: SparkSession, sf: str) -> DataFrame:
    """(folder, pos, cluster) of the clusters table; of several clusters of a file the greatest."""
    return table(spark, sf, "clusters").where("folder is not null and file_id is not null").groupBy("folder", F.col("file_id").alias("pos")).agg(F.max("cluster").alias("cluster"))


def member_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("folder").agg(F.count(F.lit(1)).cast("int").alias("n_files"))


def table_main(members: DataFrame) -> DataFrame:
    return C.meaningful(members, member_counts(members))


def exploded(rows: DataFrame, keys: list[str], vector: str, digits: int = 5) -> DataFrame:
    return rows.select(*keys, F.posexplode(vector).alias("i", "x")).select(*keys, "i", F.round("x", digits).alias("x"))


# --- names, kinds, texts ---


@query
def kind_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return files_of(spark, sf).select("file_id", "kind", "domain", "textual")


@query
def debris_files(spark: SparkSession, sf: str) -> DataFrame:
    return leftovers.debris_reason(files_of(spark, sf)).select("file_id", "reason")


@query
def unnamed_files(spark: SparkSession, sf: str) -> DataFrame:
    return latest_files(table(spark, sf, "files")).where(kinds.is_unnamed(F.col("stem"))).select("file_id", "stem")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return latest_files(table(spark, sf, "files")).where("stem is not null").select("file_id", "stem")


@query
def split_words(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("file_id", F.array_join(K.split_words(F.col("stem")), " ").alias("words"))


@query
def name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("file_id", K.name_phrase(F.col("stem")).alias("words"), F.array_join(K.name_tokens(F.col("stem"), False), " ").alias("all_words"))


@query
def content_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return excerpts(table(spark, sf, "extracted")).select("file_id", F.array_join(K.content_tokens(F.col("text"), 200), " ").alias("words"))


@query
def base_stem(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("file_id", K.base_stem(F.col("stem")).alias("base"))


@query
def version_markers(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("file_id", F.array_join(K.version_markers(F.col("stem")), " ").alias("markers"))


def _share(files: DataFrame) -> DataFrame:
    """Files of a whole share as one folder: families and copies inside one folder are rare in the tables."""
    return files.withColumn("folder", F.regexp_extract("folder", "^/[^/]+", 0))


@query
def version_pileups(spark: SparkSession, sf: str) -> DataFrame:
    return leftovers.revision_families(_share(placed(files_of(spark, sf))).where("stem is not null").withColumn("ext", F.lit("")), lists=False).select("folder", "base", "ext", "members", "first")


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.clean(F.col("text")).alias("excerpt"))


@query
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents put into markup and taken out of it again."""
    page = F.concat(F.lit("<html><head><style>p { color: red }</style><script>var a = '<p>';</script></head><body><p>"), F.replace(F.replace("text", F.lit("\n"), F.lit("</p><p>")), F.lit(","), F.lit("<br></br>&amp;&lt;b&gt;")), F.lit("</p></body></html>"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.html_text(page).alias("excerpt"))


@query
def legacy_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.printable_runs(F.col("text")).alias("excerpt"))


# --- scanning ---


@query
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Of a folder's images, at most 24 are described, evenly spaced by name."""
    images = files_of(spark, sf).where("kind = 'image' and folder is not null")
    return evenly_sampled(images, ["folder"], ["name", "file_id"], Settings().described_images).select("file_id", "pos", "truncated")


@query
def hidden_filter(spark: SparkSession, sf: str) -> DataFrame:
    files = latest_files(table(spark, sf, "files")).where("name is not null and path is not null")
    return files.where(~hidden(F.col("name")) & ~in_ignored_folder(F.col("path"), Settings().ignored_folders)).select("file_id")


@query
def ignore_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    rules = [r for base, line in RULES if (r := compile_rule(base, line))]
    return without_ignored(latest_files(table(spark, sf, "files")).where("path is not null"), rules).select("file_id")


@query
def ancestry_expand(spark: SparkSession, sf: str) -> DataFrame:
    return ancestry(table(spark, sf, "folders"))


@query
def subtree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    own = files_of(spark, sf).where("folder is not null").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    return rollup(ancestry(table(spark, sf, "folders")), own, [F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("folders")])


@query
def depth_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Folders near their root, with evidence from all depths."""
    below = subtree_rollup(spark, sf)
    top = ancestry(table(spark, sf, "folders")).groupBy(F.col("descendant").alias("folder")).agg(F.max("distance").alias("depth"))
    return below.join(top.where("depth <= 2"), "folder").select("folder", "depth", "files")


@query
def nested_roots(spark: SparkSession, sf: str) -> DataFrame:
    return outermost(table(spark, sf, "folders").select(F.col("folder").alias("root")))


@query
def reported_once(spark: SparkSession, sf: str) -> DataFrame:
    """Every folder is reached from all folders above it; the outermost reports it."""
    tree = ancestry(table(spark, sf, "folders")).select(F.col("descendant").alias("folder"), F.col("ancestor").alias("root"), (-F.col("distance")).alias("turn"))
    return first_report(tree, "folder", "turn").select("folder", "root")


@query
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    files = _share(placed(written_files(spark, sf))).withColumns({"digest": F.when(F.col("text") != "", F.sha2("text", 256)), "size": F.octet_length("text")})
    return leftovers.exact_groups(files, lists=False).select("folder", "first", "copies")


# --- evidence ---


@query
def common_name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    files = placed(files_of(spark, sf)).where("stem is not null").select("folder", "pos", K.name_tokens(F.col("stem")).alias("tokens"))
    return name_phrases(files).select(F.col("pos").alias("file_id"), "name_phrase")


@query
def marker_vectors(spark: SparkSession, sf: str) -> DataFrame:
    texts = excerpts(table(spark, sf, "extracted"))
    return exploded(texts.select("file_id", MARKER.as_column(F.col("text")).alias("v")), ["file_id"], "v")


@query
def distinct_encode(spark: SparkSession, sf: str) -> DataFrame:
    """As marker_vectors, but every distinct text is embedded once and joined back."""
    return exploded(encode_distinct(excerpts(table(spark, sf, "extracted")), {"text": "v"}, MARKER), ["file_id"], "v")


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    files = placed(written_files(spark, sf)).where("stem is not null").withColumn("tokens", K.name_tokens(F.col("stem")))
    return name_phrases(files).withColumn("mix", scoring.channel_mix(F.col("text"), F.col("name_phrase"), F.col("textual")))


@query
def channel_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).select("file_id", *(F.round(f"mix.{c}", 6).alias(f"{c}_share") for c in ("text", "name", "kind")))


@query
def composite_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mixed(spark, sf).withColumn("phrase", kinds.phrase_of(F.col("kind")))
    encoded = encode_distinct(rows.select("file_id", "text", "name_phrase", "phrase", "kind", "size", "mix"), {"text": "t", "name_phrase": "n", "phrase": "k"}, MARKER)
    void = F.coalesce((F.col("kind") == "junk") | (F.col("size") == 0), F.lit(False))
    return exploded(encoded.select("file_id", composite(F.col("t"), F.col("n"), F.col("k"), F.col("mix"), void).alias("v")), ["file_id"], "v")


@query
def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.file_terms(placed(written_files(spark, sf)).where("stem is not null")).select(F.col("pos").alias("file_id"), "term", "n")


# --- vectors and clusters ---


@query
def folder_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(C.profiles(unit_vectors(spark, sf)), ["folder", "n"], "profile")


@query
def pair_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return C.similar_pairs(unit_vectors(spark, sf), 0.9).withColumn("similarity", F.round("similarity", 5))


@query
def closest_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return C.closest(unit_vectors(spark, sf)).select("folder", F.col("pos").alias("file_id"), F.round("closest", 5).alias("closest"))


@query
def average_linkage(spark: SparkSession, sf: str) -> DataFrame:
    return C.clusters(bounded(unit_vectors(spark, sf)), 0.66).select("folder", F.col("pos").alias("file_id"), "cluster")


@query
def group_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return C.group_similarity(C.cluster_means(unit_vectors(spark, sf), table_members(spark, sf))).withColumn("similarity", F.round("similarity", 5))


@query
def meaningful_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return table_main(table_members(spark, sf))


def _subjects(spark: SparkSession, sf: str, vectors: DataFrame) -> DataFrame:
    members = table_members(spark, sf)
    return C.dominant_subject(vectors, members, table_main(members))


@query
def dominant_subject(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(_subjects(spark, sf, unit_vectors(spark, sf)), ["folder"], "subject")


@query
def class_tfidf_labels(spark: SparkSession, sf: str) -> DataFrame:
    terms = C.file_terms(placed(written_files(spark, sf)).where("stem is not null"))
    return C.cluster_labels(terms, table_members(spark, sf)).select("folder", "cluster", F.array_join("labels", " · ").alias("label"))


@query
def leave_one_out_fit(spark: SparkSession, sf: str) -> DataFrame:
    vectors = unit_vectors(spark, sf)
    return topics.own_fit(vectors, _subjects(spark, sf, vectors)).select("folder", F.col("pos").alias("file_id"), F.round("fit", 5).alias("fit"))


@query
def misfiled_best_profile(spark: SparkSession, sf: str) -> DataFrame:
    vectors = unit_vectors(spark, sf)
    best = topics.best_profile(vectors, ancestry(table(spark, sf, "folders")), C.profiles(vectors), _subjects(spark, sf, vectors), LIMITS.unrelated)
    return best.select("folder", F.col("pos").alias("file_id"), "descendant", F.round("similarity", 5).alias("similarity"))


@query
def topic_separation(spark: SparkSession, sf: str) -> DataFrame:
    members = table_members(spark, sf)
    main = members.join(table_main(members), ["folder", "cluster"], "left_semi")
    pairs = C.group_similarity(C.cluster_means(unit_vectors(spark, sf), main)).where("a < b")
    return pairs.groupBy("folder").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("similarity"), 5).alias("mean"))


@query
def shared_name_thread(spark: SparkSession, sf: str) -> DataFrame:
    members = table_members(spark, sf)
    main = members.join(table_main(members), ["folder", "cluster"], "left_semi")
    return topics.shared_names(placed(files_of(spark, sf)).where("stem is not null"), main).withColumn("jaccard", F.round("jaccard", 6))


@query
def unattached_files(spark: SparkSession, sf: str) -> DataFrame:
    members = table_members(spark, sf)
    eligible = topics.judgeable(placed(written_files(spark, sf)), unit_vectors(spark, sf))
    rows = topics.looseness(eligible, members, table_main(members))
    return rows.select("folder", "readable", F.round("loose", 6).alias("loose"), "loners", "subjects", F.round(scoring.ramp(F.col("loose"), 0.20, 0.95), 6).alias("severity"))


@query
def char_overlap_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds for pairs of near vectors with texts of like length."""
    texts = written_files(spark, sf).where("text != ''").select("file_id", F.substring("text", 1, leftovers.COMPARED).alias("text"))
    pairs = C.similar_pairs(unit_vectors(spark, sf), 0.9).join(texts.select(F.col("file_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("file_id").alias("b"), F.col("text").alias("y")), "b")
    near = pairs.where(2.0 * F.least(F.length("x"), F.length("y")) / (F.length("x") + F.length("y")) >= 0.9)
    return near.select("a", "b", F.round(leftovers.overlap_bound(F.col("x"), F.col("y")), 6).alias("bound"))


@query
def label_separation(spark: SparkSession, sf: str) -> DataFrame:
    """Mean similarity inside each label of embeddings and to all other labels, from vector sums."""
    rows = table(spark, sf, "embeddings").where("embedding is not null and label is not null").select("label", V.normalised(F.col("embedding")).alias("v"))
    sums = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"))
    whole = sums.groupBy("i").agg(F.sum("s").alias("t"))
    joined = sums.join(F.broadcast(whole), "i").groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("own"), F.sum(F.col("s") * (F.col("t") - F.col("s"))).alias("cross"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    out = joined.join(counts, "label").join(F.broadcast(total)).where("n > 1")
    return out.select("label", "n", F.round((F.col("own") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 5).alias("inside"), F.round(F.col("cross") / (F.col("n") * (F.col("all") - F.col("n"))), 5).alias("outside"))


@query
def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """How far apart labels are: similarities of all pairs of their unit mean vectors, and the closest pair."""
    rows = table(spark, sf, "embeddings").where("embedding is not null and label is not null").select("label", V.normalised(F.col("embedding")).alias("v"))
    means = V.mean_by(rows, ["label"], "v", "m").select("label", V.normalised(F.col("m")).alias("m"))
    # Labels are the topics of a calibration set, some tens of means.
    pairs = means.select(F.col("label").alias("a"), F.col("m").alias("x")).join(means.select(F.col("label").alias("b"), F.col("m").alias("y")), F.col("a") < F.col("b")).select("a", "b", V.dot(F.col("x"), F.col("y")).alias("s"))
    at = lambda p: F.percentile("s", F.lit(p))
    best = F.max(F.struct("s", (-F.col("a")).alias("a"), (-F.col("b")).alias("b")))
    out = pairs.agg(F.count(F.lit(1)).alias("pairs"), at(0.5).alias("median"), at(0.95).alias("p95"), best.alias("best"))
    return out.select("pairs", F.round("median", 5).alias("median"), F.round("p95", 5).alias("p95"), F.round("best.s", 5).alias("highest"), (-F.col("best.a")).alias("closest_a"), (-F.col("best.b")).alias("closest_b"))


# --- time ---


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', mtime)") / 1e6
    return placed(files_of(spark, sf)).where("name is not null").withColumn("mtime", F.coalesce(seconds, F.lit(0.0)))


@query
def era_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.kept_eras(strata.wide_eras(_dated(spark, sf).select("folder", "pos", "mtime"), ["folder"], "mtime", 365 * 86400.0, "pos"), ["folder"])
    return rows.groupBy("folder", "era").agg(F.count(F.lit(1)).alias("files"), F.round(F.min("mtime"), 3).alias("begin"), F.round(F.max("mtime"), 3).alias("end"))


@query
def event_eras(spark: SparkSession, sf: str) -> DataFrame:
    """Gap sessions of users: 12 hours apart, at least three events."""
    events = table(spark, sf, "events").where("user_id is not null and ts is not null")
    seconds = (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") if dict(events.dtypes)["ts"] == "timestamp_ntz" else F.unix_micros("ts")) / 1e6
    rows = strata.kept_eras(strata.wide_eras(events.select("user_id", "event_id", seconds.alias("t")), ["user_id"], "t", 12 * 3600.0, "event_id"), ["user_id"])
    return rows.groupBy("user_id", "era").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query
def era_dominant(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.kept_eras(strata.wide_eras(_dated(spark, sf).select("folder", "pos", "mtime"), ["folder"], "mtime", 365 * 86400.0, "pos"), ["folder"])
    return strata.dominant(rows.join(table_members(spark, sf), ["folder", "pos"]), ["folder"], "mtime", "pos")


def table_frames(spark: SparkSession, sf: str, settings: Settings = Settings(), stored: bool = True) -> Frames:
    """The tables as frames: their own vectors and clusters, files without vectors included.

    Signals that read a frame once need none of them ``stored``."""
    keep = materialise if stored else lambda df: df
    files = _dated(spark, sf).where("stem is not null").join(excerpts(table(spark, sf, "extracted")), "file_id", "left")
    files = keep(files.withColumn("digest", F.when(F.col("text") != "", F.sha2("text", 256))).withColumn("text", F.coalesce("text", F.lit(""))))
    counts = files.groupBy("folder").agg(F.count(F.lit(1)).cast("int").alias("n_files"), F.lit(0).alias("truncated"))
    members = table_members(spark, sf).withColumn("closest", F.lit(0.0))
    labels = table(spark, sf, "cluster_labels").where("cluster >= 0").groupBy("folder", "cluster").agg(F.max("labels").alias("labels"))
    vectors = keep(unit_vectors(spark, sf))
    return Frames(files, vectors, keep(members), labels, counts, ancestry(table(spark, sf, "folders")), settings, Thresholds.derive(SCALE, settings))


@query
def time_strata(spark: SparkSession, sf: str) -> DataFrame:
    return strata.time_strata(table_frames(spark, sf)).select("folder", F.round("severity", 6).alias("severity"), F.get_json_object("data", "$.eras[0].count").cast("long").alias("first_count"))


# --- scores ---


@query
def overcrowded(spark: SparkSession, sf: str) -> DataFrame:
    folders = files_of(spark, sf).where("folder is not null").groupBy("folder").agg(F.count(F.lit(1)).cast("int").alias("n_files"), F.lit(0).alias("truncated"))
    return shape.crowding(folders).withColumn("severity", F.round("severity", 6))


@query
def severity_ramp(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "folders").where("n_files is not null").select("folder", *(F.round(scoring.ramp(F.col("n_files"), *b), 6).alias(n) for n, b in (("few", (2, 12)), ("many", (40, 240)), ("step", (5, 5)))))


def _simple_findings(spark: SparkSession, sf: str) -> tuple[DataFrame, Frames]:
    f = table_frames(spark, sf, Settings(report_crowding=True), stored=False)
    parts = (leftovers.debris(f), leftovers.version_pileups(f), shape.overcrowded(f))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), f


@query
def score_family_max(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = _simple_findings(spark, sf)
    return scores(found).select("folder", F.round("raw", 6).alias("score"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    found, f = _simple_findings(spark, sf)
    rows = f.folders.join(scores(found), "folder", "left").withColumn("score", F.round(F.coalesce("raw", F.lit(0.0)), 6))
    return rows.select("folder", "n_files", (F.col("n_files") >= 6).alias("judged"), F.when(F.col("n_files") >= 6, F.col("score")).otherwise(0.0).alias("score")).withColumn("verdict", scoring.verdict(F.col("score")))


@query
def verdict_bands(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).withColumn("label", scoring.verdict_label(F.col("verdict")))


@query
def visibility_filter(spark: SparkSession, sf: str) -> DataFrame:
    return visible(_judged(spark, sf), show_skipped=True, min_verdict=1).select("folder", "judged", "verdict")


@query
def worst_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return worst_first(_judged(spark, sf).where("judged")).select("folder", "score", "verdict").withColumn("report", F.concat_ws("\t", F.format_string("%.1f", "score"), scoring.verdict_label(F.col("verdict")), F.col("folder")))


@query
def median_of_medians(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("n_chars is not null and source is not null and lang is not null")
    inner = rows.groupBy("source", "lang").agg(F.percentile("n_chars", F.lit(0.5)).alias("m"))
    return inner.groupBy("source").agg(F.round(F.percentile("m", F.lit(0.5)), 6).alias("median"))


# --- cache ---


@query
def cache_eviction(spark: SparkSession, sf: str) -> DataFrame:
    from kartei.sources.cache import evicted_texts

    return evicted_texts(table(spark, sf, "extracted")).select("path", "size", "mtime", "settings", "accessed")


@query
def cache_vectors(spark: SparkSession, sf: str) -> DataFrame:
    from kartei.sources.cache import evicted_vectors

    return evicted_vectors(table(spark, sf, "embedding_cache")).select("model", "digest", "accessed", "dimensions")


@query
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The latest files and whether their text is in the cache."""
    from kartei.sources.cache import looked_up

    files = latest_files(table(spark, sf, "files")).where("path is not null")
    return looked_up(files, table(spark, sf, "extracted"), "s7f3a1c").select("file_id", F.col("text").isNotNull().alias("cached"))


# --- whole signals and audits ---


def _findings(rows: DataFrame) -> DataFrame:
    return rows.withColumn("severity", F.round("severity", 6))


@query
def greedy_unrelated(spark: SparkSession, sf: str) -> DataFrame:
    return topics.chosen_topics(table_frames(spark, sf))[0]


@query
def unrelated_topics(spark: SparkSession, sf: str) -> DataFrame:
    groups = F.size(F.from_json(F.get_json_object("data", "$.groups"), "array<struct<label string>>"))
    found = _findings(topics.unrelated_topics(table_frames(spark, sf)))
    return found.select("folder", groups.alias("topics"), F.get_json_object("data", "$.coverage").cast("double").alias("coverage"), "severity")


@query
def stray_files(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda key, kind: F.get_json_object("data", f"$.{key}").cast(kind).alias(key)
    return _findings(topics.unattached_files(table_frames(spark, sf))).select("folder", "code", number("count", "long"), number("loose_fraction", "double"), "severity")


@query
def misfiled_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(topics.misfiled_neighbours(table_frames(spark, sf)))


@query
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return leftovers.near_pairs(table_frames(spark, sf))


@query
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(leftovers.duplicates(table_frames(spark, sf)))


def audited_files(spark: SparkSession, sf: str) -> DataFrame:
    files = written_files(spark, sf).where("folder is not null and stem is not null")
    return files.withColumn("digest", F.when(F.col("text") != "", F.sha2("text", 256)))


@query
def folder_audit(spark: SparkSession, sf: str) -> DataFrame:
    from kartei.plans.audit import audit

    rows = audit(audited_files(spark, sf), HashedEmbedder(), folders=table(spark, sf, "folders")).analyses
    return worst_first(rows.withColumn("findings", F.to_json("findings")))


@query
def folder_placement(spark: SparkSession, sf: str) -> DataFrame:
    from kartei.operators.placement import misplaced_folders
    from kartei.plans.audit import frames

    embedder = HashedEmbedder()
    return misplaced_folders(frames(audited_files(spark, sf), embedder, folders=table(spark, sf, "folders")), embedder)


@query
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    from kartei.calibrate import sweep

    return sweep(bounded(unit_vectors(spark, sf)), table_members(spark, sf))


@query
def unrelated_sweep(spark: SparkSession, sf: str) -> DataFrame:
    from kartei.calibrate import unrelated_sweep as run

    members = table_members(spark, sf)
    main = materialise(table_main(members))
    held = members.join(main, ["folder", "cluster"], "left_semi")
    alike = C.group_similarity(C.cluster_means(unit_vectors(spark, sf), held)).where("a < b")
    named = topics.shared_names(placed(files_of(spark, sf)).where("stem is not null"), held).where(F.col("jaccard") >= topics.NAME_THREAD)
    return run(main, alike, named, SCALE)


@query
def misfiled_sweep(spark: SparkSession, sf: str) -> DataFrame:
    from kartei.calibrate import misfiled_sweep as run

    vectors = materialise(unit_vectors(spark, sf))
    subjects = materialise(_subjects(spark, sf, vectors))
    loose = topics.own_fit(vectors, subjects).where(F.col("fit") < LIMITS.cluster).select("folder", "pos", "vec")
    return run(topics.best_profile(loose, ancestry(table(spark, sf, "folders")), C.profiles(vectors), subjects, LIMITS.unrelated), LIMITS.cluster, SCALE)


@query
def finding_census(spark: SparkSession, sf: str) -> DataFrame:
    """How often each finding of all signals comes out over the tables."""
    from kartei.calibrate import census
    from kartei.signals import run_all

    found, _ = run_all(table_frames(spark, sf, Settings(report_crowding=True)))
    return census(_findings(materialise(found))).withColumn("mean_severity", F.round("mean_severity", 6))


# --- small inputs with known outcomes ---


@query
def read_formats(spark: SparkSession, sf: str) -> DataFrame:
    """The text of a file of every format, from its bytes."""
    from kartei.sources.readers import with_text

    files = kinds.with_kind(planted.formats(spark)).withColumn("described", F.lit(True))
    return with_text(files, content="content").select("name", "text")


@query
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    from kartei.report import lines

    return lines(planted.analyses(spark)).select("folder", "line")


@query
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON objects of folders, read again."""
    from kartei.report import as_json

    item = F.from_json("value", "path string, files int, score double, verdict string, findings array<struct<code string, severity double>>, truncated int, skip_reason string")
    rows = as_json(planted.analyses(spark)).select(item.alias("x"))
    return rows.select("x.path", "x.files", "x.score", "x.verdict", F.when(F.col("x.findings").isNotNull(), F.size("x.findings")).alias("found"), F.get("x.findings", F.lit(0))["severity"].alias("worst"), "x.truncated", "x.skip_reason")


def _planted_frames(spark: SparkSession) -> Frames:
    from kartei.plans.audit import frames

    return frames(planted.folders_that_fire(spark), MarkerEmbedder(planted.MARKS), folders=spark.createDataFrame([("/p",), ("/r",), ("/r/greek",), ("/r/latin",)], "folder string"))


@query
def planted_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = leftovers.duplicates(_planted_frames(spark))
    number = lambda key: F.coalesce(F.aggregate(F.from_json(F.get_json_object("data", f"$.{key}"), "array<array<string>>"), F.lit(0), lambda s, g: s + F.size(g) - 1), F.lit(0))
    return found.select("folder", number("exact_groups").alias("exact"), number("near_pairs").alias("near"))


@query
def planted_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    f = _planted_frames(spark)
    names = f.files.select("folder", "pos", "name")
    pairs = leftovers.near_pairs(f)
    return pairs.join(names.select("folder", F.col("pos").alias("a"), F.col("name").alias("name_a")), ["folder", "a"]).join(names.select("folder", F.col("pos").alias("b"), F.col("name").alias("name_b")), ["folder", "b"]).select("folder", "name_a", "name_b")


@query
def planted_misfiled(spark: SparkSession, sf: str) -> DataFrame:
    found = topics.misfiled_neighbours(_planted_frames(spark))
    by_folder = F.explode(F.from_json(F.get_json_object("data", "$.by_subdir"), "map<string, array<string>>"))
    return found.select("folder", by_folder.alias("below", "names")).select("folder", "below", F.size("names").alias("files"))


@query
def planted_placement(spark: SparkSession, sf: str) -> DataFrame:
    from kartei.operators.placement import misplaced_folders

    found = misplaced_folders(_planted_frames(spark), MarkerEmbedder(planted.MARKS))
    return found.select("folder", F.get_json_object("data", "$.related_folder").startswith("/r/latin").alias("related"))
