"""Registered queries of whole runs: clusters and their invariants, inherited labels, stages, documents, sweeps, archives."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphdrift.functions import vectors as V
from glyphdrift.operators import cluster, quality, reports, sampling, sweep
from glyphdrift.plans import catalog as C
from glyphdrift.plans import pipeline
from glyphdrift.session import ensure_checkpoint_dir, materialise, table
from glyphdrift.sources import archive

SETTINGS = pipeline.Settings()
FULL = ("word", "dynasty_category", "toptitle", "sentence", "vector")
CLUSTERABLE = f"(SELECT occ_id, word, dynasty_category FROM {C.LATEST} WHERE {C.USABLE})"
LOCAL_GROUPS = f"(SELECT word || '/' || dynasty_category AS grp, count(*) AS n FROM {CLUSTERABLE} WHERE word IS NOT NULL AND dynasty_category IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)"
GLOBAL_GROUPS = f"(SELECT word AS grp, count(*) AS n FROM {CLUSTERABLE} WHERE word IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)"
STARTED = "CASE WHEN n < 800 THEN greatest(5, 20 // 3) WHEN n < 2000 THEN greatest(8, 20 // 2) WHEN n < 5000 THEN greatest(12, 14) ELSE 20 END"


def _balance(found: cluster.Clustering, started: F.Column) -> DataFrame:
    """Of each group: rows, whether its clusters are numbered densely from 0, and whether their number is what merging and splitting leaves."""
    spark = found.rows.sparkSession
    steps = [(g, len(found.merges[g]), sum(len(new) - 1 for new in found.splits[g].values())) for g in found.merges]
    made = spark.createDataFrame(steps, "grp string, merged int, added int")
    sizes = found.rows.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("k"), F.max("cluster").alias("top"))
    return sizes.join(made, "grp").select("grp", "n", (F.col("top") + 1 == F.col("k")).alias("is_dense"), (F.col("k") == started - F.col("merged") + F.col("added")).alias("is_accounted"))


@C.query(f"SELECT grp, n, TRUE AS is_dense, TRUE AS is_accounted FROM {LOCAL_GROUPS}")
def local_cluster_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local clusters lose no row, and first clusters less merges plus splits are the final ones."""
    n = F.col("n")
    started = F.when(n < 800, cluster.adaptive_k(0)).when(n < 2000, cluster.adaptive_k(800)).when(n < 5000, cluster.adaptive_k(2000)).otherwise(cluster.adaptive_k(5000))
    return _balance(pipeline.local_clusters(C._clusterable(spark, sf_dir), SETTINGS), started)


@C.query(f"SELECT grp, n, TRUE AS is_dense, TRUE AS is_accounted FROM {GLOBAL_GROUPS}")
def global_cluster_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balance(pipeline.global_clusters(C._clusterable(spark, sf_dir), SETTINGS), F.lit(SETTINGS.base_k))


@C.query(f"SELECT grp, TRUE AS is_alike, TRUE AS is_numbered, TRUE AS is_sized FROM {GLOBAL_GROUPS}")
def merge_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge steps: every similarity above the threshold, steps numbered without gap, sizes within the group."""
    found = pipeline.global_clusters(C._clusterable(spark, sf_dir), replace(SETTINGS, merge_ratio=0.8))
    rows = [(g, m.step, m.similarity, m.source_size + m.target_size) for g, ms in found.merges.items() for m in ms]
    steps = spark.createDataFrame(rows, "grp string, step int, similarity double, size bigint")
    counts = found.rows.groupBy("grp").agg(F.count("*").alias("n"))
    made = counts.join(steps, "grp", "left").groupBy("grp", "n").agg(F.min("similarity").alias("low"), F.max("step").alias("last"), F.count("step").alias("steps"), F.max("size").alias("size"))
    return made.select("grp", F.coalesce(F.col("low") > 0.8, F.lit(True)).alias("is_alike"), (F.coalesce("last", F.lit(0)) == F.col("steps")).alias("is_numbered"), F.coalesce(F.col("size") <= F.col("n"), F.lit(True)).alias("is_sized"))


@C.query(f"SELECT grp, least(n, 5000) AS n, TRUE AS is_in_range FROM {GLOBAL_GROUPS}")
def silhouette_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes of the words: rows compared, and a value from -1 to 1."""
    rows = cluster.silhouettes(pipeline.global_clusters(C._clusterable(spark, sf_dir), SETTINGS).rows)
    return rows.select("grp", "n", F.coalesce(F.col("silhouette").between(-1, 1), F.lit(False)).alias("is_in_range"))


@C.query(f"SELECT count(*) AS n, TRUE AS is_centred, TRUE AS is_uncorrelated FROM {CLUSTERABLE}")
def pca_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal coordinates of all records: centred, and without correlation."""
    rows = C.QUERIES["pca_2d"](spark, sf_dir)
    near = lambda c: F.abs(c) < 1e-3
    return rows.agg(F.count("*").alias("n"), (near(F.avg("PC1")) & near(F.avg("PC2"))).alias("is_centred"), near(F.corr("PC1", "PC2")).alias("is_uncorrelated"))


def _annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Votes and labelled rows of real clusters over the cleaned sample."""
    records = C.records(spark, sf_dir, *FULL)
    sample = materialise(pipeline.cleaned_sample(records.drop("vector"), SETTINGS))
    rows = materialise(pipeline.with_vectors(sample, records, SETTINGS.size))
    own = lambda found, name: found.rows.select(F.col("id").alias("occ_id"), F.col("cluster").alias(name))
    local, pooled = own(pipeline.local_clusters(rows, SETTINGS), "local_cluster"), own(pipeline.global_clusters(rows, SETTINGS), "global_cluster")
    return pipeline.annotated(sample, local, pooled, table(spark, sf_dir, "label_map"))


@C.query()
def annotated_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clustered row of the cleaned sample with the label that its local cluster inherits. Iterative, so there is no SQL."""
    _, rows = _annotated(spark, sf_dir)
    return rows.select("occ_id", "word", "dynasty", "local_cluster", "global_cluster", "Macro_Category", "Sub_Category")


SAMPLED = C.SQL["cleaned_sample"].replace(f"<= {C.CAP})", f"<= {SETTINGS.cap})").replace("SELECT occ_id, dynasty_category, word, toptitle FROM capped", "SELECT occ_id, dynasty_category, word, vector FROM capped")


@C.query(f"WITH rows AS ({SAMPLED}), usable AS (SELECT * FROM rows WHERE {C.USABLE} AND word IS NOT NULL AND dynasty_category IS NOT NULL) SELECT word, dynasty_category AS dynasty, count(*) AS n, count(*) AS matched, 0 AS unlabelled FROM usable GROUP BY 1, 2 HAVING count(*) >= 10")
def annotated_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of real clusters over the cleaned sample: labelled rows of each word and period, those whose text meets a pooled cluster, those without a label."""
    _, rows = _annotated(spark, sf_dir)
    return rows.groupBy("word", "dynasty").agg(F.count("*").alias("n"), F.count("global_cluster").alias("matched"), F.count_if(F.col("Macro_Category").isNull() | (F.col("Macro_Category") == "Unlabeled")).cast("int").alias("unlabelled"))


@C.query()
def stage_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine stages over the whole table, written to the shared folder: rows of each, and whether a second run skips it."""
    import uuid

    folder = f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    run = pipeline.full_run(C.records(spark, sf_dir, *FULL), table(spark, sf_dir, "label_map"), folder)
    run.execute()
    again = pipeline.full_run(C.records(spark, sf_dir, *FULL), table(spark, sf_dir, "label_map"), folder)
    skipped = {e["stage"]: e["message"] == "skipped" for e in again.execute(skip_existing=True)}
    out = None
    for place, name in enumerate(pipeline.STAGES):
        row = spark.read.parquet(f"{folder}/{name}").agg(F.lit(place).alias("place"), F.lit(name).alias("stage"), F.count("*").alias("n"), F.lit(skipped[name]).alias("is_skipped"))
        out = row if out is None else out.unionByName(row)
    return out


@C.query(f"""
SELECT word, dynasty, CAST(sum(size) AS BIGINT) AS n_samples, CAST(count(*) AS INTEGER) AS k_final, CAST(sum(size) AS BIGINT) AS counted, CAST(sum(least(size, 8)) AS BIGINT) AS n_core, CAST(sum(CASE WHEN size > 11 THEN 3 ELSE 0 END) AS BIGINT) AS n_boundary
FROM (SELECT word, dynasty, local_cluster, count(*) AS size FROM {C.ASSIGNED} GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def stats_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested statistics documents of every word and period, counted again from their inside."""
    rows = reports.statistics_documents(C.assignments(spark, sf_dir), ["word", "dynasty"], "local_cluster", "occ_id", "vector", ["sentence", "toptitle"])
    total = lambda f: F.aggregate(F.map_values("cluster_sentences"), F.lit(0).cast("bigint"), lambda s, c: s + f(c))
    return rows.select("word", "dynasty", "n_samples", "k_final", total(lambda c: c["count"]).alias("counted"), total(lambda c: F.size(c["core"])).alias("n_core"), total(lambda c: F.size(c["boundary"])).alias("n_boundary"))


@C.query(f"""
WITH a AS {C.ASSIGNED}, p AS (SELECT word, global_cluster, string_agg(dynasty || ': ' || n, ', ' ORDER BY dynasty) AS periods, CAST(sum(n) AS BIGINT) AS size FROM (SELECT word, global_cluster, dynasty, count(*) AS n FROM a GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT word, global_cluster, string_agg('- ' || coalesce(sentence, ''), chr(10) ORDER BY occ_id) AS samples FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY word, global_cluster ORDER BY occ_id) <= 5) GROUP BY 1, 2)
SELECT word, global_cluster, size, '## ' || word || ' C' || global_cluster || ' (' || size || ')' || chr(10) || periods || chr(10) || samples AS section FROM p JOIN s USING (word, global_cluster)""")
def label_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of a label template, one for each pooled cluster."""
    return reports.label_sections(C.assignments(spark, sf_dir), ["word"], "global_cluster", "dynasty", "sentence", "occ_id")


@C.query(f"{C.RULED} SELECT word, reason, n, filtered, round(n * 100.0 / filtered, 6) AS pct FROM (SELECT word, reason, count(*) AS n FROM (SELECT word, unnest({C._failed_sql(quality.LEVELS['normal'])}) AS reason FROM ruled) GROUP BY ALL) JOIN (SELECT word, count(*) AS filtered FROM ruled WHERE len({C._failed_sql(quality.LEVELS['normal'])}) > 0 GROUP BY 1) USING (word)")
def quality_reason_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each word and reason: rows, filtered rows, and the reason's share of them."""
    rows = C.records(spark, sf_dir, "sentence", "word").select("word", quality.failed_checks(F.col("sentence"), "normal").alias("f"))
    return reports.reason_rates(rows, ["word"], "f").withColumn("pct", F.round("pct", 6))


@C.query(f"""
SELECT word, dynasty_category, scanned, n_unique, scanned - n_unique AS duplicates, n_samples_final FROM
  (SELECT word, coalesce(dynasty_category, 'unknown') AS dynasty_category, count(*) AS scanned FROM {C.LATEST} GROUP BY 1, 2)
  JOIN (SELECT word, coalesce(dynasty_category, 'unknown') AS dynasty_category, count(*) AS n_unique FROM {C.UNIQUE} GROUP BY 1, 2) USING (word, dynasty_category)
  JOIN (SELECT word, coalesce(dynasty_category, 'unknown') AS dynasty_category, count(*) AS n_samples_final FROM {C.CAPPED} GROUP BY 1, 2) USING (word, dynasty_category)""")
def sampling_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows scanned, unique, repeated and sampled in the end, of each word and period."""
    keys = ["word", "dynasty_category"]
    count = lambda df, name: df.fillna("unknown", ["dynasty_category"]).groupBy(*keys).agg(F.count("*").alias(name))
    unique = C._unique(spark, sf_dir)
    rows = count(C.records(spark, sf_dir, *keys), "scanned").join(count(unique, "n_unique"), keys).join(count(sampling.capped_strata(unique, C.STRATA, "occ_id", C.CAP), "n_samples_final"), keys)
    return rows.withColumn("duplicates", F.col("scanned") - F.col("n_unique"))


@C.query(f"SELECT d.dynasty_category, d.dynasty_zh, count(r.occ_id) AS n FROM (SELECT dynasty_category, min(dynasty_zh) AS dynasty_zh FROM dynasty_dim GROUP BY 1) d LEFT JOIN {C.LATEST} r USING (dynasty_category) GROUP BY 1, 2")
def period_names_zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese name of each period with its records."""
    names = table(spark, sf_dir, "dynasty_dim").groupBy("dynasty_category").agg(F.min("dynasty_zh").alias("dynasty_zh"))
    counts = C.records(spark, sf_dir, "dynasty_category").groupBy("dynasty_category").agg(F.count("*").alias("n"))
    return names.join(counts, "dynasty_category", "left").fillna(0, ["n"])


@C.query("SELECT word, dynasty, silhouette, k_final, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY silhouette DESC, k_final NULLS LAST, dynasty) AS place FROM local_stats WHERE silhouette IS NOT NULL) WHERE place <= 10")
def sweep_top_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten runs of highest silhouette of each word."""
    return sweep.top_runs(table(spark, sf_dir, "local_stats"), ["word"], "dynasty").select("word", "dynasty", "silhouette", "k_final", "place")


@C.query("SELECT line FROM (SELECT 0 AS a, '' AS b, '| word | dynasty | n_samples | k_final |' AS line UNION ALL SELECT 1, '', '| --- | --- | --- | --- |' UNION ALL SELECT 2, '', '| ' || coalesce(word, '') || ' | ' || coalesce(dynasty, '') || ' | ' || coalesce(CAST(n_samples AS VARCHAR), '') || ' | ' || coalesce(CAST(k_final AS VARCHAR), '') || ' |' FROM local_stats)")
def sweep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of earlier runs as lines of a Markdown table."""
    return reports.markdown(table(spark, sf_dir, "local_stats").select("word", "dynasty", "n_samples", "k_final"), ["word", "dynasty"])


BASELINE = {"local": (20, 0.95, 0.3), "global": (20, 0.95, 0.1)}  # fixed values, as are those of the sweep
KS, MERGES, SPLITS = [10, 15, 20, 25, 30], [0.9, 0.92, 0.95, 0.97], [0.1, 0.3, 0.5]


def _swept(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Weighted figures of every configuration of a one-factor sweep, with the gain over the baseline and the place among all."""
    rows = C.records(spark, sf_dir, "word", "dynasty_category", "vector").where("word IS NOT NULL" + (" AND dynasty_category IS NOT NULL" if mode == "local" else ""))
    group = F.concat_ws("/", "word", "dynasty_category") if mode == "local" else F.col("word")
    keyed = rows.select(group.alias("grp"), F.col("occ_id").alias("id"), F.col("vector").alias("vec"))
    configs = sweep.one_factor_configs(spark, BASELINE[mode], KS, MERGES, SPLITS)
    results = pipeline.sweep_results(keyed, configs, C.SIZE, parts=None if mode == "local" else SETTINGS.global_parts)
    runs = sweep.weighted_metrics(results, ["k", "merge_ratio", "split_ratio"]).withColumn("run_id", sweep.run_id(mode)).withColumn("mode", F.lit(mode))
    runs = materialise(runs)
    base = sweep.baseline_run(runs, BASELINE[mode])
    placed = sweep.top_runs(runs, ["mode"], "run_id", count=10**6).select("run_id", "place")
    return sweep.deltas(runs, base, ["mode"]).join(placed, "run_id")


@C.query()
def sweep_local_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-factor sweep of the clusters of single periods, all ten configurations. Iterative, so there is no SQL."""
    return _swept(spark, sf_dir, "local")


@C.query()
def sweep_global_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-factor sweep of the pooled clusters, all ten configurations. Iterative, so there is no SQL."""
    return _swept(spark, sf_dir, "global")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tar archive of each batch of texts: one JSON member for each, in turns an object and a list."""
    for batch in batches:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz", compresslevel=1) as pack:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = json.dumps({"fulltext": text} if doc % 2 else [{"text": text}], ensure_ascii=False).encode("utf-8", "surrogatepass")
                info = tarfile.TarInfo(f"docs/a_b_{'wb' if doc % 3 else ''}{doc}.json")
                info.size = len(content)
                pack.addfile(info, io.BytesIO(content))
        first = batch.column(0)[0].as_py() if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array([f"{first}.tar.gz"]), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])


@C.query(r"SELECT CAST(doc_id AS VARCHAR) AS urn, length(regexp_replace(regexp_replace(text, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')) AS n_chars FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into archives of JSON members, scanned again, by urn."""
    texts = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "text")
    files = texts.mapInArrow(_packed, "path string, content binary")
    read = archive.text_map(archive.archive_texts(archive.members_of(files), 0))
    return read.select("urn", F.length("text").alias("n_chars"))
