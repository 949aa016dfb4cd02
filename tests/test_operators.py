"""Operators on small tables: hot keys, nulls, ties, repeated rows, empty tables, clashing names."""

import io
import json
import tarfile
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphdrift.operators import cluster, labels, latest, sampling, skew, sweep
from glyphdrift.plans import pipeline
from glyphdrift.sources import archive, tables
from glyphdrift.streaming import ingest

OCC = "occ_id string, toptitle string, dynasty string, dynasty_category string, reference_id string, quality double, load_seq bigint"
META = "title string, toptitle string, from_dynasty_name string, topurn string"
DIM = "dynasty_name string, dynasty_category string, period_ord int, dynasty_zh string"


def work_tables(spark, rows):
    meta = spark.createDataFrame([("a", "x", "ming", "ctext:9"), ("b", "x", "Ming", "ctext:wb9"), (None, None, None, None)], META)
    dim = spark.createDataFrame([("Ming", "ming", 5, "明"), ("Qing", "qing", 6, "清")], DIM)
    return spark.createDataFrame(rows, OCC), meta, dim


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "y"), ("b", None, "z"), (None, 5, "n")], "occ_id string, load_seq bigint, row string")
    assert sorted(map(tuple, latest.latest_rows(df, ["row"]).collect())) == [("a", "y"), ("b", "z")]
    assert latest.latest_rows(df.limit(0), ["row"]).count() == 0


def test_works_of_a_hot_key(spark):
    rows = [(f"h{i}", "樂城類覽" if i % 2 else "《樂城類覽》", " MING", None, "ctext_1", 0.5, 1) for i in range(300)]
    rows += [("n1", None, None, None, "ctext_9", float("nan"), 1), ("n2", "x", "unheard", None, "ctext_5", None, 1), ("n1", None, None, None, "ctext_9", None, 0)]
    states = {(r.work_category, r.work_title): (r.n, r.n_quality) for r in skew.work_states(*work_tables(spark, rows)).collect()}
    assert states == {("ming", "樂城類覽"): (300, 300), ("ming", "unknown"): (1, 0), (None, "x"): (1, 0)}
    dominant = skew.dominant_works(*work_tables(spark, rows)).collect()
    assert [(r.work_title, r.n) for r in dominant] == [("樂城類覽", 300)]
    assert skew.dominant_works(*work_tables(spark, [])).count() == 0


def test_eager_join_equals_join(spark):
    left = spark.createDataFrame([("k", "g", 2), ("k", "g", None), ("k", "h", 3), ("l", "g", 5), (None, "g", 7)] * 3, "k string, g string, x int")
    right = spark.createDataFrame([("k", 10, 99), ("k", 20, 99), ("m", 1, 99), (None, 1, 99)], "k string, y int, x int")
    quick = skew.eager_join_aggregate(left, right, ["k"], ["g"], ["x"], ["y"])
    plain = left.join(right.drop("x"), "k").groupBy("g").agg(F.count("*").alias("n_pairs"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))
    assert sorted(map(tuple, quick.collect())) == sorted(map(tuple, plain.collect()))
    assert skew.eager_join_aggregate(left.limit(0), right, ["k"], ["g"], ["x"], ["y"]).count() == 0


def test_sampling(spark):
    df = spark.createDataFrame([(f"o{i}", "p", "w", f"s{i // 2}", None if i % 3 else "t") for i in range(60)], "occ_id string, period string, word string, sentence string, toptitle string")
    titled = df.withColumn("toptitle", sampling.source_title(F.col("toptitle")))
    unique = sampling.first_of_equal(titled, ["period", "word", "sentence"], ["occ_id"])
    assert unique.count() == 30
    capped = sampling.capped_strata(unique, ["period", "word", "toptitle"], "occ_id", 5)
    assert {r.toptitle: r["count"] for r in capped.groupBy("toptitle").count().collect()} == {"t": 5, "unknown": 5}
    assert sampling.diversity(capped, ["period"], "toptitle").first()["entropy"] == pytest.approx(1.0)
    assert sampling.diversity(capped.limit(0), ["period"], "toptitle").count() == 0


def test_merge_equals_recomputation():
    rng = np.random.default_rng(1)
    points, label = rng.normal(size=(300, 6)) + 1, rng.integers(0, 8, 300)
    sizes = np.bincount(label, minlength=8)
    centres = np.array([points[label == i].mean(0) for i in range(8)])
    new, steps = cluster.merge_alike(sizes, centres, 0.97)
    merged = label.copy()
    for s in steps:
        a, b = points[merged == s.target].mean(0), points[merged == s.source].mean(0)
        assert a @ b / np.linalg.norm(a) / np.linalg.norm(b) == pytest.approx(s.similarity, abs=1e-5)
        assert s.similarity > 0.97 and s.target < s.source
        merged[merged == s.source] = s.target
    assert len(set(new.tolist())) == 8 - len(steps) == len(set(merged.tolist()))


def test_sense_clusters(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(3, 8)) * 5
    rows = [("w", f"o{i}", [float(x) for x in centres[i % 3] + rng.normal(size=8) * 0.1]) for i in range(600)] + [("few", "z", [1.0] * 8)]
    df = spark.createDataFrame(rows, "grp string, id string, vec array<float>")
    found = cluster.sense_clusters(df, 8, base_k=12, merge_ratio=0.9, split_ratio=0.9)
    sizes = {r.cluster: r["count"] for r in found.rows.groupBy("cluster").count().collect()}
    assert sorted(sizes.values()) == [200, 200, 200] and sorted(sizes) == [0, 1, 2]
    split = cluster.sense_clusters(df, 8, base_k=12, merge_ratio=0.9, split_ratio=0.1)
    assert split.rows.count() == 600 and all(len(new) == 2 for new in split.splits["w"].values())
    scores = cluster.silhouettes(found.rows).first()
    assert scores.silhouette > 0.9
    assert cluster.sense_clusters(df.limit(0), 8).rows.count() == 0


def test_thresholds():
    assert [cluster.adaptive_k(n) for n in (10, 800, 2000, 5000)] == [6, 10, 14, 20]
    assert [cluster.parts_of(n) for n in (183, 2000, 5000, 13054, 20000)] == [2, 3, 4, 5, 6]
    assert cluster.split_threshold(313184, 0.1, 200) == 31318


def votes_of(spark, pooled):
    rows = spark.createDataFrame([("手", "ming", 0, g) for g in pooled], "word string, dynasty string, local_cluster int, global_cluster int")
    mapping = spark.createDataFrame([("手", "joint", None, 7, "Body", "Limb"), ("手", "local", "ming", 5, "Own", None)], labels.MAPPING_SCHEMA)
    return rows, mapping, labels.majority_vote(rows, mapping).collect()


def test_majority(spark):
    _, _, (vote,) = votes_of(spark, [7, 7, None])
    assert (vote.majority_global, vote.majority_pct, vote.is_mixed, vote.macro, vote.sub) == (7, 100.0, False, "Body", "Limb")
    _, _, (vote,) = votes_of(spark, [7, 7, 3, 3, 1])
    assert (vote.majority_global, vote.majority_pct, vote.is_mixed, vote.macro, vote.sub) == (3, 40.0, True, "NOISE", "G3")
    _, _, (vote,) = votes_of(spark, [7, 7, 7, 3, 1])
    assert vote.majority_pct == 60.0 and not vote.is_mixed


def test_local_labels(spark):
    rows, mapping, _ = votes_of(spark, [7, 7])
    more = rows.unionByName(spark.createDataFrame([("手", "ming", 5, 7), ("手", "ming", 9, None)], rows.schema))
    found = labels.apply_local_labels(more, labels.majority_vote(more, mapping), mapping).collect()
    assert {(r.local_cluster, r.Macro_Category, r.Sub_Category) for r in found} == {(0, "Body", "Limb"), (5, "Own", None), (9, "NOISE", "Unmatched")}


def test_mappings(spark):
    flat = labels.parsed_mappings({"0": ["A", "B"]})
    assert flat == [(labels.SINGLE, "any", None, 0, "A", "B")]
    both = labels.parsed_mappings({"手": {"joint": {"1": ["A", "B"]}, "local": {"ming": {"2": ["C", "D"]}}}, "水": {"3": ["E", "F"]}})
    assert {r[:4] for r in both} == {("手", "joint", None, 1), ("手", "local", "ming", 2), ("水", "any", None, 3)}
    for bad in ({}, [], {"0": ["A"]}):
        with pytest.raises(ValueError):
            labels.parsed_mappings(bad)
    assert labels.find_cluster_column(["x", "label", "Cluster"]) == "Cluster"
    with pytest.raises(ValueError):
        labels.find_cluster_column(["x"])
    assert labels.hand_mapping(spark).count() == 17


def test_sweep(spark):
    configs = sweep.one_factor_configs(spark, (20, 0.95, 0.3), [10, 20], [0.9, 0.95], [0.1, 0.3])
    assert configs.count() == 6 and sweep.unique_configs(configs).count() == 4
    assert sweep.unique_configs(configs).withColumn("r", sweep.run_id("g")).where("r = 'g_k20_m0p95_s0p30'").count() == 1
    assert sweep.baseline_run(configs, (20, 0.95, 0.3)).count() == 3


def test_archive(spark, tmp_path):
    data = {"x_y_wb11.json": {"fulltext": " 天地 "}, "x_y_12.json": [{"text": "甲"}, "乙", {"content": "丙", "text": ""}], "x_y_13.json": {"other": 1}, "x_14.json": {"fulltext": "no urn"}, "notes.txt": {}}
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w:gz") as out:
        for name, content in [*data.items(), ("x_y_15.json", None)]:
            raw = b"{damaged" if content is None else json.dumps(content).encode()
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            out.addfile(info, io.BytesIO(raw))
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "book.tar.gz").write_bytes(whole.getvalue())
    texts = archive.archive_texts(archive.scan_archives(spark, str(folder)), 0)
    assert {(r.urn, r.text) for r in texts.collect()} == {("11", "天地"), ("12", "甲乙丙")}
    parts = tmp_path / "p"
    parts.mkdir()
    half = len(whole.getvalue()) // 2
    (parts / "part_0").write_bytes(whole.getvalue()[:half])
    (parts / "part_1").write_bytes(whole.getvalue()[half:])
    later = archive.archive_texts(archive.scan_split_archive(spark, str(parts)), 1)
    merged = archive.text_map(texts, later.withColumn("text", F.concat("text", F.lit("!"))))
    assert {(r.urn, r.text) for r in merged.collect()} == {("11", "天地!"), ("12", "甲乙丙!")}


def test_tables(spark, tmp_path):
    lines = tmp_path / "r.jsonl"
    lines.write_text('{"word": "手", "sentence": "a"}\nbad\n{"word": "道", "sentence": "b"}\n', encoding="utf-8")
    assert tables.read_json_lines(spark, str(lines)).where("word IS NOT NULL").count() == 2
    assert tables.read_json_lines(spark, str(lines), first=2).count() == 1
    assert tables.read_bundle(spark, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([("NA", 1, "ming", "手"), ("x,\"y", 2, "qing", "道")], "sentence string, n int, dynasty_category string, word string")
    tables.export_csv(df, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    assert sorted(r.sentence for r in tables.read_assignments(spark, str(tmp_path / "x.csv")).collect()) == ["NA", 'x,"y']
    tables.write_records(df, str(tmp_path / "out"))
    tables.write_records(df, str(tmp_path / "out"), resume=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    assert tables.markdown_table(df.select("n")).count("|") == 8
    tables.append_processed(df.select(F.col("word").alias("text_id")), str(tmp_path / "done"))
    assert tables.processed(spark, str(tmp_path / "done")).count() == 2
    assert tables.processed(spark, str(tmp_path / "nothing")).count() == 0


def test_runner(spark, tmp_path):
    assert pipeline.stage_range("clean2", "postprocess") == ("clean2", "local", "global", "label_template", "global_plot")
    run = pipeline.Run(str(tmp_path), {"extract": lambda: spark.range(3), "sample": lambda: spark.range(2)})
    assert [s["stage"] for s in run.execute()] == ["extract", "sample"] and spark.read.parquet(str(tmp_path / "sample")).count() == 2
    broken = pipeline.Run(str(tmp_path / "b"), {"extract": lambda: 1 / 0})
    with pytest.raises(RuntimeError):
        broken.execute()
    assert json.loads((tmp_path / "b" / "summary.json").read_text())["stages"][0]["success"] is False


def test_pipeline_stages(spark, sf_dir):
    rows = latest.latest_rows(spark.read.parquet(f"{sf_dir}/occurrences.parquet"), ["word", "dynasty_category", "toptitle", "sentence", "vector"])
    settings = pipeline.Settings(base_k=6)
    sample = pipeline.cleaned_sample(rows.drop("vector"), settings)
    whole = pipeline.with_vectors(sample, rows, 64)
    local = pipeline.local_clusters(whole, settings).rows.select(F.col("id").alias("occ_id"), F.col("cluster").alias("local_cluster"))
    pooled = pipeline.global_clusters(whole, settings).rows.select(F.col("id").alias("occ_id"), F.col("cluster").alias("global_cluster"))
    votes, labeled = pipeline.annotated(sample, local, pooled, spark.read.parquet(f"{sf_dir}/label_map.parquet"))
    assert votes.count() > 0 and labeled.where("Macro_Category IS NULL").count() == 0


def test_stream(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/occurrences.parquet").drop("vector")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.occurrence_stream(spark, str(tmp_path / "in"), source.schema, files=1)
    query = ingest.written(ingest.unique_stream(ingest.cleaned_stream(stream), ["occ_id", "load_seq"], "extracted_at", "400 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    batch = ingest.cleaned_stream(source).select("occ_id", "load_seq").distinct().count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch


def test_flat_document_serves_the_one_word(spark, tmp_path):
    (tmp_path / "flat.json").write_text('{"0": ["Body", "Hand"], "1": ["Skill", "Expert"]}', encoding="utf-8")
    mapping = labels.read_mapping(spark, "flat.json", str(tmp_path))
    schema = "word string, dynasty string, local_cluster int, global_cluster int"
    one = spark.createDataFrame([("手", "qing", 0, 0), ("手", "qing", 0, 0), ("手", "qing", 1, 1), ("手", "qing", 2, 7)], schema)
    assert [r.Macro_Category for r in labels.apply_global_labels(one, "global_cluster", mapping).orderBy("global_cluster").collect()] == ["Body", "Body", "Skill", "Other"]
    votes = labels.majority_vote(one, mapping)
    assert [(r.macro, r["sub"]) for r in votes.orderBy("local_cluster").collect()] == [("Body", "Hand"), ("Skill", "Expert"), ("NOISE", "G7")]
    assert {r.Macro_Category for r in labels.apply_local_labels(one, votes, mapping).collect()} == {"Body", "Skill", "NOISE"}
    two = one.unionByName(spark.createDataFrame([("水", "qing", 0, 0)], schema))
    assert {r.Macro_Category for r in labels.apply_global_labels(two, "global_cluster", mapping).collect()} == {"Other"}


def test_damaged_members_are_passed_over():
    """A destroyed header loses its member only; members come in batches of bounded size."""
    import io
    import tarfile

    from glyphdrift.sources import archive

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as pack:
        for i in range(6):
            body = (b'{"fulltext": "' + str(i).encode() * 2_500_000 + b'"}') if i in (1, 4) else b'{"fulltext": "x"}'
            info = tarfile.TarInfo(f"a_b_{i}.json")
            info.size = len(body)
            pack.addfile(info, io.BytesIO(body))
    raw = bytearray(out.getvalue())
    at = raw.index(b"a_b_2.json")
    raw[at : at + 512] = b"\xff" * 512
    parts = [bytes(raw[i : i + 700_001]) for i in range(0, len(raw), 700_001)]  # as an archive in several files
    batches = list(archive.read_members("p", iter(parts)))
    names = [m for b in batches for m in b.column(2).to_pylist()]
    assert [n for n in names if n != "a_b_2.json"] == [f"a_b_{i}.json" for i in (0, 1, 3, 4, 5)]
    assert len(batches) > 1 and [p for b in batches for p in b.column(1).to_pylist()] == list(range(len(names)))


def test_kmeans_finds_apart_groups_and_settles():
    from glyphdrift.operators import cluster

    rng = np.random.default_rng(3)
    centres = rng.normal(0, 8, (6, 5))
    points = np.concatenate([c + rng.normal(0, 0.3, (n, 5)) for c, n in zip(centres, (4000, 30, 500, 90, 1500, 60))])
    found = cluster.lloyd(points, 6, 1)
    assert max(np.min(np.linalg.norm(found - c, axis=1)) for c in centres) < 0.2
    assert np.allclose(cluster.settled(points, found), found, atol=1e-2)


def test_a_stage_that_is_there_is_not_built(spark, tmp_path):
    from glyphdrift.plans import pipeline

    built = []
    stages = {"extract": lambda: built.append("extract") or spark.range(3), "clean1": lambda: built.append("clean1") or spark.range(2)}
    pipeline.Run(str(tmp_path), dict(stages)).execute()
    log = pipeline.Run(str(tmp_path), dict(stages)).execute(skip_existing=True)
    assert built == ["extract", "clean1"] and [e["message"] for e in log] == ["skipped", "skipped"]


def test_documents_sections_and_markdown(spark):
    from glyphdrift.operators import reports

    rows = spark.createDataFrame(
        [("w", "p" if i % 2 else "q", i % 3 and 1, f"s{i:02d}|x" if i else None, "t", [float(i), 1.0]) for i in range(20)], "word string, period string, c int, sentence string, id string, v array<double>"
    ).withColumn("id", F.format_string("%03d", F.monotonically_increasing_id()))
    doc = reports.statistics_documents(rows, ["word"], "c", "id", "v", ["sentence"], core=2, boundary=1).first()
    assert doc.n_samples == 20 and doc.k_final == 2 and {k: v["count"] for k, v in doc.cluster_sentences.items()} == {"0": 7, "1": 13}
    assert all(len(v["core"]) == 2 and len(v["boundary"]) == 1 for v in doc.cluster_sentences.values())
    sections = {r.c: r.section for r in reports.label_sections(rows, ["word"], "c", "period", "sentence", "id", samples=2).collect()}
    assert sections[0].startswith("## w C0 (7)\np: 3, q: 4\n- ")
    lines = [r.line for r in reports.markdown(rows.select("word", "sentence"), ["sentence"]).collect()]
    assert lines[0] == "| word | sentence |" and len(lines) == 22 and all(x.count("|") == 3 for x in lines)
    assert reports.statistics_documents(rows.limit(0), ["word"], "c", "id", "v", ["sentence"]).count() == 0


def _swept_together(spark, monkeypatch, parts):
    """A small sweep whose two over-clusterings wait for each other; both orders of work give the same figures."""
    rng = np.random.default_rng(3)
    data = [(f"g{i % 2}", f"r{i:03d}", [float(x) for x in rng.normal(size=4) + 5 * (i % 3)]) for i in range(120)]
    rows = spark.createDataFrame(data, "grp string, id string, vec array<float>")
    configs = sweep.one_factor_configs(spark, (4, 0.95, 0.3), [4, 12], [0.95], [0.3])
    figures = lambda: sorted((r.grp, r.k, r.k_final, r.n_samples, round(r.silhouette, 9)) for r in pipeline.sweep_results(rows, configs, 4, parts).collect())
    alone, barrier, over = figures(), threading.Barrier(2), cluster.over_clustered

    def waiting(*args, **named):
        barrier.wait(30)
        return over(*args, **named)

    monkeypatch.setattr(cluster, "over_clustered", waiting)
    assert figures() == alone and len(alone) == 4


def test_over_clusterings_of_a_pooled_sweep_run_together(spark, monkeypatch):
    _swept_together(spark, monkeypatch, 6)


def test_over_clusterings_of_a_sweep_of_periods_run_together(spark, monkeypatch):
    _swept_together(spark, monkeypatch, None)


def test_silhouettes_of_several_clusterings_share_their_rows(spark):
    """One pass over the distances of the sampled rows gives what a pass for each clustering gives, also where one has a single cluster."""
    rng = np.random.default_rng(4)
    rows = [(g, f"{g}{i}", rng.normal(i % 3 * size, 1, 6).tolist(), i % 3) for g, size in (("a", 2.0), ("b", 0.5)) for i in range(70)]
    one = spark.createDataFrame(rows, "grp string, id string, vec array<float>, cluster int")
    runs = [one, one.withColumn("cluster", F.col("cluster") % 2), one.withColumn("cluster", F.when(F.col("grp") == "a", 0).otherwise(F.col("cluster")))]
    for sample in (50, 5_000):
        shared = {(r.run, r.grp): (r.n, r.silhouette) for r in cluster.shared_silhouettes(cluster.sampled_rows(one, sample), runs).collect()}
        single = {(n, r.grp): (r.n, r.silhouette) for n, run in enumerate(runs) for r in cluster.silhouettes(run, sample).collect()}
        assert shared.keys() == single.keys() and shared[2, "a"][1] is None
        assert all(shared[k][0] == n and (v is None or abs(shared[k][1] - v) < 1e-9) for k, (n, v) in single.items())


def test_rounds_read_only_groups_that_still_move(spark, monkeypatch):
    """Small groups are settled in a task; rounds over all rows of the large ones don't send the small ones' vectors to Python again."""
    rng = np.random.default_rng(6)
    counts = {"large": 300, "small": 40}
    rows = spark.createDataFrame([(g, f"{g}{i}", rng.normal(i % 4, 1.5, 5).tolist()) for g, n in counts.items() for i in range(n)], "grp string, id string, vec array<float>")
    monkeypatch.setattr(cluster, "START_ROWS", 100)
    seen, whole = [], cluster.grouped_sums

    def watched(part, measure, size):
        seen.append({r[0] for r in part.select("grp").distinct().collect()})
        return whole(part, measure, size)

    monkeypatch.setattr(cluster, "grouped_sums", watched)
    found = cluster.grouped_kmeans(rows, {"large": 4, "small": 3}, counts, 5)
    assert seen and all(keys == {"large"} for keys in seen) and found.keys() == counts.keys()


def test_configurations_of_a_sweep_share_their_passes(spark, monkeypatch):
    """The rows of a sweep are made once for all configurations, and every figure is that of the clustering taken alone."""
    rng, made = np.random.default_rng(8), spark.sparkContext.accumulator(0)
    centres = rng.normal(0, 6, (5, 6))
    data = [(f"g{i % 2}", f"r{i:04d}", [float(x) for x in centres[i % 5] + rng.normal(0, 0.5, 6)]) for i in range(900)]
    plain = spark.createDataFrame([*data, ("g0", "zero", [0.0] * 6), ("g0", "short", [1.0]), ("g1", "none", None), ("g1", "nan", [float("nan")] * 6), ("few", "x", [1.0] * 6)], "grp string, id string, vec array<float>")

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    configs = sweep.one_factor_configs(spark, (5, 0.95, 0.3), [5, 8], [0.8, 0.95], [0.1, 0.3])
    found = pipeline.sweep_results(plain.mapInArrow(counted, plain.schema), configs, 6, 2).collect()
    assert made.value == 905 and len(found) == 8
    usable = plain.where("size(vec) = 6 AND NOT isnan(vec[0]) AND id <> 'zero'")
    for k, merge, split in {(r.k, r.merge_ratio, r.split_ratio) for r in found}:
        alone = cluster.sense_clusters(usable, 6, k, merge, split, 2).rows
        scores = {r.grp: r.silhouette for r in cluster.silhouettes(alone).collect()}
        sizes = {r.grp: (r.k, r.n) for r in alone.groupBy("grp").agg(F.countDistinct("cluster").alias("k"), F.count("*").alias("n")).collect()}
        own = {r.grp: r for r in found if (r.k, r.merge_ratio, r.split_ratio) == (k, merge, split)}
        assert own.keys() == scores.keys() == {"g0", "g1"}
        assert all((r.k_final, r.n_samples) == sizes[g] and abs(r.silhouette - scores[g]) < 1e-4 for g, r in own.items())


def test_rounds_of_a_sweep_are_those_of_grouped_kmeans(spark, monkeypatch):
    """Groups above the start's rows go on over all their rows, to the same centroids."""
    from glyphdrift.operators import blocks

    monkeypatch.setattr(cluster, "START_ROWS", 300)
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([("g", f"r{i:04d}", p.tolist()) for i, p in enumerate(rng.normal(size=(3_000, 5)))], "grp string, id string, vec array<float>").localCheckpoint()
    held = blocks.packed(rows, 5).localCheckpoint()
    places = sorted(tuple(r) for r in held.select("grp", *blocks.PLACE).collect())
    fit = blocks.Fit("g", 4, 4, rows=3_000)
    blocks.fitted(held, places, [fit], {}, 5)
    assert np.allclose(fit.centres, cluster.grouped_kmeans(rows, {"g": 4}, {"g": 3_000}, 5)["g"], atol=1e-3)
