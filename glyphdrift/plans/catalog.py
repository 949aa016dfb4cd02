"""Every registered query of the core with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphdrift.functions import text as T
from glyphdrift.functions import vectors as V
from glyphdrift.functions.titles import BRACKETS, EDITION_NOTE, INVISIBLE, VOLUME_NOTE, compat_table
from glyphdrift.operators import analytics, cluster, embed, extract, labels, latest, quality, sampling, skew, sweep
from glyphdrift.plans import pipeline
from glyphdrift.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SIZE = 64
TARGETS = ["手", "水", "道"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


# --- SQL parts -----------------------------------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LATEST = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY occ_id ORDER BY load_seq DESC) AS rn FROM occurrences WHERE occ_id IS NOT NULL) WHERE rn = 1)"
SPACES = "'[\\s\\p{Z}]'"
STRIP = lambda x: f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
FOLD = lambda x: f"translate({x}, {quoted(compat_table()[0])}, {quoted(compat_table()[1])})"
BARE = lambda x: f"regexp_replace({FOLD(x)}, {quoted(INVISIBLE)}, '', 'g')"
PERIOD_KEY = lambda x: f"nullif(lower(trim(regexp_replace({FOLD(x)}, {quoted(INVISIBLE)}, ' ', 'g'))), '')"
INNER = lambda x: f"regexp_replace(regexp_replace({BARE(x)}, {quoted(EDITION_NOTE)}, ''), {quoted(BRACKETS)}, '', 'g')"
WORKS = f"""
WITH last AS {LATEST},
titled AS (SELECT *, {INNER("toptitle")} AS inner_title FROM last),
plain AS (SELECT *, CASE WHEN regexp_replace(inner_title, {quoted(VOLUME_NOTE)}, '') = '' THEN inner_title ELSE regexp_replace(inner_title, {quoted(VOLUME_NOTE)}, '') END AS p FROM titled),
dims AS (SELECT {PERIOD_KEY("dynasty_name")} AS k, min(dynasty_category) AS c FROM dynasty_dim GROUP BY 1),
metas AS (SELECT nullif(regexp_extract(topurn, '[0-9]+'), '') AS num, c, count(*) AS n FROM metadata JOIN dims ON {PERIOD_KEY("from_dynasty_name")} = k GROUP BY ALL),
meta AS (SELECT num, c AS meta_c FROM metas WHERE num IS NOT NULL AND c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY num ORDER BY n DESC, c) = 1),
works AS (
  SELECT plain.*, CASE WHEN p IS NULL OR p = '' OR upper(p) = 'N/A' THEN 'unknown' ELSE p END AS work_title,
         coalesce(nullif(trim(dynasty_category), ''), dims.c, meta_c) AS work_category
  FROM plain LEFT JOIN dims ON {PERIOD_KEY("dynasty")} = dims.k LEFT JOIN meta ON nullif(regexp_extract(reference_id, '[0-9]+'), '') = num)
"""
COUNT = lambda x, c: f"len(regexp_extract_all({x}, {quoted(c)}))"
USABLE = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
PLACE = lambda a, b: f"list_position(vector[{a}:{b}], list_max(vector[{a}:{b}])) - 1"
ASSIGNED = f"(SELECT occ_id, word, dynasty_category AS dynasty, sentence, toptitle, vector, CAST({PLACE(1, 6)} AS INTEGER) AS local_cluster, CAST({PLACE(7, 18)} AS INTEGER) AS global_cluster FROM {LATEST} WHERE {USABLE} AND dynasty_category IS NOT NULL)"
RARE_RE2 = r"[\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}]"


def records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Latest rows with the named columns."""
    return latest.latest_rows(table(spark, sf_dir, "occurrences"), list(columns))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable assignment derived from the vectors: the place of the largest of their first and next components."""
    rows = records(spark, sf_dir, "word", "dynasty_category", "sentence", "toptitle", "vector")
    place = lambda a, n: (F.array_position(F.slice("vector", a, n), F.array_max(F.slice("vector", a, n))) - 1).cast("int")
    usable = rows.where(V.is_usable("vector", SIZE) & F.col("dynasty_category").isNotNull()).withColumnRenamed("dynasty_category", "dynasty")
    return usable.withColumns({"local_cluster": place(1, 6), "global_cluster": place(7, 12)})


# --- Problem 2: keys that hold most rows -----------------------------------------------------------------------------


@query(f"""{WORKS}
SELECT work_category AS dynasty_category, work_title AS toptitle FROM works GROUP BY ALL
HAVING count(*) >= 0.02 * (SELECT count(*) FROM works)""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (table(spark, sf_dir, t) for t in ("occurrences", "metadata", "dynasty_dim"))
    works = skew.dominant_works(*tables)
    return works.selectExpr("work_category AS dynasty_category", "work_title AS toptitle")


@query(f"""{WORKS}
SELECT work_category AS dynasty_category, work_title AS toptitle, count(*) AS n,
       count(CASE WHEN NOT isnan(quality) THEN 1 END) AS n_quality,
       round(avg(CASE WHEN NOT isnan(quality) THEN quality END) + 1e-9, 6) AS mean_quality
FROM works GROUP BY ALL""")
def p2_work_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and mean quality of every work."""
    states = skew.work_states(*(table(spark, sf_dir, t) for t in ("occurrences", "metadata", "dynasty_dim")))
    mean = F.round(F.col("sum_quality") / F.nullif("n_quality", F.lit(0)) + 1e-9, 6)
    return states.select(F.col("work_category").alias("dynasty_category"), F.col("work_title").alias("toptitle"), "n", "n_quality", mean.alias("mean_quality"))


@query(f"""
SELECT dynasty_category, count(*) AS n_pairs, CAST(sum(sentence_index) AS BIGINT) AS sum_sentence_index, CAST(sum(len_title) AS BIGINT) AS sum_len_title
FROM (SELECT dynasty_category, sentence_index, nullif(regexp_extract(reference_id, '[0-9]+'), '') AS num FROM {LATEST})
JOIN (SELECT nullif(regexp_extract(topurn, '[0-9]+'), '') AS num, length(title) AS len_title FROM metadata) USING (num)
GROUP BY dynasty_category""")
def p2_chapter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records and chapters of their work per period, with sums of both sides, without making the pairs."""
    left = records(spark, sf_dir, "dynasty_category", "sentence_index", "reference_id").withColumn("num", F.nullif(F.regexp_extract("reference_id", "[0-9]+", 0), F.lit("")))
    right = table(spark, sf_dir, "metadata").select(F.nullif(F.regexp_extract("topurn", "[0-9]+", 0), F.lit("")).alias("num"), F.length("title").alias("len_title"))
    return skew.eager_join_aggregate(left, right, ["num"], ["dynasty_category"], ["sentence_index"], ["len_title"])


# --- Segmenting and extraction -----------------------------------------------------------------------------------------

SENTENCES = f"list_filter(list_transform(regexp_split_to_array(translate(text, '{{}}　●', ''), '\\n\\n|[。！？；]'), lambda s: {STRIP('s')}), lambda s: s <> '')"


@query(f"""
SELECT doc_id, i - 1 AS sentence_index, parts[i] AS sentence
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, {SENTENCES} AS parts FROM documents))""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.segmented(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "sentence_index", "sentence")


@query("SELECT doc_id, regexp_matches(text, '[。，、；：？！「」『』]') AS is_punctuated FROM documents")
def article_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.is_punctuated("text").alias("is_punctuated"))


@query(f"""
SELECT occ_id, c AS word, i - 1 AS char_pos
FROM (SELECT occ_id, chars, chars[i] AS c, i FROM (SELECT occ_id, string_split(sentence, '') AS chars, unnest(range(1, length(sentence) + 1)) AS i FROM {LATEST}))
WHERE c IN ('手', '水', '道')""")
def target_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.occurrences(records(spark, sf_dir, "sentence"), TARGETS).select("occ_id", "word", "char_pos")


@query("""
SELECT topurn, title, regexp_replace(list_last(string_split(topurn, ':')), '^wb', '') AS urn,
       CASE WHEN regexp_extract(topurn, '[0-9]+') <> '' THEN 'ctext_' || regexp_extract(topurn, '[0-9]+') ELSE regexp_replace(list_last(string_split(topurn, ':')), '^wb', '') END AS reference_id,
       topurn || '_' || coalesce(title, '') AS text_id
FROM metadata""")
def metadata_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "metadata")
    return rows.select("topurn", "title", T.urn("topurn").alias("urn"), T.reference_id("topurn").alias("reference_id"), T.text_id("topurn", "title").alias("text_id"))


CHAPTERS = f"(SELECT m.title, m.topurn, d.c AS dynasty_category, m.topurn || '_' || coalesce(m.title, '') AS text_id, regexp_replace(list_last(string_split(topurn, ':')), '^wb', '') AS urn FROM metadata m JOIN (SELECT {PERIOD_KEY('dynasty_name')} AS k, min(dynasty_category) AS c FROM dynasty_dim GROUP BY 1) d ON {PERIOD_KEY('m.from_dynasty_name')} = d.k)"


@query(f"SELECT dynasty_category, count(*) AS n, count(DISTINCT urn) AS n_urn FROM {CHAPTERS} GROUP BY 1")
def valid_dynasty_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.chapters(table(spark, sf_dir, "metadata"), table(spark, sf_dir, "dynasty_dim"))
    return rows.groupBy("dynasty_category").agg(F.count("*").alias("n"), F.countDistinct("urn").alias("n_urn"))


def _last_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By urn the last sentence that a reference holds."""
    rows = records(spark, sf_dir, "reference_id", "sentence").withColumn("urn", F.regexp_extract("reference_id", "[0-9]+", 0))
    return latest.upsert_last_wins(rows, "urn", "occ_id", "sentence").select(F.col("key").alias("urn"), F.col("sentence").alias("text"))


@query(f"SELECT regexp_extract(reference_id, '[0-9]+') AS key, arg_max(sentence, occ_id) AS sentence FROM {LATEST} GROUP BY 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last_texts(spark, sf_dir).select(F.col("urn").alias("key"), F.col("text").alias("sentence"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by urn: the sentences of a reference, which is one chapter, put together in order."""
    rows = records(spark, sf_dir, "reference_id", "sentence", "sentence_index").withColumn("urn", F.regexp_extract("reference_id", "[0-9]+", 0))
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("sentence_index", F.lit(-1)).alias("i"), "occ_id", "sentence")))
    return rows.where("sentence IS NOT NULL").groupBy("urn").agg(F.array_join(F.transform(parts, lambda p: p["sentence"]), "").alias("text"))


TEXTS = f"(SELECT regexp_extract(reference_id, '[0-9]+') AS urn, string_agg(sentence, '' ORDER BY coalesce(sentence_index, -1), occ_id) AS text FROM {LATEST} WHERE sentence IS NOT NULL GROUP BY 1)"


DONE = "(SELECT DISTINCT topurn || '_' || coalesce(title, '') AS text_id FROM metadata WHERE title LIKE '卷%')"


@query(f"""
SELECT CASE WHEN d.text_id IS NOT NULL THEN 'checkpoint' WHEN t.text IS NULL THEN 'not_found' WHEN NOT regexp_matches(t.text, '[。，、；：？！「」『』]') THEN 'no_punctuation' ELSE 'processed' END AS status, count(*) AS n
FROM {CHAPTERS} c LEFT JOIN {DONE} d USING (text_id) LEFT JOIN {TEXTS} t USING (urn) GROUP BY 1""")
def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by what becomes of them: done before, without text, without punctuation, or processed."""
    metadata = table(spark, sf_dir, "metadata")
    rows = extract.chapters(metadata, table(spark, sf_dir, "dynasty_dim"))
    done = metadata.where("title LIKE '卷%'").select(T.text_id("topurn", "title").alias("text_id"))
    return extract.status_counts(extract.chapter_status(rows, _texts(spark, sf_dir), done))


@query(f"SELECT c.text_id, t.text FROM {CHAPTERS} c JOIN {TEXTS} t USING (urn)")
def metadata_archive_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.chapters(table(spark, sf_dir, "metadata"), table(spark, sf_dir, "dynasty_dim"))
    return rows.join(_texts(spark, sf_dir), "urn").select("text_id", "text")


@query(f"SELECT c.text_id FROM {CHAPTERS} c ANTI JOIN {DONE} d USING (text_id)")
def checkpoint_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = table(spark, sf_dir, "metadata")
    done = metadata.where("title LIKE '卷%'").select(T.text_id("topurn", "title").alias("text_id")).distinct()
    return extract.chapters(metadata, table(spark, sf_dir, "dynasty_dim")).join(done, "text_id", "left_anti").select("text_id")


@query(f"""
SELECT dynasty_category, text_id FROM (SELECT *, row_number() OVER (PARTITION BY dynasty_category ORDER BY text_id) AS rn FROM (SELECT DISTINCT dynasty_category, text_id FROM {CHAPTERS})) WHERE rn <= 50""")
def head_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.chapters(table(spark, sf_dir, "metadata"), table(spark, sf_dir, "dynasty_dim")).select("dynasty_category", "text_id").distinct()
    return sampling.head_per_group(rows, ["dynasty_category"], ["text_id"], 50)


@query(f"""
WITH tokens AS (SELECT occ_id, char_pos, 4 * i AS a, least(4 * i + 4, length(sentence)) AS b FROM (SELECT *, unnest(range(0, (length(sentence) + 3) // 4)) AS i FROM {LATEST} WHERE sentence <> ''))
SELECT occ_id, char_pos, count(*) AS n_tokens, round(sum((least(b, char_pos + 1) - greatest(a, char_pos)) / greatest(1, b - a)), 6) AS weight
FROM tokens WHERE least(b, char_pos + 1) - greatest(a, char_pos) > 0 GROUP BY 1, 2""")
def span_overlap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of four-character tokens that overlap the target character."""
    rows = records(spark, sf_dir, "sentence", "char_pos").where("sentence <> ''")
    n = F.length("sentence")
    tokens = rows.withColumn("a", F.explode(F.sequence(F.lit(0), n - 1, F.lit(4)))).withColumn("b", F.least(F.col("a") + 4, n))
    shared = T.overlap_length("a", "b", "char_pos", F.col("char_pos") + 1)
    both = tokens.withColumn("shared", shared).where("shared > 0")
    return both.groupBy("occ_id", "char_pos").agg(F.count("*").alias("n_tokens"), F.round(F.sum(F.col("shared") / F.greatest(F.lit(1), F.col("b") - F.col("a"))), 6).alias("weight"))


@query()
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character vectors pooled from the tokens of a model-free embedder. The embedder is Python, so there is no SQL."""
    rows = records(spark, sf_dir, "sentence", "char_pos").where(T.contains_any("sentence", TARGETS))
    tokens = embed.token_vectors(rows, "occ_id", "sentence", embed.HashEmbedder)
    return embed.pooled(rows.select(F.col("occ_id").alias("id"), "char_pos"), tokens)


# --- Cleaning ------------------------------------------------------------------------------------------------------------

RUNS = """
chars AS (SELECT occ_id, i, s[i] AS c FROM (SELECT occ_id, string_split(sentence, '') AS s, unnest(range(1, length(sentence) + 1)) AS i FROM last)),
runs AS (SELECT occ_id, c, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY occ_id, c ORDER BY i) AS g FROM chars) GROUP BY occ_id, c, g),
longest AS (SELECT occ_id, max(n) AS longest, max(CASE WHEN c <> chr(10) THEN n END) AS run, count(CASE WHEN n >= 3 AND c <> chr(10) THEN 1 END) AS n_runs FROM runs GROUP BY 1)"""
MARKED = f"regexp_matches(sentence, '[{quality.MARKERS}]')"
SUSPICIOUS = "(coalesce(run, 0) >= 5 OR regexp_matches(sentence, '[A-Za-z]{2,}') OR regexp_matches(sentence, '\\p{Nd}{6,}'))"
UNUSUAL = f"regexp_matches(sentence, '[^\\x{{4E00}}-\\x{{9FFF}}{quality.ALLOWED}\\p{{Nd}}²³¹⁰-⁹₀-₉①-⑨\\s\\p{{Z}}\\x{{85}}\\x{{0B}}\\x{{1C}}-\\x{{1F}}]')"
DETECTED = f"list_filter([CASE WHEN {MARKED} THEN 'ocr_markers' END, CASE WHEN {SUSPICIOUS} THEN 'suspicious_patterns' END, CASE WHEN {UNUSUAL} THEN 'unusual_chars' END, CASE WHEN length(sentence) NOT BETWEEN 5 AND 500 THEN 'length_anomaly' END], lambda e: e IS NOT NULL)"
RULED = f"WITH last AS {LATEST}, {RUNS}, ruled AS (SELECT last.*, longest, run, coalesce(n_runs, 0) AS n_runs FROM last LEFT JOIN longest USING (occ_id))"


@query(f"{RULED} SELECT occ_id, array_to_string({DETECTED}, ',') AS errors FROM ruled")
def ocr_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "sentence").select("occ_id", F.array_join(quality.errors(F.col("sentence")), ",").alias("errors"))


@query(f"{RULED} SELECT e AS reason, word, count(*) AS n FROM (SELECT word, unnest({DETECTED}) AS e FROM ruled) GROUP BY ALL")
def ocr_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "sentence", "word").select("word", quality.errors(F.col("sentence")).alias("errors"))
    return quality.reason_counts(rows, ["word"], "errors")


REMOVED = {
    "conservative": f"CASE WHEN {MARKED} THEN 'ocr_markers' WHEN length(sentence) > 500 THEN 'too_long' WHEN run >= 5 THEN 'excessive_repetition' END",
    "aggressive": f"({DETECTED})[1]",
    "custom": f"CASE WHEN {MARKED} THEN 'ocr_markers' WHEN length(sentence) < 5 THEN 'too_short' WHEN length(sentence) > 500 THEN 'too_long' WHEN {SUSPICIOUS} THEN 'suspicious_patterns' END",
}


def _clean1(mode: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records(spark, sf_dir, "sentence").select("occ_id", quality.removal_reason(F.col("sentence"), mode).alias("reason"))

    run.__name__ = f"clean1_{mode}"
    query(f"{RULED} SELECT occ_id, {REMOVED[mode]} AS reason FROM ruled")(run)


for _mode in REMOVED:
    _clean1(_mode)


@query(f"{RULED} SELECT dynasty_category, count(*) AS total, count(*) - count(r) AS kept, count(r) AS removed FROM (SELECT coalesce(dynasty_category, 'unknown') AS dynasty_category, {REMOVED['conservative']} AS r FROM ruled) GROUP BY ROLLUP (dynasty_category)")
def clean1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and removed records by period and overall."""
    rows = records(spark, sf_dir, "sentence", "dynasty_category").fillna("unknown", ["dynasty_category"])
    return quality.removal_totals(rows.withColumn("r", quality.removal_reason(F.col("sentence"), "conservative")), ["dynasty_category"], "r")


@query(f"{RULED} SELECT dynasty_category, reason, n, round(n * 100.0 / sum(n) OVER (PARTITION BY dynasty_category), 6) AS pct FROM (SELECT dynasty_category, reason, count(*) AS n FROM (SELECT dynasty_category, {REMOVED['custom']} AS reason FROM ruled) WHERE reason IS NOT NULL GROUP BY 1, 2)")
def clean1_reason_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "sentence", "dynasty_category").select("dynasty_category", quality.removal_reason(F.col("sentence"), "custom").alias("reason"))
    return analytics.proportions(rows.where("reason IS NOT NULL"), ["dynasty_category"], "reason").withColumn("pct", F.round("pct", 6))


@query(f"{RULED} SELECT reason, occ_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY occ_id) AS place FROM (SELECT occ_id, {REMOVED['aggressive']} AS reason FROM ruled) WHERE reason IS NOT NULL) WHERE place <= 10")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten records for each reason of the aggressive mode."""
    rows = records(spark, sf_dir, "sentence").select("occ_id", quality.removal_reason(F.col("sentence"), "aggressive").alias("reason"))
    return quality.first_examples(rows, "reason", ["occ_id"])


SEGMENTS = "list_transform(range(0, length(sentence) - 9, 10), lambda i: substring(sentence, CAST(i + 1 AS BIGINT), 10))"
ABNORMAL = f"""CASE WHEN regexp_matches(sentence, '^[\\[{quality.PUNCTUATION[1:-1]}]\\]+$') THEN 'all_punctuation'
 WHEN {COUNT('sentence', ' ')} > length(sentence) * 0.1 THEN 'excessive_whitespace'
 WHEN n_runs >= 3 THEN 'abnormal_repeat_pattern'
 WHEN length(sentence) > 150 AND NOT regexp_matches(sentence, '{quality.PUNCTUATION}') THEN 'overlong_no_punctuation'
 WHEN length(sentence) >= 10 AND len(list_filter({SEGMENTS}, lambda g: NOT regexp_matches(g, '[{quality.COMMON}]'))) > len({SEGMENTS}) * 0.8 THEN 'low_common_chars'
 WHEN length(sentence) > 0 AND {COUNT('sentence', RARE_RE2)} / length(sentence) > 0.3 THEN 'excessive_rare_chars' END"""


@query(f"{RULED} SELECT occ_id, {ABNORMAL} AS pattern FROM ruled")
def abnormal_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "sentence").select("occ_id", quality.abnormal_pattern(F.col("sentence")).alias("pattern"))


def _failed_sql(level: quality.Level) -> str:
    return f"""list_filter([CASE WHEN length(sentence) NOT BETWEEN {level.min_length} AND {level.max_length} THEN 'length' END,
 CASE WHEN length(sentence) = 0 OR len(list_distinct(string_split(sentence, ''))) / length(sentence) < {level.min_distinct} THEN 'uniqueness' END,
 CASE WHEN longest > {level.max_run} AND longest > 1 THEN 'repeat' END,
 CASE WHEN regexp_matches(sentence, '{quality.INVALID}') THEN 'invalid_chars' END,
 CASE WHEN length(sentence) = 0 OR {COUNT('sentence', quality.DIGITS)} / length(sentence) > {level.max_digits} THEN 'digits' END,
 CASE WHEN {ABNORMAL} IS NOT NULL THEN 'patterns' END], lambda e: e IS NOT NULL)"""


def _clean2(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        failed = quality.failed_checks(F.col("sentence"), name)
        rows = records(spark, sf_dir, "sentence").select("occ_id", failed.alias("f"))
        return rows.select("occ_id", F.array_join("f", ",").alias("failed"), F.round(quality.quality_score(F.col("f")), 6).alias("score"))

    run.__name__ = f"quality_score_{name}"
    query(f"{RULED} SELECT occ_id, array_to_string(f, ',') AS failed, round((6 - len(f)) / 6, 6) AS score FROM (SELECT occ_id, {_failed_sql(quality.LEVELS[name])} AS f FROM ruled)")(run)


for _name in quality.LEVELS:
    _clean2(_name)


@query(f"{RULED} SELECT word, reason, count(*) AS n FROM (SELECT word, unnest({_failed_sql(quality.LEVELS['normal'])}) AS reason FROM ruled) GROUP BY ALL")
def quality_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "sentence", "word").select("word", quality.failed_checks(F.col("sentence"), "normal").alias("f"))
    return quality.reason_counts(rows, ["word"], "f")


@query(f"{RULED} SELECT word, count(*) AS total, count(CASE WHEN len(f) = 0 THEN 1 END) AS kept, round(count(CASE WHEN len(f) = 0 THEN 1 END) / count(*), 6) AS keep_ratio FROM (SELECT word, {_failed_sql(quality.LEVELS['normal'])} AS f FROM ruled) GROUP BY ROLLUP (word)")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "sentence", "word").select("word", F.size(quality.failed_checks(F.col("sentence"), "normal")).alias("f"))
    return rows.rollup("word").agg(F.count("*").alias("total"), F.count_if(F.col("f") == 0).alias("kept"), F.round(F.count_if(F.col("f") == 0) / F.count("*"), 6).alias("keep_ratio"))


@query(f"{RULED} SELECT occ_id, length(sentence) AS n_chars, round(len(list_distinct(string_split(sentence, ''))) / length(sentence), 6) AS distinct_ratio, CASE WHEN longest > 1 THEN longest ELSE 0 END AS longest_run, {COUNT('sentence', quality.DIGITS)} AS n_digits FROM ruled")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "sentence")
    return rows.select("occ_id", F.length("sentence").alias("n_chars"), F.round(T.distinct_ratio("sentence"), 6).alias("distinct_ratio"), T.longest_run("sentence").alias("longest_run"), T.count_of("sentence", quality.DIGITS).alias("n_digits"))


# --- Sampling ------------------------------------------------------------------------------------------------------------

STRATA = ["dynasty_category", "word", "toptitle"]
UNIQUE = f"(SELECT dynasty_category, word, sentence, coalesce(toptitle, 'unknown') AS toptitle, occ_id FROM {LATEST} QUALIFY row_number() OVER (PARTITION BY dynasty_category, word, sentence ORDER BY occ_id) = 1)"
CAP = 60
CAPPED = f"(SELECT * FROM {UNIQUE} QUALIFY row_number() OVER (PARTITION BY dynasty_category, word, toptitle ORDER BY md5('42:' || occ_id), occ_id) <= {CAP})"


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "sentence", *STRATA).withColumn("toptitle", sampling.source_title(F.col("toptitle")))
    return sampling.first_of_equal(rows, ["dynasty_category", "word", "sentence"], ["occ_id"])


@query(f"SELECT occ_id, dynasty_category, word, toptitle FROM {UNIQUE}")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique(spark, sf_dir).select("occ_id", *STRATA)


@query(f"SELECT occ_id, dynasty_category, word, toptitle FROM {CAPPED}")
def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capped_strata(_unique(spark, sf_dir), STRATA, "occ_id", CAP).select("occ_id", *STRATA)


@query(f"SELECT occ_id, dynasty_category, word FROM {CAPPED} QUALIFY row_number() OVER (PARTITION BY dynasty_category, word ORDER BY md5('7:' || occ_id), occ_id) <= 500")
def baseline_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = sampling.capped_strata(_unique(spark, sf_dir), STRATA, "occ_id", CAP)
    return sampling.capped_strata(capped, ["dynasty_category", "word"], "occ_id", 500, seed=7).select("occ_id", "dynasty_category", "word")


@query(f"SELECT a.dynasty_category, a.word, a.toptitle, a.n AS original, coalesce(b.n, 0) AS sampled, round(coalesce(b.n, 0) / a.n, 6) AS ratio FROM (SELECT coalesce(dynasty_category, 'unknown') AS dynasty_category, word, toptitle, count(*) AS n FROM {UNIQUE} GROUP BY ALL) a LEFT JOIN (SELECT coalesce(dynasty_category, 'unknown') AS dynasty_category, word, toptitle, count(*) AS n FROM {CAPPED} GROUP BY ALL) b USING (dynasty_category, word, toptitle)")
def source_sample_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = _unique(spark, sf_dir).fillna("unknown", ["dynasty_category"])
    return sampling.sample_ratios(unique, sampling.capped_strata(unique, STRATA, "occ_id", CAP), STRATA).withColumn("ratio", F.round("ratio", 6))


@query(f"SELECT dynasty_category, word, count(*) AS n_sources, CAST(sum(n) AS BIGINT) AS n_rows, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT dynasty_category, word, toptitle, count(*) AS n FROM {CAPPED} GROUP BY ALL) GROUP BY 1, 2")
def source_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = sampling.capped_strata(_unique(spark, sf_dir), STRATA, "occ_id", CAP)
    return sampling.diversity(capped, ["dynasty_category", "word"], "toptitle").withColumn("entropy", F.round("entropy", 6))


@query(f"SELECT dynasty_category, word, toptitle, n, round(n * 100.0 / total, 6) AS percentage, CAST(place AS INTEGER) AS place FROM (SELECT *, sum(n) OVER (PARTITION BY dynasty_category, word) AS total, row_number() OVER (PARTITION BY dynasty_category, word ORDER BY n DESC, toptitle) AS place FROM (SELECT dynasty_category, word, toptitle, count(*) AS n FROM {CAPPED} GROUP BY ALL)) WHERE place <= 10")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = sampling.capped_strata(_unique(spark, sf_dir), STRATA, "occ_id", CAP)
    return sampling.top_sources(capped, ["dynasty_category", "word"], "toptitle").withColumn("percentage", F.round("percentage", 6))


@query(f"SELECT word, count(*) AS matched, count(*) - count(DISTINCT dynasty_category || '|' || sentence) AS duplicates, count(DISTINCT toptitle) AS n_toptitles FROM (SELECT * REPLACE (coalesce(dynasty_category, 'unknown') AS dynasty_category) FROM {LATEST}) GROUP BY word")
def sampling_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "sentence", *STRATA).fillna("unknown", ["dynasty_category"])
    unique = F.countDistinct("dynasty_category", "sentence")
    return rows.groupBy("word").agg(F.count("*").alias("matched"), (F.count("*") - unique).alias("duplicates"), F.countDistinct("toptitle").alias("n_toptitles"))


@query(f"""WITH one AS {LATEST}, last AS (SELECT * FROM one), {RUNS},
ruled AS (SELECT last.*, longest, run, coalesce(n_runs, 0) AS n_runs FROM last LEFT JOIN longest USING (occ_id)),
kept AS (SELECT * FROM ruled WHERE {REMOVED['conservative']} IS NULL),
uniq AS (SELECT * REPLACE (coalesce(toptitle, 'unknown') AS toptitle) FROM kept QUALIFY row_number() OVER (PARTITION BY dynasty_category, word, sentence ORDER BY occ_id) = 1),
capped AS (SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY dynasty_category, word, toptitle ORDER BY md5('42:' || occ_id), occ_id) <= {CAP})
SELECT occ_id, dynasty_category, word, toptitle FROM capped WHERE len({_failed_sql(quality.LEVELS['normal'])}) = 0""")
def cleaned_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four stages as one plan."""
    rows = records(spark, sf_dir, "sentence", *STRATA)
    return pipeline.cleaned_sample(rows, pipeline.Settings(cap=CAP)).select("occ_id", *STRATA)


# --- Vectors and clusters ----------------------------------------------------------------------------------------------------

CENTROIDS = f"(SELECT word, global_cluster, size, list(m ORDER BY i) AS centroid FROM (SELECT word, global_cluster, i, avg(CAST(vector[i] AS DOUBLE)) AS m, count(*) AS size FROM (SELECT *, unnest(range(1, 65)) AS i FROM {ASSIGNED}) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)"
DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(vector[i] AS DOUBLE) - centroid[i], 2))))"


@query(f"SELECT word, global_cluster, size, list_transform(centroid, lambda x: round(x + 3e-8, 5)) AS centroid FROM {CENTROIDS}")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = V.centroids(assignments(spark, sf_dir), ["word", "global_cluster"], "vector")
    return centres.withColumn("centroid", F.transform("centroid", lambda x: F.round(x + 3e-8, 5)))


@query(f"SELECT a.word, a.global_cluster AS low, b.global_cluster AS high, round(list_cosine_similarity(a.centroid, b.centroid), 5) AS similarity FROM {CENTROIDS} a JOIN {CENTROIDS} b ON a.word = b.word AND a.global_cluster < b.global_cluster")
def centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = V.centroids(assignments(spark, sf_dir), ["word", "global_cluster"], "vector")
    pairs = cluster.centroid_pairs(centres, ["word"], "global_cluster")
    return pairs.select("word", "low", "high", F.round(V.cosine(F.col("low_centroid"), F.col("high_centroid")), 5).alias("similarity"))


@query(f"SELECT word, low, high, similarity FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, low, high) AS rn FROM (SELECT a.word, a.global_cluster AS low, b.global_cluster AS high, round(list_cosine_similarity(a.centroid, b.centroid), 5) AS similarity FROM {CENTROIDS} a JOIN {CENTROIDS} b ON a.word = b.word AND a.global_cluster < b.global_cluster)) WHERE rn = 1")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of clusters that merging would join first."""
    return sampling.head_per_group(centroid_cosine(spark, sf_dir).withColumn("less", -F.col("similarity")), ["word"], ["less", "low", "high"], 1).drop("less")


@query(f"SELECT word, occ_id, kind, CAST(place AS INTEGER) AS place FROM (SELECT word, global_cluster, occ_id, 'core' AS kind, row_number() OVER (PARTITION BY word, global_cluster ORDER BY dist, occ_id) AS place FROM (SELECT *, {DIST} AS dist FROM {ASSIGNED} JOIN {CENTROIDS} USING (word, global_cluster)) QUALIFY place <= 5 UNION ALL SELECT word, global_cluster, occ_id, 'boundary', 4 - row_number() OVER (PARTITION BY word, global_cluster ORDER BY dist DESC, occ_id DESC) AS place FROM (SELECT *, {DIST} AS dist FROM {ASSIGNED} JOIN {CENTROIDS} USING (word, global_cluster)) WHERE size > 8 QUALIFY place >= 1)")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assignments(spark, sf_dir)
    keys = ["word", "global_cluster"]
    return cluster.representatives(rows, V.centroids(rows, keys, "vector"), keys, "vector", "occ_id", core=5).select("word", "occ_id", "kind", "place")


@query(f"SELECT word, dynasty, n, CASE WHEN n < 800 THEN greatest(5, 20 // 3) WHEN n < 2000 THEN greatest(8, 20 // 2) WHEN n < 5000 THEN greatest(12, 14) ELSE 20 END AS k, greatest(CAST(floor(n * 0.3) AS BIGINT), 100) AS threshold, CASE WHEN n >= 20000 THEN 6 WHEN n >= 10000 THEN 5 WHEN n >= 5000 THEN 4 WHEN n >= 2000 THEN 3 ELSE 2 END AS parts FROM (SELECT word, dynasty, count(*) AS n FROM {ASSIGNED} GROUP BY ALL)")
def split_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial clusters, split threshold and parts by group size."""
    n = F.col("n")
    counts = assignments(spark, sf_dir).groupBy("word", "dynasty").agg(F.count("*").alias("n"))
    tiers = [(800, cluster.adaptive_k(0)), (2000, cluster.adaptive_k(800)), (5000, cluster.adaptive_k(2000))]
    k = F.lit(cluster.adaptive_k(5000))
    for least, value in reversed(tiers):
        k = F.when(n < least, value).otherwise(k)
    return counts.select("word", "dynasty", "n", k.alias("k"), F.greatest(F.floor(n * 0.3), F.lit(100)).alias("threshold"), cluster.sub_k(n).alias("parts"))


@query(f"SELECT word, global_cluster, CAST(dense_rank() OVER (PARTITION BY word ORDER BY global_cluster) - 1 AS INTEGER) AS new_cluster, count(*) AS n FROM {ASSIGNED} GROUP BY word, global_cluster")
def dense_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assignments(spark, sf_dir).select("word", "global_cluster")
    return cluster.dense_relabel(rows, ["word"], "global_cluster").groupBy("word", "global_cluster", "new_cluster").agg(F.count("*").alias("n"))


@query("SELECT label, CAST(i AS INTEGER) AS i, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2")
def embedding_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every component by label, from the table of embeddings."""
    centres = V.centroids(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return centres.select("label", F.posexplode("centroid").alias("i", "mean")).select("label", (F.col("i") + 1).alias("i"), F.round("mean", 5).alias("mean"))


def _clusterable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "word", "dynasty_category", "vector").where(V.is_usable("vector", SIZE))


@query()
def local_sense_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the clusters of each word and period. Iterative, so there is no SQL."""
    found = pipeline.local_clusters(_clusterable(spark, sf_dir), pipeline.Settings())
    return found.rows.groupBy("grp", "cluster").agg(F.count("*").alias("size"))


@query()
def global_sense_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the clusters of each word over all periods. Iterative, so there is no SQL."""
    found = pipeline.global_clusters(_clusterable(spark, sf_dir), pipeline.Settings())
    return found.rows.groupBy("grp", "cluster").agg(F.count("*").alias("size"))


@query()
def merge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of merging the over-clusters of each word. Iterative, so there is no SQL."""
    found = pipeline.global_clusters(_clusterable(spark, sf_dir), pipeline.Settings(merge_ratio=0.8))
    steps = [(g, m.step, m.source, m.target, m.similarity, m.source_size, m.target_size) for g, ms in found.merges.items() for m in ms]
    return spark.createDataFrame(steps, "grp string, step int, source int, target int, similarity double, source_size bigint, target_size bigint")


@query()
def silhouette_by_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled silhouette of each word's clusters. Iterative, so there is no SQL."""
    return cluster.silhouettes(pipeline.global_clusters(_clusterable(spark, sf_dir), pipeline.Settings()).rows)


@query()
def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal coordinates on axes shared by all records. Eigenvectors can't be had in SQL."""
    rows = _clusterable(spark, sf_dir).select(F.lit("all").alias("grp"), F.col("occ_id").alias("id"), F.col("vector").alias("vec"))
    found = cluster.moments(rows, SIZE)
    if not found:
        return spark.createDataFrame([], "grp string, id string, PC1 double, PC2 double")
    return cluster.projected(rows, cluster.principal_axes(*found["all"], 2), SIZE)


# --- Labels --------------------------------------------------------------------------------------------------------------------

JOINT = "(SELECT word, cluster, min({'m': macro, 's': sub}) AS p FROM label_map WHERE scope = 'joint' GROUP BY 1, 2)"
OWN = "(SELECT word, dynasty, cluster AS local_cluster, min({'m': macro, 's': sub}) AS o FROM label_map WHERE scope = 'local' AND dynasty IS NOT NULL GROUP BY 1, 2, 3)"
POOLED = f"(SELECT word, dynasty, sentence, arg_max(global_cluster, occ_id) AS global_cluster FROM {ASSIGNED} GROUP BY 1, 2, 3)"
MATCHED = f"(SELECT l.* EXCLUDE (global_cluster), p.global_cluster FROM {ASSIGNED} l LEFT JOIN {POOLED} p USING (word, dynasty, sentence))"
VOTES = f"""
counts AS (SELECT word, dynasty, local_cluster, global_cluster, count(*) AS n FROM {MATCHED} WHERE global_cluster IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY word, dynasty, local_cluster) AS total, row_number() OVER (PARTITION BY word, dynasty, local_cluster ORDER BY n DESC, global_cluster) AS rn FROM counts),
votes AS (SELECT r.word, r.dynasty, r.local_cluster, CAST(total AS BIGINT) AS total_sentences, global_cluster AS majority_global, round(n * 100.0 / total, 1) AS majority_pct, n * 100.0 / total < 60 AS is_mixed,
  CASE WHEN p IS NULL THEN 'NOISE' ELSE p.m END AS macro, CASE WHEN p IS NULL THEN 'G' || global_cluster ELSE p.s END AS sub
  FROM ranked r LEFT JOIN {JOINT} j ON r.word = j.word AND r.global_cluster = j.cluster WHERE rn = 1)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local rows with the pooled cluster of the same text."""
    rows = assignments(spark, sf_dir)
    pooled = rows.select("word", "dynasty", "sentence", "occ_id", "global_cluster")
    return labels.matched_clusters(rows.drop("global_cluster", "vector"), pooled, ["word", "dynasty", "sentence"], "occ_id")


@query(f"SELECT word, dynasty, count(*) AS n, count(CASE WHEN global_cluster IS NULL THEN 1 END) AS unmatched FROM {MATCHED} GROUP BY 1, 2")
def local_global_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).groupBy("word", "dynasty").agg(F.count("*").alias("n"), F.count_if(F.col("global_cluster").isNull()).alias("unmatched"))


@query(f"WITH {VOTES} SELECT * FROM votes")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.majority_vote(_matched(spark, sf_dir), table(spark, sf_dir, "label_map")).drop("distribution")


@query(f"WITH {VOTES} SELECT word, dynasty, local_cluster, majority_pct FROM votes WHERE is_mixed")
def mixed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = labels.majority_vote(_matched(spark, sf_dir), table(spark, sf_dir, "label_map"))
    return labels.mixed_clusters(votes).select("word", "dynasty", "local_cluster", "majority_pct")


@query(f"WITH {VOTES} SELECT r.word, r.dynasty, r.local_cluster, r.global_cluster, r.n, round(r.n * 100.0 / r.total, 1) AS pct, CAST(rn AS INTEGER) AS place FROM ranked r")
def vote_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = labels.majority_vote(_matched(spark, sf_dir), table(spark, sf_dir, "label_map"))
    rows = votes.select("word", "dynasty", "local_cluster", F.posexplode("distribution").alias("at", "d"))
    return rows.select("word", "dynasty", "local_cluster", "d.global_cluster", "d.n", "d.pct", (F.col("at") + 1).alias("place"))


# The same on the whole pooled assignment. Every latest record takes part; those without usable vector or period have no
# cluster of their own, cast no vote and may stay unmatched.


def _whole(sql: str) -> str:
    every = f"(SELECT r.occ_id, r.word, r.dynasty_category AS dynasty, r.sentence, a.local_cluster FROM {LATEST} r LEFT JOIN {ASSIGNED} a USING (occ_id))"
    return sql.replace(MATCHED, f"(SELECT l.*, p.global_cluster FROM {every} l LEFT JOIN {POOLED} p USING (word, dynasty, sentence))").replace("WHERE global_cluster IS NOT NULL", "WHERE global_cluster IS NOT NULL AND local_cluster IS NOT NULL")


def _matched_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assignments(spark, sf_dir)
    every = records(spark, sf_dir, "word", "dynasty_category", "sentence").withColumnRenamed("dynasty_category", "dynasty").join(rows.select("occ_id", "local_cluster"), "occ_id", "left")
    return labels.matched_clusters(every, rows.select("word", "dynasty", "sentence", "occ_id", "global_cluster"), ["word", "dynasty", "sentence"], "occ_id")


def _votes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    voters = _matched_whole(spark, sf_dir).where("local_cluster IS NOT NULL")
    return labels.majority_vote(voters, table(spark, sf_dir, "label_map"))


@query(_whole(SQL["local_global_join"]))
def local_global_join_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched_whole(spark, sf_dir).groupBy("word", "dynasty").agg(F.count("*").alias("n"), F.count_if(F.col("global_cluster").isNull()).alias("unmatched"))


@query(_whole(SQL["majority_vote"]))
def majority_vote_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes_whole(spark, sf_dir).drop("distribution")


@query(_whole(SQL["mixed_clusters"]))
def mixed_clusters_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.mixed_clusters(_votes_whole(spark, sf_dir)).select("word", "dynasty", "local_cluster", "majority_pct")


@query(_whole(SQL["vote_distribution"]))
def vote_distribution_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _votes_whole(spark, sf_dir).select("word", "dynasty", "local_cluster", F.posexplode("distribution").alias("at", "d"))
    return rows.select("word", "dynasty", "local_cluster", "d.global_cluster", "d.n", "d.pct", (F.col("at") + 1).alias("place"))


@query(SQL["dense_relabel"])
def dense_relabel_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assignments(spark, sf_dir).select("word", "global_cluster")
    return cluster.dense_relabel(rows, ["word"], "global_cluster").groupBy("word", "global_cluster", "new_cluster").agg(F.count("*").alias("n"))


LABELED = f"(SELECT a.*, CASE WHEN p IS NULL THEN 'Other' ELSE p.m END AS macro, CASE WHEN p IS NULL THEN 'Other' ELSE p.s END AS sub FROM {ASSIGNED} a LEFT JOIN {JOINT} j ON a.word = j.word AND a.global_cluster = j.cluster)"


@query(f"SELECT occ_id, global_cluster AS Cluster_ID, macro AS Macro_Category, sub AS Sub_Category, sub AS Label FROM {LABELED}")
def apply_labels_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    labeled = labels.apply_global_labels(assignments(spark, sf_dir), "global_cluster", table(spark, sf_dir, "label_map"))
    return labeled.select("occ_id", "Cluster_ID", "Macro_Category", "Sub_Category", "Label")


@query(f"""WITH {VOTES} SELECT occ_id, m.local_cluster AS Cluster_ID, CASE WHEN o IS NOT NULL THEN o.m ELSE coalesce(v.macro, 'NOISE') END AS Macro_Category,
 CASE WHEN o IS NOT NULL THEN o.s WHEN v.macro IS NOT NULL THEN v.sub ELSE 'Unmatched' END AS Sub_Category
 FROM {MATCHED} m LEFT JOIN {OWN} w USING (word, dynasty, local_cluster) LEFT JOIN votes v USING (word, dynasty, local_cluster)""")
def apply_labels_local_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping, matched = table(spark, sf_dir, "label_map"), _matched(spark, sf_dir)
    labeled = labels.apply_local_labels(matched, labels.majority_vote(matched, mapping), mapping)
    return labeled.select("occ_id", "Cluster_ID", "Macro_Category", "Sub_Category")


@query(_whole(SQL["apply_labels_local_override"]))
def apply_labels_local_override_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    labeled = labels.apply_local_labels(_matched_whole(spark, sf_dir), _votes_whole(spark, sf_dir), table(spark, sf_dir, "label_map"))
    return labeled.select("occ_id", "Cluster_ID", "Macro_Category", "Sub_Category")


@query(f"SELECT occ_id, 'Unlabeled' AS Macro_Category, 'C' || global_cluster AS Sub_Category, 'C' || global_cluster AS Label FROM {ASSIGNED}")
def plain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.plain_labels(assignments(spark, sf_dir), "global_cluster").select("occ_id", "Macro_Category", "Sub_Category", "Label")


@query("SELECT word, dynasty, cluster, macro, sub FROM label_map WHERE scope = 'joint'")
def joint_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.scoped(table(spark, sf_dir, "label_map"), "joint").select("word", "dynasty", "cluster", "macro", "sub")


@query(f"SELECT word, '{{\"joint\":{{' || string_agg('\"' || c || '\":[\"\",\"\"]', ',' ORDER BY c) || '}}}}' AS skeleton FROM (SELECT DISTINCT word, global_cluster AS c FROM {ASSIGNED}) GROUP BY word")
def label_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_skeleton(assignments(spark, sf_dir), cluster="global_cluster")


@query(f"WITH {VOTES}, sizes AS (SELECT word, dynasty, local_cluster, count(*) AS size FROM {ASSIGNED} GROUP BY 1, 2, 3) SELECT word, dynasty, local_cluster, size, concat_ws(' / ', macro, sub) || CASE WHEN is_mixed THEN ' (MIXED)' ELSE '' END AS hint FROM sizes LEFT JOIN votes USING (word, dynasty, local_cluster)")
def local_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = labels.majority_vote(_matched(spark, sf_dir), table(spark, sf_dir, "label_map"))
    return labels.local_template(assignments(spark, sf_dir), votes)


@query(_whole(SQL["local_template"]))
def local_template_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.local_template(assignments(spark, sf_dir), _votes_whole(spark, sf_dir))


@query("SELECT word, dynasty, silhouette FROM local_stats WHERE silhouette IS NOT NULL QUALIFY row_number() OVER (PARTITION BY word, dynasty ORDER BY coalesce(n_samples, -1) DESC, silhouette DESC) = 1")
def period_silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.period_silhouettes(table(spark, sf_dir, "local_stats"))


# --- Figures over labelled clusters -----------------------------------------------------------------------------------------


@query(f"SELECT word, global_cluster, dynasty, count(*) AS n FROM {ASSIGNED} GROUP BY ALL")
def cluster_period_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.period_distribution(assignments(spark, sf_dir), ["word", "global_cluster"], "dynasty")


COMPOSED = ", ".join(f"round(count(CASE WHEN dynasty = '{p}' THEN 1 END) * 100.0 / count(*), 6) AS {p.replace('-', '_')}" for p in analytics.PERIODS)


@query(f"SELECT word, global_cluster, {COMPOSED} FROM {ASSIGNED} GROUP BY 1, 2")
def composition_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.composition(assignments(spark, sf_dir), ["word", "global_cluster"], "dynasty")
    return rows.select("word", "global_cluster", *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with a position: the first two components of their vectors."""
    labeled = labels.apply_global_labels(assignments(spark, sf_dir), "global_cluster", table(spark, sf_dir, "label_map"))
    return labeled.withColumns({"PC1": F.col("vector")[0].cast("double"), "PC2": F.col("vector")[1].cast("double")})


@query(f"SELECT word, global_cluster, macro AS Macro_Category, sub AS Sub_Category, round(avg(CAST(vector[1] AS DOUBLE)), 5) AS x, round(avg(CAST(vector[2] AS DOUBLE)), 5) AS y, count(*) AS n FROM {LABELED} WHERE macro <> 'NOISE' GROUP BY 1, 2, 3, 4")
def label_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.label_centres(_placed(spark, sf_dir), ["word", "global_cluster", "Macro_Category", "Sub_Category"])
    return rows.withColumns({"x": F.round("x", 5), "y": F.round("y", 5)})


@query(f"SELECT word, global_cluster, macro AS Macro_Category, sub AS Sub_Category, count(*) AS n FROM {LABELED} l WHERE macro <> 'NOISE' AND EXISTS (SELECT 1 FROM {ASSIGNED} a WHERE a.word = l.word AND a.global_cluster = l.global_cluster AND a.dynasty = 'republican') GROUP BY 1, 2, 3, 4")
def visible_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of the clusters that occur in one period."""
    rows = _placed(spark, sf_dir)
    centres = analytics.label_centres(rows, ["word", "global_cluster", "Macro_Category", "Sub_Category"])
    return analytics.visible_centres(centres, rows.where("dynasty = 'republican'"), ["word", "global_cluster"]).drop("x", "y")


@query(f"SELECT word, period_ord, round(x, 5) AS x, round(y, 5) AS y, round(x - lag(x) OVER w, 4) AS dx, round(y - lag(y) OVER w, 4) AS dy FROM (SELECT word, period_ord, avg(CAST(vector[1] AS DOUBLE)) AS x, avg(CAST(vector[2] AS DOUBLE)) AS y FROM {ASSIGNED} JOIN (SELECT DISTINCT dynasty_category AS dynasty, period_ord FROM dynasty_dim) USING (dynasty) GROUP BY 1, 2) WINDOW w AS (PARTITION BY word ORDER BY period_ord)")
def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "dynasty_dim").select(F.col("dynasty_category").alias("dynasty"), "period_ord").distinct()
    rows = analytics.trajectory(_placed(spark, sf_dir).join(F.broadcast(order), "dynasty"), ["word"], "period_ord")
    return rows.select("word", "period_ord", *[F.round(c, 5).alias(c) for c in "xy"], *[F.round(c, 4).alias(c) for c in ("dx", "dy")])


@query(f"SELECT word, macro AS Macro_Category, n, round(n * 100.0 / sum(n) OVER (PARTITION BY word), 6) AS pct FROM (SELECT word, macro, count(*) AS n FROM {LABELED} GROUP BY 1, 2)")
def macro_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.proportions(_placed(spark, sf_dir), ["word"], "Macro_Category").withColumn("pct", F.round("pct", 6))


RANGE = lambda i: f"round(min(v{i}) - 0.05 * (max(v{i}) - min(v{i})), 5) AS {'xy'[i - 1]}_min, round(max(v{i}) + 0.05 * (max(v{i}) - min(v{i})), 5) AS {'xy'[i - 1]}_max"


@query(f"SELECT word, {RANGE(1)}, {RANGE(2)} FROM (SELECT word, CAST(vector[1] AS DOUBLE) AS v1, CAST(vector[2] AS DOUBLE) AS v2 FROM {ASSIGNED}) GROUP BY word")
def plot_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.plot_ranges(_placed(spark, sf_dir), ["word"])
    return rows.select("word", *[F.round(c, 5).alias(c) for c in rows.columns[1:]])


@query(f"SELECT macro, ({list(analytics.COLOURS)})[CAST((row_number() OVER (ORDER BY macro) - 1) % {len(analytics.COLOURS)} + 1 AS INTEGER)] AS colour FROM (SELECT DISTINCT macro FROM label_map)")
def label_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.label_colours(table(spark, sf_dir, "label_map"), "macro")


PERIOD_CASE = "CASE dynasty_category " + " ".join(f"WHEN '{p}' THEN '{n}'" for p, n in zip(analytics.PERIODS, analytics.PERIOD_NAMES)) + " ELSE dynasty_category END"


@query(f"SELECT DISTINCT word, CASE word WHEN '手' THEN '''shǒu'' 手' WHEN '道' THEN '''dào'' 道' WHEN '水' THEN '''shuǐ'' 水' ELSE word END AS word_name, {PERIOD_CASE} AS period FROM {LATEST}")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "word", "dynasty_category")
    return rows.select("word", analytics.character_name("word").alias("word_name"), analytics.period_name("dynasty_category").alias("period")).distinct()


# --- Sweeps and statistics of earlier runs --------------------------------------------------------------------------------------


@query("SELECT word, round(sum(silhouette * n_samples) / sum(n_samples), 6) AS silhouette, round(sum(k_final * n_samples) / sum(n_samples), 6) AS k_final, CAST(sum(n_samples) AS BIGINT) AS n_samples FROM local_stats WHERE n_samples > 0 AND silhouette IS NOT NULL AND k_final IS NOT NULL GROUP BY word")
def sweep_weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sweep.weighted_metrics(table(spark, sf_dir, "local_stats"), ["word"])
    return rows.withColumns({"silhouette": F.round("silhouette", 6), "k_final": F.round("k_final", 6)})


@query("WITH best AS (SELECT word, dynasty, silhouette, k_final FROM local_stats WHERE silhouette IS NOT NULL QUALIFY row_number() OVER (PARTITION BY word ORDER BY silhouette DESC, k_final, dynasty) = 1), base AS (SELECT word, silhouette AS s, k_final AS k FROM local_stats WHERE dynasty = 'qing') SELECT b.word, b.dynasty, b.silhouette, b.k_final, round(b.silhouette - s, 6) AS delta_silhouette, b.k_final - k AS delta_k_final FROM best b LEFT JOIN base USING (word)")
def sweep_best_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run of each word against a baseline run."""
    runs = table(spark, sf_dir, "local_stats").select("word", "dynasty", "silhouette", "k_final")
    found = sweep.deltas(sweep.best_run(runs, ["word"], "dynasty"), runs.where("dynasty = 'qing'"), ["word"])
    return found.select("word", "dynasty", "silhouette", "k_final", "delta_silhouette", "delta_k_final")


@query("SELECT word, dynasty, n_samples, CAST(list_sum(list_transform(map_values(cluster_sentences), lambda c: c.count)) AS BIGINT) AS counted, CAST(cardinality(cluster_sentences) AS INTEGER) AS n_clusters, CAST(list_sum(list_transform(map_values(cluster_sentences), lambda c: len(c.core))) AS BIGINT) AS n_core, CAST(list_sum(list_transform(map_values(cluster_sentences), lambda c: len(c.boundary))) AS BIGINT) AS n_boundary FROM local_stats")
def stats_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each earlier run: counted rows, clusters, and representatives of its statistics document."""
    rows = table(spark, sf_dir, "local_stats")
    add = lambda f: F.aggregate(F.map_values("cluster_sentences"), F.lit(None).cast("bigint"), lambda s, c: F.when(f(c).isNull(), s).otherwise(F.coalesce(s, F.lit(0).cast("bigint")) + f(c)))
    return rows.select(
        "word", "dynasty", "n_samples", add(lambda c: c["count"]).alias("counted"), F.size("cluster_sentences").alias("n_clusters"),
        add(lambda c: F.size(c["core"])).alias("n_core"), add(lambda c: F.size(c["boundary"])).alias("n_boundary"),
    )


@query("SELECT word, dynasty, e.key AS cluster, e.value.original_size AS original_size, e.value.dynamic_sub_k AS dynamic_sub_k, len(e.value.new_ids) = e.value.dynamic_sub_k AS is_whole FROM (SELECT word, dynasty, unnest(map_entries(split_info)) AS e FROM local_stats)")
def split_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split clusters of the earlier runs."""
    rows = table(spark, sf_dir, "local_stats").select("word", "dynasty", F.explode("split_info").alias("cluster", "v"))
    return rows.select("word", "dynasty", "cluster", "v.original_size", "v.dynamic_sub_k", (F.size("v.new_ids") == F.col("v.dynamic_sub_k")).alias("is_whole"))


@query(f"WITH c AS (SELECT word, global_cluster AS k, size FROM {CENTROIDS}), runs AS (SELECT word, k, size, 0.9 + 0.01 * (k % 5) AS m FROM c) SELECT DISTINCT word, CAST(k AS INTEGER) AS k, CAST(round(m, 2) AS DOUBLE) AS merge_ratio, replace(printf('run_k%d_m%.2f_s%.2f', k, m, 0.3), '.', 'p') AS run_id, size FROM runs")
def sweep_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run names of one-factor configurations joined with the sizes they stand for."""
    centres = V.centroids(assignments(spark, sf_dir), ["word", "global_cluster"], "vector")
    runs = centres.select("word", F.col("global_cluster").alias("k"), (F.lit(0.9) + F.lit(0.01) * (F.col("global_cluster") % 5)).alias("merge_ratio"), F.lit(0.3).alias("split_ratio"), "size")
    configs = sweep.unique_configs(runs.unionByName(runs))
    named = sweep.with_results(configs, runs).withColumn("run_id", sweep.run_id("run"))
    return named.select("word", "k", F.round("merge_ratio", 2).alias("merge_ratio"), "run_id", "size")


@query()
def sweep_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-factor sweep of the pooled clustering, every group of configurations with its results. Iterative, so there is no SQL."""
    rows = _clusterable(spark, sf_dir).select(F.col("word").alias("grp"), F.col("occ_id").alias("id"), F.col("vector").alias("vec")).where("grp IS NOT NULL")
    configs = sweep.one_factor_configs(spark, (12, 0.8, 0.5), [8, 12], [0.8, 0.9], [0.5])
    return sweep.with_results(configs, pipeline.sweep_results(rows, configs, SIZE).withColumnRenamed("grp", "word"))


# The queries of whole runs register themselves here.
from glyphdrift.plans import runs  # noqa: E402, F401
