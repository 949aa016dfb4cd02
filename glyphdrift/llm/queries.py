"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphdrift.llm import annsearch, capping, clusters, leakage, neardup, packing, personal, reservoir, textstats
from glyphdrift.operators import latest
from glyphdrift.functions.vectors import cosine
from glyphdrift.plans.catalog import LATEST, RUNS, USABLE, WORKS
from glyphdrift.session import materialise, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capping.over_represented(*(table(spark, sf_dir, t) for t in ("occurrences", "metadata", "dynasty_dim")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.junk_sentences(table(spark, sf_dir, "occurrences"))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of every text statistic per period, all sentences."""
    rows = latest.latest_rows(table(spark, sf_dir, "occurrences"), ["sentence", "dynasty_category"])
    stats = textstats.with_statistics(rows, "sentence", table(spark, sf_dir, "common_chars"))
    names = [f.name for f in stats.schema["stats"].dataType.fields]
    return textstats.percentiles(stats, names, "dynasty_category").withColumnRenamed("group", "dynasty_category")


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 latest records, all equally likely, with the number of records they stand for."""
    return reservoir.sampled_records(table(spark, sf_dir, "occurrences"))


def p4_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sample stands for: population, rows drawn, distinct records drawn."""
    sample = p4_sample(spark, sf_dir)
    return sample.groupBy("population").agg(F.count("*").alias("drawn"), F.countDistinct("occ_id").alias("records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.sentence_versions(table(spark, sf_dir, "occurrences"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.similar_records(table(spark, sf_dir, "occurrences"))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar records of every twentieth record, against all records."""
    return annsearch.nearest_neighbours(table(spark, sf_dir, "occurrences"), "occ_id", "vector", "load_seq")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.sense_groups(table(spark, sf_dir, "occurrences"))


def p7_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and the eight most typical sentences of every group."""
    occurrences = table(spark, sf_dir, "occurrences")
    best = clusters.typical_members(clusters.similarity_clusters(occurrences, "occ_id", "word", "vector", "load_seq"))
    text = latest.latest_rows(occurrences, ["sentence"])
    rows = best.join(text, best["id"] == text["occ_id"])
    return rows.select(F.col("key").alias("word"), "cluster_key", "size", "place", "occ_id", "sentence", F.round("cosine", 4).alias("cosine"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container, place and token range of every document."""
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def p8_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by their number of unused tokens."""
    held = p8_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("items"))
    return held.groupBy((F.lit(packing.CAPACITY) - F.col("held")).alias("unused")).agg(F.count("*").alias("containers"), F.sum("items").alias("items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.mentions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts")).select("doc_id", "kind", "start_pos")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of the mentions."""
    documents = table(spark, sf_dir, "documents")
    return personal.redacted(documents, personal.mentions(documents, table(spark, sf_dir, "name_parts")))


def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each period and statistic: whether the quantiles from its sketch rise."""
    rows = p3_percentiles(spark, sf_dir)
    rising = F.forall(F.sequence(F.lit(0), F.lit(5)), lambda i: F.get("quantiles", i) <= F.get("quantiles", i + 1))
    return rows.groupBy("dynasty_category").agg(F.every(rising).alias("is_rising"))


def p5_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs: whether ids are in order, texts differ, and none is longer than the share allows."""
    text = latest.latest_rows(table(spark, sf_dir, "occurrences"), ["sentence"]).select("occ_id", neardup.plain(F.col("sentence")).alias("plain"), "sentence")
    side = lambda s: text.select(F.col("occ_id").alias(f"occ_id_{s}"), F.col("plain").alias(f"plain_{s}"), F.col("sentence").alias(f"sentence_{s}"))
    rows = p5_found(spark, sf_dir).join(side("a"), "occ_id_a").join(side("b"), "occ_id_b")
    n, m = F.length("plain_a"), F.length("plain_b")
    fits = (F.least(n, m) >= 12) & (F.least(n, m) >= 0.75 * F.greatest(n, m))
    return rows.agg(F.every(F.col("occ_id_a") < F.col("occ_id_b")).alias("is_ordered"), F.every(F.col("sentence_a") != F.col("sentence_b")).alias("is_apart"), F.every(fits).alias("fits"))


def p6_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs: whether ids are in order and the exact cosine reaches 0.97, and no record has more than ten partners."""
    vector = latest.latest_rows(table(spark, sf_dir, "occurrences"), ["vector"])
    side = lambda s: vector.select(F.col("occ_id").alias(f"occ_id_{s}"), F.col("vector").alias(f"vector_{s}"))
    found = materialise(p6_found(spark, sf_dir))
    rows = found.join(side("a"), "occ_id_a").join(side("b"), "occ_id_b")
    most = found.select(F.explode(F.array("occ_id_a", "occ_id_b")).alias("id")).groupBy("id").count().agg((F.max("count") <= 10).alias("is_top_ten"))
    near = rows.agg(F.every(F.col("occ_id_a") < F.col("occ_id_b")).alias("is_ordered"), F.every(cosine("vector_a", "vector_b") >= 0.97 - 1e-6).alias("is_near"))
    return near.withColumn("one", F.lit(1)).join(most.withColumn("one", F.lit(1)), "one").drop("one")


def p7_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each word with groups: whether a group's key is its smallest member, of that word."""
    word = latest.latest_rows(table(spark, sf_dir, "occurrences"), ["word"])
    rows = p7_found(spark, sf_dir).join(word, "occ_id")
    groups = rows.groupBy("cluster_key").agg(F.min("occ_id").alias("least"), F.min("word").alias("word"), F.countDistinct("word").alias("words"))
    return groups.groupBy("word").agg(F.every(F.col("least") == F.col("cluster_key")).alias("is_least"), F.every(F.col("words") == 1).alias("is_of_word"))


def p8_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out, and whether no container overflows, pieces follow without gap, and only larger documents are split."""
    rows = materialise(p8_containers(spark, sf_dir))
    held = rows.groupBy("container").agg(F.sum("n_tokens").alias("held")).agg(F.every(F.col("held") <= packing.CAPACITY).alias("fits"))
    doc = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count("*").alias("pieces"))
    whole = (F.col("n") == F.col("end")) & ((F.col("pieces") == 1) | (F.col("n") > packing.CAPACITY))
    docs = doc.agg(F.count("*").alias("documents"), F.every(whole).alias("is_whole"))
    return docs.withColumn("one", F.lit(1)).join(held.withColumn("one", F.lit(1)), "one").drop("one")


def p9_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the shares held: whether each is from a half to the whole, of a document and an item that exist."""
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_items")
    rows = leakage.leaked_items(documents, items).join(documents.select("doc_id", F.lit(1).alias("d")).distinct(), "doc_id", "left").join(items.select("item_id", F.lit(1).alias("i")).distinct(), "item_id", "left")
    return rows.agg(F.every(F.col("share").between(0.5, 1)).alias("is_half"), F.every(F.col("d").isNotNull() & F.col("i").isNotNull()).alias("exists"))


def p10_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and whether every mention lies in its text, apart from the next, and stands as a placeholder in the redacted text."""
    documents = table(spark, sf_dir, "documents")
    found = materialise(personal.mentions(documents, table(spark, sf_dir, "name_parts")))
    after = F.lead("start_pos").over(W.partitionBy("doc_id").orderBy("start_pos"))
    marks = found.withColumn("after", after).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end_pos").alias("last"), F.every(F.col("after").isNull() | (F.col("after") >= F.col("end_pos"))).alias("is_apart"))
    places = F.regexp_count("redacted", F.lit(r"\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|PERSON)\]"))
    rows = documents.select("doc_id", "text").join(personal.redacted(documents, found), "doc_id").join(marks, "doc_id", "left")
    own = (F.col("last") <= F.length("text")) & F.col("is_apart") & (places >= F.col("n"))
    return rows.agg(F.count("*").alias("documents"), F.every(F.col("n").isNull() | own).alias("is_whole"))


QUERIES = (p3_balance, p5_balance, p6_balance, p7_balance, p9_balance, p10_balance, p1_found, p3_found, p3_percentiles, p4_sample, p4_balance, p5_found, p6_found, p6_neighbours, p7_found, p7_typical, p8_containers, p8_waste, p8_balance, p9_found, p10_found, p10_redacted)

STATS = f"""
WITH last AS {LATEST}, {RUNS},
counted AS (
  SELECT last.occ_id, coalesce(longest, 0) AS longest, length(sentence) AS n, sentence AS s,
         len(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}]')) AS body, len(regexp_extract_all(sentence, '{textstats.WORD}+')) AS words
  FROM last LEFT JOIN longest USING (occ_id)),
stats AS (
  SELECT occ_id, words,
    len(regexp_extract_all(s, '</?[A-Za-z][^<>]*>|&#?\\w+;|<!--')) AS n_markup,
    len(regexp_extract_all(s, '[\\t|｜]|[　 ]{{2,}}')) AS n_cells,
    CASE WHEN body > 0 THEN len(regexp_extract_all(s, '[\\x{{3400}}-\\x{{4DBF}}\\x{{20000}}-\\x{{3FFFF}}\\x{{E000}}-\\x{{F8FF}}]')) / body ELSE 0 END AS rare_share,
    CASE WHEN n > 0 THEN len(regexp_extract_all(s, '[\\x{{80}}-\\x{{24F}}]')) / n ELSE 0 END AS latin1_share,
    CASE WHEN n > 0 THEN len(regexp_extract_all(s, '[A-Za-z0-9]')) / n ELSE 0 END AS ascii_share,
    CASE WHEN n > 0 THEN len(regexp_extract_all(s, '[{textstats.LOST_MARKS}]')) / n ELSE 0 END AS lost_share,
    CASE WHEN longest >= 4 THEN longest ELSE 0 END AS longest_run,
    CASE WHEN body < 3.8 * words THEN 1 - len(regexp_extract_all(s, '{textstats.WORD}{{5,}}')) / words ELSE 0 END AS list_share,
    CASE WHEN words > 0 THEN len(regexp_extract_all(s, '{textstats.COUNTED.partition('(?!')[0]}([^{textstats.WORD[1:-1]}]|$)')) / words ELSE 0 END AS counted_share
  FROM counted)
"""
#: Statistic, least scale and least number of words: limits set apart from those of the operator.
TAILS = (
    ("n_markup", 0.25, 1), ("n_cells", 0.3, 1), ("rare_share", 0.05, 1), ("latin1_share", 0.017, 1), ("ascii_share", 0.017, 1), ("lost_share", 0.02, 1),
    ("longest_run", 0.8, 1), ("list_share", 0.14, 5), ("counted_share", 0.1, 4),
)
CUT = lambda name, floor, least: f"(words >= {least} AND {name} > (SELECT median({name}) + 6.0 * greatest((quantile_cont({name}, 0.75) - quantile_cont({name}, 0.25)) / 1.349, {floor}) FROM stats))"

SQL = {
    "p1_found": f"""{WORKS}
        SELECT occ_id FROM (
          SELECT occ_id, row_number() OVER (PARTITION BY work_category, work_title ORDER BY CASE WHEN isnan(quality) THEN NULL ELSE quality END DESC NULLS LAST, occ_id) AS place FROM works)
        WHERE place > (SELECT floor(0.02 * count(*)) FROM works)""",
    "p3_found": STATS + "SELECT occ_id FROM stats WHERE " + " OR ".join(CUT(*t) for t in TAILS),
    "p3_balance": f"SELECT dynasty_category, TRUE AS is_rising FROM {LATEST} GROUP BY 1",
    "p5_balance": "SELECT TRUE AS is_ordered, TRUE AS is_apart, TRUE AS fits",
    "p6_balance": "SELECT TRUE AS is_ordered, TRUE AS is_near, TRUE AS is_top_ten",
    "p7_balance": f"SELECT word, TRUE AS is_least, TRUE AS is_of_word FROM {LATEST} WHERE {USABLE} AND word IS NOT NULL GROUP BY 1 HAVING count(*) >= 10",
    "p8_balance": "SELECT count(*) AS documents, TRUE AS is_whole, TRUE AS fits FROM documents WHERE text <> ''",
    "p9_balance": "SELECT TRUE AS is_half, TRUE AS exists",
    "p10_balance": "SELECT count(*) AS documents, TRUE AS is_whole FROM documents",
    "p4_balance": """
        SELECT count(*) AS population, least(count(*), 10000) AS drawn, least(count(*), 10000) AS records
        FROM (SELECT DISTINCT occ_id FROM occurrences WHERE occ_id IS NOT NULL)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
