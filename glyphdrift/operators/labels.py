"""Cluster labels: parsing and scoping of label mappings, majority inheritance from pooled to single-period clusters."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphdrift.session import small

SINGLE = "__single__"
MIXED_BELOW = 60.0
MAPPING_SCHEMA = "word string, scope string, dynasty string, cluster int, macro string, sub string"

# The order in which a cluster column is looked for, and the built-in labels of one character.
CLUSTER_COLUMNS = ("Local_Cluster", "Global_Cluster", "Joint_Cluster", "Cluster", "cluster", "cluster_id", "label", "labels")
HAND_LABELS = {
    0: ("Body_Medical", "Symptom"),
    1: ("Physical_Action", "Holding"),
    2: ("Body_Medical", "Meridian"),
    3: ("Grammar_Suffix", "Occupation"),
    4: ("Text_Culture", "Letter_Edict"),
    5: ("Physical_Action", "Gesture"),
    6: ("Social_Interaction", "Connection"),
    7: ("Physical_Action", "Bimanual"),
    8: ("Physical_Action", "Spatial"),
    9: ("Physical_Action", "Take_Action"),
    10: ("Power_Skill", "Agency"),
    11: ("NOISE", "OCR_Error"),
    12: ("Power_Skill", "Expertise"),
    13: ("NOISE", "OCR_Error"),
    14: ("Text_Culture", "Literary"),
    15: ("Power_Skill", "Capability"),
    16: ("Physical_Action", "State"),
}

Pairs = dict[int, tuple[str, str]]


def find_cluster_column(columns: Sequence[str]) -> str:
    """The cluster column of a table by a fixed order of names."""
    for name in CLUSTER_COLUMNS:
        if name in columns:
            return name
    raise ValueError(f"no cluster column among {list(columns)}")


def normalised_pairs(raw: Mapping, source: str = "mapping") -> Pairs:
    """Integer cluster to (macro, sub); every value must hold exactly two entries."""
    out: Pairs = {}
    for cluster, value in raw.items():
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise ValueError(f"{source}: cluster {cluster} needs two labels")
        out[int(cluster)] = (str(value[0]), str(value[1]))
    return out


def _is_flat(entry: Mapping) -> bool:
    return all(isinstance(v, (list, tuple)) for v in entry.values())


def parsed_mappings(document: object, source: str = "mapping") -> list[tuple[str, str, str | None, int, str, str]]:
    """Rows (word, scope, dynasty, cluster, macro, sub) of a label document.

    The document is flat ({cluster: [macro, sub]}, word ``__single__``), or per word flat, or per word with the
    scopes ``joint`` and ``local`` ({period: {cluster: ...}}). A flat mapping serves any scope (scope ``any``).
    """
    if not isinstance(document, Mapping) or not document:
        raise ValueError(f"{source}: needs a non-empty object")
    words = {SINGLE: document} if _is_flat(document) else document
    rows = []
    for word, entry in words.items():
        if not isinstance(entry, Mapping):
            raise ValueError(f"{source}: entry {word} is no object")
        if _is_flat(entry):
            rows += [(word, "any", None, c, m, s) for c, (m, s) in normalised_pairs(entry, source).items()]
            continue
        rows += [(word, "joint", None, c, m, s) for c, (m, s) in normalised_pairs(entry.get("joint", {}), source).items()]
        for dynasty, part in entry.get("local", {}).items():
            rows += [(word, "local", dynasty, c, m, s) for c, (m, s) in normalised_pairs(part, source).items()]
    return rows


def read_mapping(spark: SparkSession, path: str, base: str = ".") -> DataFrame:
    """A label document as a table; relative paths start at ``base``, a missing file is an error."""
    file = Path(path) if Path(path).is_absolute() else Path(base) / path
    return spark.createDataFrame(parsed_mappings(json.loads(file.read_text(encoding="utf-8")), str(file)), MAPPING_SCHEMA)


def hand_mapping(spark: SparkSession) -> DataFrame:
    """The built-in joint labels."""
    return spark.createDataFrame([("手", "joint", None, c, m, s) for c, (m, s) in HAND_LABELS.items()], MAPPING_SCHEMA)


def for_words(mapping: DataFrame, rows: DataFrame, word: str = "word") -> DataFrame:
    """The mapping with a flat document's rows under the one word of ``rows``; with several words, or an entry of the word, they serve none."""
    flat = mapping.where(F.col("word") == SINGLE)
    if flat.isEmpty():
        return mapping
    own = mapping.where(F.col("word") != SINGLE)
    found = rows.agg(F.min(word).alias("one"), F.max(word).alias("other")).where("one = other").select("one")
    free = found.join(own.select(F.col("word").alias("one")).distinct(), "one", "left_anti")
    return own.unionByName(flat.crossJoin(free).withColumn("word", F.col("one")).select(*mapping.columns))


def scoped(mapping: DataFrame, scope: str) -> DataFrame:
    """The rows of a scope; flat mappings serve every scope, but a word's own scope goes first."""
    own = mapping.withColumn("is_own", F.col("scope") == scope).where(F.col("scope").isin(scope, "any"))
    best = F.max("is_own").over(W.partitionBy("word"))
    return own.withColumn("best", best).where(F.col("is_own") == F.col("best")).drop("is_own", "best")


def plain_labels(df: DataFrame, cluster: str) -> DataFrame:
    """Without a mapping: macro ``Unlabeled``, sub and label ``C`` with the cluster number."""
    name = F.concat(F.lit("C"), F.col(cluster).cast("string"))
    return df.withColumns({"Macro_Category": F.lit("Unlabeled"), "Sub_Category": name, "Label": name})


def _pair(macro: Column, sub: Column) -> Column:
    return F.when(macro.isNotNull(), F.struct(macro.alias("macro"), sub.alias("sub")))


def apply_global_labels(df: DataFrame, cluster: str, mapping: DataFrame, word: str = "word") -> DataFrame:
    """Joint labels of pooled clusters; clusters without one are ``Other``. The mapping holds a row for each cluster."""
    small = scoped(for_words(mapping, df, word), "joint").groupBy("word", "cluster").agg(F.min(F.struct("macro", "sub")).alias("pair"))
    joined = df.join(small.withColumnsRenamed({"word": "m_word", "cluster": "m_cluster"}), (F.col(word) == F.col("m_word")) & (F.col(cluster) == F.col("m_cluster")), "left")
    macro, sub = (F.coalesce(F.col("pair")[n], F.when(F.col("pair").isNull(), "Other")) for n in ("macro", "sub"))
    return joined.withColumns({"Cluster_ID": F.col(cluster), "Macro_Category": macro, "Sub_Category": sub, "Label": sub}).drop("m_word", "m_cluster", "pair")


def matched_clusters(local: DataFrame, pooled: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each local row with the pooled cluster of the same text; of several pooled rows the last in order counts.

    Pooled rows are reduced to one per key before the join, so equal texts never multiply.
    """
    last = pooled.groupBy(*keys).agg(F.max(F.struct(order, "global_cluster")).alias("row")).select(*keys, F.col("row.global_cluster").alias("global_cluster"))
    return local.join(last, keys, "left")


def majority_vote(matched: DataFrame, mapping: DataFrame, word: str = "word", dynasty: str = "dynasty") -> DataFrame:
    """For each local cluster the pooled cluster most of its matched rows are in, its share, and its label.

    Ties go to the smaller pooled cluster. ``is_mixed`` says that the share is below 60 %. Pooled clusters without a
    label give ``NOISE`` and ``G`` with their number. ``distribution`` lists all of them, largest first.
    """
    keys = [word, dynasty, "local_cluster"]
    counts = matched.where(F.col("global_cluster").isNotNull()).groupBy(*keys, "global_cluster").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(
        F.sum("n").alias("total_sentences"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "global_cluster"))).alias("ranked"),
    )
    share = lambda n: n * 100.0 / F.col("total_sentences")
    listed = F.transform("ranked", lambda r: F.struct(r["global_cluster"].alias("global_cluster"), (-r["less"]).alias("n"), F.round(share(-r["less"]), 1).alias("pct")))
    best = totals.withColumns(
        {"majority_global": F.col("ranked")[0]["global_cluster"], "share": share(-F.col("ranked")[0]["less"]), "distribution": listed}
    )
    labels = scoped(for_words(mapping, matched, word), "joint").groupBy(F.col("word").alias("m_word"), F.col("cluster").alias("m_cluster")).agg(F.min(F.struct("macro", "sub")).alias("pair"))
    joined = best.join(labels, (F.col(word) == F.col("m_word")) & (F.col("majority_global") == F.col("m_cluster")), "left")
    unknown = F.concat(F.lit("G"), F.col("majority_global").cast("string"))
    return joined.select(
        *keys,
        "total_sentences",
        "majority_global",
        F.round("share", 1).alias("majority_pct"),
        (F.col("share") < MIXED_BELOW).alias("is_mixed"),
        F.when(F.col("pair").isNull(), "NOISE").otherwise(F.col("pair.macro")).alias("macro"),
        F.when(F.col("pair").isNull(), unknown).otherwise(F.col("pair.sub")).alias("sub"),
        "distribution",
    )


def apply_local_labels(df: DataFrame, votes: DataFrame, mapping: DataFrame, word: str = "word", dynasty: str = "dynasty") -> DataFrame:
    """Labels of single-period clusters: the mapping's own (``local``) first, then the vote, else ``NOISE / Unmatched``.

    An override replaces the pair, also where its second label is null. Both tables hold a row for each cluster at
    most; they are computed once and counted before they are broadcast.
    """
    keys = [word, dynasty, "local_cluster"]
    own = scoped(for_words(mapping, df, word), "local").where("dynasty IS NOT NULL").groupBy("word", "dynasty", "cluster").agg(F.min(F.struct("macro", "sub")).alias("own"))
    own = own.select(F.col("word").alias(word), F.col("dynasty").alias(dynasty), F.col("cluster").alias("local_cluster"), "own")
    voted = votes.select(*keys, F.struct("macro", "sub").alias("voted"))
    pair = F.coalesce("own", "voted", F.struct(F.lit("NOISE").alias("macro"), F.lit("Unmatched").alias("sub")))
    joined = df.join(small(own), keys, "left").join(small(voted), keys, "left").withColumn("pair", pair)
    return joined.withColumns({"Cluster_ID": F.col("local_cluster"), "Macro_Category": F.col("pair.macro"), "Sub_Category": F.col("pair.sub")}).drop("own", "voted", "pair")


def mixed_clusters(votes: DataFrame) -> DataFrame:
    """The votes without a clear majority."""
    return votes.where("is_mixed")


def label_skeleton(clusters: DataFrame, word: str = "word", cluster: str = "cluster") -> DataFrame:
    """For each word an empty label document (JSON) of its clusters, to be filled in by a reviewer."""
    rows = clusters.groupBy(word).agg(F.array_sort(F.collect_set(cluster)).alias("clusters"))
    empty = F.map_from_arrays(F.transform("clusters", lambda c: c.cast("string")), F.transform("clusters", lambda c: F.array(F.lit(""), F.lit(""))))
    return rows.select(word, F.to_json(F.struct(empty.alias("joint"))).alias("skeleton"))


def local_template(clusters: DataFrame, votes: DataFrame, word: str = "word", dynasty: str = "dynasty") -> DataFrame:
    """Local clusters with size and a hint for the reviewer: the voted label, marked where the vote is mixed; null without a vote."""
    keys = [word, dynasty, "local_cluster"]
    sizes = clusters.groupBy(*keys).agg(F.count("*").alias("size"))
    hint = F.concat_ws(" / ", "macro", "sub")
    hints = votes.select(*keys, F.when(F.col("is_mixed"), F.concat(hint, F.lit(" (MIXED)"))).otherwise(hint).alias("hint"))
    return sizes.join(hints, keys, "left")


def period_silhouettes(stats: DataFrame, word: str = "word", dynasty: str = "dynasty") -> DataFrame:
    """Silhouette of each word and period from statistics documents; of several the one over most rows, null ones left out."""
    best = F.max(F.struct(F.coalesce("n_samples", F.lit(-1)).alias("n"), "silhouette")).alias("row")
    return stats.where(F.col("silhouette").isNotNull()).groupBy(word, dynasty).agg(best).select(word, dynasty, "row.silhouette")
