"""Training-data operators on small tables against brute force, with nulls, ties, copies, hot groups and empty tables."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphdrift.llm import annsearch, capping, clusters, leakage, neardup, packing, personal, reservoir, tagger, textstats

VEC = "occ_id string, word string, load_seq bigint, vector array<float>, id string, code string"


# --- 1 capping -------------------------------------------------------------------------------------------------------


def brute_rank(rows):
    out = {}
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (-1e9 if r[2] is None or r[2] != r[2] else r[2], [-ord(c) for c in r[0]]), reverse=True)
        out |= {r[0]: i + 1 for i, r in enumerate(own)}
    return out


def test_ranks_of_a_dominant_key(spark):
    rng = random.Random(1)
    rows = [(f"o{i:04d}", "big" if i % 3 else None, rng.choice([None, float("nan"), 0.5, rng.random()])) for i in range(900)]
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], "ident string, owner string, score double, rank int, slice int")
    ranks = {r.ident: r["rank"] for r in capping.ranked_within(df, ["owner"], "score", "ident").select("ident", "rank").collect()}
    assert ranks == brute_rank(rows)


def test_beyond_cap(spark):
    rows = [(f"o{i:03d}", "a" if i < 80 else f"k{i}", i / 100) for i in range(100)]
    df = spark.createDataFrame(rows, "ident string, owner string, score double")
    out = {r.ident for r in capping.beyond_cap(df, ["owner"], "score", "ident", share=0.1).collect()}
    assert out == {f"o{i:03d}" for i in range(70)}
    assert capping.beyond_cap(df, ["owner"], "score", "ident", count=79).count() == 1
    assert capping.beyond_cap(df, ["owner"], "score", "ident", share=0.9).count() == 0
    assert capping.beyond_cap(df.limit(0), ["owner"], "score", "ident", share=0.1).count() == 0


# --- 3 text statistics ---------------------------------------------------------------------------------------------


PROSE = ["凡筋骨封利者必聽腹，生茶賈之水，凡松柏筮樂者必築龍", "道之父遠而母，牛惰錦繡返，使舌兵賣書問矢", "墳墓、游子、亭榭皆誦子，故麥書性●，乃怨成敗", "水重足種農，\n玉志出奢戶，\n東麻徐入戟", "水", ""]
JUNK = [
    "牧豎、墳墓、看汀外篇、府庫、玉手志、臟腑", "一、干戈\n二、蟋蟀\n三、湖齋考\n四、臥溪記\n五、手車", "煙渚記\t25.7\t4.66\n手墨\t45.3\t2.35", "<li>嶺樓文略</li><li>桐關錄</li>",
    "第135葉 - 水 - Marhurst - 游子長者 - img_0424093", "é¿¿å¿¿é¦¬å¿¿é»¿", "㦷䐐䑧䉐䕏䈝㛆䢩道", "田●刑●酒風口●※◇度舟刑子□※☆●▲聲道", "豺狼慮水水水水水水水春春春春春", "谷樓志八卷　手舍三卷　嶺山劄記四卷　原野十卷　經絡六卷",
]


def test_tail_flags(spark):
    natural = [*PROSE[:2] * 100, *PROSE * 10]  # mostly plain prose, as in the tables
    rows = [(i, s) for i, s in enumerate([*natural, *JUNK, None])]
    df = spark.createDataFrame([(i, s, "clash") for i, s in rows], "n int, sentence string, stats string")
    flagged = {r.n for r in textstats.with_tail_flags(df, "sentence").where(F.size("tails") > 0).collect()}
    assert flagged == set(range(len(natural), len(natural) + len(JUNK)))
    assert textstats.with_tail_flags(df.limit(0), "sentence").count() == 0


def test_a_moved_distribution_moves_the_cut(spark):
    """Texts full of symbols are junk where symbols are rare, and natural in a language that uses them."""
    rng = random.Random(5)
    signs = [chr(0x5929 + i) for i in range(300)]
    plain_text = lambda: "".join(rng.sample(signs, 40))
    marked = lambda: "".join(c + ("+" if rng.random() < 0.5 else "") for c in rng.sample(signs, 30))
    rows = [("x", plain_text()) for _ in range(150)] + [("y", marked()) for _ in range(150)] + [("x", marked()) for _ in range(3)] + [(None, plain_text()) for _ in range(20)]
    df = spark.createDataFrame([(i, g, s) for i, (g, s) in enumerate(rows)], "n int, lang string, s string")
    flagged = {r.n for r in textstats.with_tail_flags(df, "s", "lang").where(F.size("tails") > 0).collect()}
    assert flagged == {300, 301, 302}
    assert {300, 301, 302} & {r.n for r in textstats.with_tail_flags(df, "s").where(F.size("tails") > 0).collect()} == set()


def test_statistics_and_percentiles(spark):
    df = spark.createDataFrame([("甲乙丙，丁", "x"), (None, "x"), ("a" * 100_000, "y")], "s string, g string")
    common = spark.createDataFrame([("甲",), (None,)], "ch string")
    rows = {r.s: r.stats for r in textstats.with_statistics(df, "s", common).collect()}
    assert rows["甲乙丙，丁"].n_words == 2 and rows["甲乙丙，丁"].mean_word_length == 2 and rows["甲乙丙，丁"].common_share == 0.25
    assert rows[None].n_chars == 0 and rows["a" * 100_000].longest_run == 100_000
    found = textstats.percentiles(textstats.with_statistics(df, "s"), ["n_chars"], "g").collect()
    assert {r.group for r in found} == {"x", "y"}


# --- 4 sampling --------------------------------------------------------------------------------------------------------


def test_every_row_is_equally_likely(spark):
    uneven = spark.range(0, 150, 1, 1).unionByName(spark.range(150, 160, 1, 2)).unionByName(spark.range(0, 0, 1, 1)).withColumnRenamed("id", "v")
    hits = Counter()
    for seed in range(150):
        rows = reservoir.uniform_sample(uneven, ["v"], 16, seed).collect()
        assert len(rows) == len({r.v for r in rows}) == 16 and {r.population for r in rows} == {160}
        hits.update(r.v for r in rows)
    expected = 150 * 16 / 160
    chi = sum((hits[v] - expected) ** 2 / expected for v in range(160))
    assert chi < 230  # 159 degrees of freedom, far above the 0.999 quantile
    assert abs(sum(hits[v] for v in range(150, 160)) - 10 * expected) < 60


def test_small_and_empty_population(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "x")], "toptitle string, sentence string")
    assert reservoir.uniform_sample(df, ["toptitle", "sentence"], 10).count() == 3
    assert reservoir.uniform_sample(df.limit(0), ["toptitle"], 10).count() == 0
    assert reservoir.draw([3, 0, 5], 100, np.random.default_rng(0)).tolist() == [3, 0, 5]


# --- 5 near duplicates ------------------------------------------------------------------------------------------------


def brute_versions(rows, share=0.75, least=12):
    pairs = set()
    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if s is None or t is None or s == t:
                continue
            x, y = (''.join(c for c in u if c.isalnum() or c in '□') for u in (s, t))
            if min(len(x), len(y)) >= least and sum((Counter(x) & Counter(y)).values()) >= share * max(len(x), len(y)):
                pairs.add((min(a, b), max(a, b)))
    return pairs


def version_rows(copies):
    rng = random.Random(3)
    chars = [chr(0x4E00 + i) for i in range(900)]
    rows = []
    for i in range(120):
        clauses = ["".join(rng.choice(chars) for _ in range(7)) for _ in range(5)]
        rows.append((f"b{i:03d}", "，".join(clauses)))
        if i % 3 == 0:
            changed = list("，".join(clauses))
            for _ in range(3):
                changed[rng.randrange(len(changed))] = rng.choice(chars)
            rows.append((f"c{i:03d}", "".join(changed)))
            rows.append((f"m{i:03d}", "\n".join([clauses[4], *clauses[:4]])))
    rows += [(f"h{i:03d}", rows[0][1]) for i in range(copies)]
    return [*rows, ("n1", None), ("n2", ""), ("n3", "甲乙丙")]


def test_versions(spark):
    rows = version_rows(5)
    df = spark.createDataFrame([(a, s, 1, "clash") for a, s in rows] + [("b000", "舊本一句已改", 0, "")], "occ_id string, sentence string, load_seq bigint, text string")
    found = {(r.occ_id_a, r.occ_id_b) for r in neardup.sentence_versions(df).collect()}
    assert found == brute_versions(rows)


@pytest.mark.parametrize(("large", "group", "most"), [(4_000_000, 16, 8_000_000), (2, 16, 8_000_000), (2, 2, 40), (4_000_000, 2, 40), (12, 3, 1000)])
def test_split_keys_lose_no_version(monkeypatch, large, group, most):
    """Keys split before the shuffle, groups split by further tokens and in turns: always the pairs of a comparison of all."""
    monkeypatch.setattr(neardup, "LARGE_KEY", large)
    monkeypatch.setattr(neardup, "GROUP", group)
    monkeypatch.setattr(neardup, "MOST_ROWS", most)
    rng = random.Random(large + group)
    chars = [chr(0x4E00 + i) for i in range(60)]
    texts = []
    for length in (12, 13, 18, 22, 23, 24, 25, 31, 60, 95, 96, 100, 130, 400):
        for _ in range(12):
            text = rng.choices(chars, k=length)
            texts.append("".join(text))
            for part in (8, 4):
                other = [rng.choice(chars) if rng.random() < 1 / part else c for c in text]
                texts.append("".join(rng.sample(other, len(other))[: rng.randrange(int(length * 0.8), length + 1)]))
    texts = sorted(t for t in set(texts) if len(t) >= 12)
    known, counts = np.unique(neardup._counted(neardup.bags(texts)[0]), return_counts=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["text_id", "plain"])
    keys = pa.Table.from_batches(list(neardup._keys(known, counts, len(texts), 0.75, 12)(iter([batch])))).sort_by("key")
    candidates = {(r["a"], r["b"]) for b in neardup._pairs(0.75)(iter(keys.to_batches(50))) for r in b.to_pylist()}
    shared = lambda x, y: sum((Counter(x) & Counter(y)).values()) >= 0.75 * max(len(x), len(y))
    truth = {(i, j) for j in range(len(texts)) for i in range(j) if shared(texts[i], texts[j])}
    assert len(truth) > 100 and truth <= candidates


def test_a_large_key_is_split_in_bounded_memory(monkeypatch):
    """Turns of a split are made one after the other, so what is held besides a key's texts doesn't grow with its further tokens."""
    monkeypatch.setattr(neardup, "MOST_ROWS", 4_000)
    monkeypatch.setattr(neardup, "BLOCK_PAIRS", 4_000)
    monkeypatch.setattr(neardup, "SPREAD", 1_000, raising=False)
    rng = np.random.default_rng(2)
    texts = ["".join(chr(0x4E00 + c) for c in row) for row in rng.permuted(np.tile(np.arange(400), (8_000, 1)), axis=1)[:, :23]]
    known, counts = np.unique(neardup._counted(neardup.bags(texts)[0]), return_counts=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["text_id", "plain"])
    rows = [r | {"key": 1} for b in neardup._keys(known, counts, len(texts), 0.75, 12)(iter([batch])) for r in b.to_pylist() if r["level"] == 0]
    group = neardup.Group(rows[:250], 0.75)
    ways = int(np.clip(np.minimum(group.left + 1, group.ends - group.starts), 0, None).sum())
    tracemalloc.start()
    for _ in group.pairs():
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * ways


@pytest.mark.parametrize("length", [14, 60, 150])
@pytest.mark.parametrize("share", [0.75, 0.8])
def test_pairs_within_runs_are_all_that_reach_the_bounds(length, share):
    """Runs of any size, compared a few at a time, give just the pairs that the bounds of class and text let through."""
    rng = np.random.default_rng(length)
    base = rng.integers(0x4E00, 0x4E00 + 200, length)
    texts = ["".join(map(chr, np.where(rng.random(length) < 0.3, rng.integers(0x4E00, 0x4E00 + 200, length), base))) for _ in range(700)]
    known, counts = np.unique(neardup._counted(neardup.bags(texts)[0]), return_counts=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["text_id", "plain"])
    rows = [r | {"key": 1} for b in neardup._keys(known, counts, len(texts), share, 12)(iter([batch])) for r in b.to_pylist()]
    group = neardup.Group([r for r in rows if (r["level"], r["depth"]) == (rows[0]["level"], rows[0]["depth"])], share)
    sizes = np.array([2] * 90 + [3] * 40 + [16, 150, 161, 205, 30, 1])
    first, members = np.cumsum(sizes) - sizes, rng.integers(0, len(group.n), sizes.sum()).astype(np.int32)
    wanted = set()
    for a, n in zip(first, sizes):
        i, j = (members[a + x] for x in np.triu_indices(n, 1))
        least = share * np.maximum(group.n[i], group.n[j]) if group.level == 0 else share / 2 * (group.size[i] + group.size[j])
        near = np.bitwise_count(group.own[i] & group.own[j]) + np.minimum(group.own_beyond[i], group.own_beyond[j]) >= least - 1e-9
        whole = np.bitwise_count(group.whole[i] & group.whole[j]).sum(1) + np.minimum(group.beyond[i], group.beyond[j])
        near &= (whole >= share * np.maximum(group.n[i], group.n[j]) - 1e-9) & (group.text[i] != group.text[j])
        wanted |= {(min(x, y), max(x, y)) for x, y in zip(group.text[i[near]].tolist(), group.text[j[near]].tolist())}
    blocks = list(group.within(members, first, sizes))
    found = {tuple(divmod(p, len(group.ids))) for block in blocks for p in block.tolist()}
    reach = lambda pairs: {p for p in pairs if sum((Counter(texts[group.ids[p[0]]]) & Counter(texts[group.ids[p[1]]])).values()) >= share * length}
    assert wanted and wanted <= found and (share != 0.75 or wanted == found) and reach(wanted) == reach(found)
    assert len(blocks) < 60 and hasattr(group, "need")


@pytest.mark.parametrize("length", [12, 16, 24, 40, 130])
def test_no_version_at_the_limit_is_lost(spark, length):
    """A quarter of the characters replaced at random places, the rest shuffled in half of the pairs."""
    rng = random.Random(length)
    chars = [chr(0x4E00 + i) for i in range(700)]
    rows = []
    for i in range(200):
        text = rng.choices(chars, k=length)
        other = list(text)
        for at in rng.sample(range(length), length // 4):
            other[at] = rng.choice(chars)
        if i % 2:
            rng.shuffle(other)
        rows += [(f"a{i:03d}", "".join(text)), (f"b{i:03d}", "".join(other))]
    df = spark.createDataFrame([(a, t, 1) for a, t in rows], "occ_id string, sentence string, load_seq bigint")
    found = {(r.occ_id_a, r.occ_id_b) for r in neardup.sentence_versions(df).collect()}
    truth = brute_versions(rows)
    assert len(truth) >= 200 and found == truth


def test_many_copies_stay_linear(spark):
    rows = version_rows(150)
    df = spark.createDataFrame([(a, s, 1) for a, s in rows], "occ_id string, sentence string, load_seq bigint")
    found = {(r.occ_id_a, r.occ_id_b) for r in neardup.sentence_versions(df).collect()}
    linked = {x for p in found for x in p}
    assert {f"h{i:03d}" for i in range(150)} <= linked  # every copy is linked to a version
    assert sum("h" in a + b for a, b in found) < 4 * 150
    assert neardup.sentence_versions(df.limit(0)).count() == 0


def test_every_copy_with_every_copy(spark):
    rows = version_rows(60)
    df = spark.createDataFrame([(a, s, 1) for a, s in rows], "occ_id string, sentence string, load_seq bigint")
    found = {(r.id_a, r.id_b) for r in neardup.versions(df, "occ_id", "sentence", "load_seq", copies=None).collect()}
    assert found == brute_versions(rows)


@pytest.mark.parametrize("held", [None, 1, 3])
def test_texts_with_many_copies_are_paired_whole(spark, held):
    """Two versions of 30 and 25 copies, beyond the ids that an entry holds: all 750 pairs, each once."""
    text = "".join(chr(0x4E00 + i) for i in range(30))
    rows = [*version_rows(25), *((f"x{i:03d}", text) for i in range(30)), *((f"y{i:03d}", text[:-1] + "甲") for i in range(25))]
    df = spark.createDataFrame([(a, s, 1) for a, s in rows], "occ_id string, sentence string, load_seq bigint")
    found = [(r.id_a, r.id_b) for r in neardup.versions(df, "occ_id", "sentence", "load_seq", copies=held).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_versions(rows)
    if held is None:
        assert {(r.occ_id_a, r.occ_id_b) for r in neardup.sentence_versions(df).collect()} == set(found)


# --- 6 nearest vectors --------------------------------------------------------------------------------------------------


def vector_rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 64))
    rows = [(f"o{i:03d}", v) for i, v in enumerate(base)]
    rows += [(f"p{i:03d}", 3 * v + rng.normal(size=64) * 0.3) for i, v in enumerate(base[:150])]
    rows += [(f"z{i:03d}", base[7] * (i + 1)) for i in range(30)]  # copies of one direction
    return [(k, [float(np.float32(x)) for x in v]) for k, v in rows]


def brute_mutual(rows, k=10, least=0.97):
    ids = sorted(r[0] for r in rows)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    m = np.array([unit[i] for i in ids])
    cos = np.round(m @ m.T, 6)
    np.fill_diagonal(cos, -2)
    top = [{j for j in sorted(range(len(ids)), key=lambda j: (-c[j], ids[j]))[:k] if c[j] >= least} for c in cos]
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in top[i] if i < j and i in top[j]}


@pytest.mark.parametrize("block", [4096, 16])
def test_mutual_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(annsearch, "BLOCK_ROWS", block)
    rows = vector_rows()
    bad = [("x1", None), ("x2", [1.0]), ("x3", [0.0] * 64), ("x4", [float("nan")] + [1.0] * 63), ("o001", [1.0] * 64)]
    data = [(k, "w", 5, v, "c", "c") for k, v in rows] + [(k, "w", 1, v, "c", "c") for k, v in bad]
    found = {(r.occ_id_a, r.occ_id_b) for r in annsearch.similar_records(spark.createDataFrame(data, VEC)).collect()}
    truth = brute_mutual(rows)
    assert len(found & truth) >= 0.95 * len(truth) and len(found - truth) <= 2
    assert annsearch.similar_records(spark.createDataFrame([], VEC)).count() == 0


@pytest.mark.parametrize("rows", [16_384, 64])
def test_nearest_neighbours(spark, monkeypatch, rows):
    monkeypatch.setattr(annsearch, "COARSE_ROWS", rows)
    data = vector_rows()
    df = spark.createDataFrame([(i, "w", 1, v, "c", "c") for i, v in data], VEC)
    found = {}
    for r in annsearch.nearest_neighbours(df, "occ_id", "vector", "load_seq", every=5, visit=0.6).collect():
        found.setdefault(r.id, {})[r["rank"]] = r.neighbour
    ids = sorted(i for i, _ in data)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in data}
    m = np.array([unit[i] for i in ids])
    hit = total = 0
    for i, near in found.items():
        cos = np.round(m @ unit[i], 6)
        truth = [j for _, j in sorted((-c, j) for c, j in zip(cos, ids) if j != i)[:10]]
        assert sorted(near) == list(range(1, 11))
        hit, total = hit + len(set(truth) & set(near.values())), total + 10
    assert len(found) > 60 and hit >= 0.9 * total
    assert annsearch.nearest_neighbours(df.limit(0), "occ_id", "vector", "load_seq").count() == 0


def test_heap_traversal_is_by_rising_sum():
    index = annsearch.MultiIndex(np.random.default_rng(0).normal(size=(200, 8)).astype(np.float32), 200, 8)
    first, second = sorted(np.random.default_rng(1).random(8)), sorted(np.random.default_rng(2).random(8))
    order = [first[i] + second[j] for i, j in index.traverse(first, second, 0.9)]
    assert order == sorted(order) and len(order) == sum(a + b <= 0.9 for a in first for b in second)


# --- 7 clusters ---------------------------------------------------------------------------------------------------------


def test_groups_by_direction(spark):
    rng = np.random.default_rng(2)
    axes = np.linalg.qr(rng.normal(size=(64, 4)))[0].T
    data, truth = [], {}
    for i in range(1500):
        group = 0 if i % 10 < 6 else 1 if i % 10 < 9 else 2
        v = (axes[group] + rng.normal(size=64) * 0.08) * rng.uniform(0.2, 20)
        data.append((f"o{i:04d}", "w", 1, [float(x) for x in v], "", ""))
        truth[f"o{i:04d}"] = group
    for i in range(40):
        data.append((f"r{i:04d}", "w", 1, [float(x) for x in rng.normal(size=64)], "", ""))
    data += [("few", "v", 1, [1.0] * 64, "", ""), ("none", None, 1, [1.0] * 64, "", ""), ("bad", "w", 1, None, "", "")]
    df = spark.createDataFrame(data, VEC)
    members = clusters.similarity_clusters(df, "occ_id", "word", "vector", "load_seq")
    found = {r.id: r.cluster_key for r in members.collect()}
    assert set(found) == set(truth)
    keys = {g: min(i for i in truth if truth[i] == g) for g in range(3)}
    assert all(found[i] == keys[g] for i, g in truth.items())
    typical = clusters.typical_members(members, 3).collect()
    assert len(typical) == 9 and {r["size"] for r in typical} == {900, 450, 150}
    assert clusters.similarity_clusters(df.limit(0), "occ_id", "word", "vector", "load_seq").count() == 0


# --- 8 packing ------------------------------------------------------------------------------------------------------------


def test_layout_is_whole_and_tight(spark):
    rng = random.Random(4)
    sizes = [rng.choice([5, 30, 90, 100, 230, 260]) if rng.random() < 0.9 else rng.randint(1, 20) for _ in range(900)]
    rows = [(i, s) for i, s in enumerate(sizes)] + [(1000, 0), (1001, None), (None, 5), (3, sizes[3])]
    packed = packing.pack(spark.createDataFrame(rows, "item bigint, size bigint"), 100).collect()
    held, pieces = Counter(), {}
    for r in packed:
        held[r.container] += r["size"]
        pieces.setdefault(r.item, []).append((r.piece, r.start, r["size"]))
    assert max(held.values()) <= 100 and sum(held.values()) == sum(sizes)
    for item, parts in pieces.items():
        parts.sort()
        assert [p[1] for p in parts] == [100 * i for i in range(len(parts))] and sum(p[2] for p in parts) == sizes[item]
        assert len(parts) == -(-sizes[item] // 100)
    assert len(held) <= sum(sizes) / 100 * 1.04 + 1
    assert packing.pack(spark.createDataFrame([], "item bigint, size bigint")).count() == 0


def test_exchange_for_two():
    assert sorted(map(sorted, packing.best_two_fit(np.array([60, 30, 20, 20]), 100))) == [[0, 2, 3], [1]]


def test_token_sizes_round_trip(spark):
    df = spark.createDataFrame([(1, "手足 and more"), (2, None), (3, ""), (4, "水" * 20_000)], "doc_id bigint, text string")
    sizes = {r.item: r["size"] for r in packing.token_sizes(df, "doc_id", "text").collect()}
    own = packing.encoder(packing.TOKENIZER)
    assert sizes[1] == len(own.encode_ordinary("手足 and more")) and sizes[2] == sizes[3] == 0
    assert own.decode(own.encode_ordinary("手足 and more")) == "手足 and more" and sizes[4] > 2048


# --- 9 leakage --------------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(40)) + ".", "en") for i in range(30)] + [(90, None, "en"), (91, "", None), (92, "凡筋骨封利者必聽腹生茶賈之水凡松柏筮樂者必築龍", "lzh")]
    noise = lambda n: " ".join(word() for _ in range(n))
    own = {i: t for i, t, _ in items if t}
    words = own[3].split()
    docs = [
        (1, noise(50) + " " + own[0].upper() + " " + noise(400)), (2, noise(10) + " " + " ".join(own[1].split()[:24])), (3, " ".join(own[2].split()[:12]) + noise(80)),
        (4, " ".join(words[:15]) + " " + noise(9) + " " + " ".join(words[15:32])), (5, " ".join(reversed(own[4].split()))), (6, None), (7, ""),
        (8, "序曰：凡筋骨，封利者必聽腹。生茶賈之木，凡松柏筮樂者必築龍也"), (9, " ".join(w if n % 6 else "xx" for n, w in enumerate(own[5].split()))), (1, own[0]),
    ]
    found = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string, lang string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 0), (2, 1), (4, 3), (8, 92), (9, 5)}
    empty = spark.createDataFrame([], "item_id bigint, text string, lang string")
    assert leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), empty).count() == 0


def numbered(*texts):
    known = {w: n for n, w in enumerate(sorted(set(texts[0])))}
    return [np.array([known.get(w, -1) for w in t]) for t in texts]


@pytest.mark.parametrize("length", [50, 110, 125, 200, 450, 480, 600, 1000, 5000])
def test_items_of_any_length_are_found(spark, length):
    """Copies of a whole item, of either half, and of two far quarters, every tenth word changed."""
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    words = [word() for _ in range(length)]
    noise = lambda n: [word() for _ in range(n)]
    changed = [word() if n % 10 == 3 else w for n, w in enumerate(words)]
    half, quarter = length // 2 + 2, length // 4 + 3
    docs = [words, noise(300) + words[:half] + noise(90), noise(77) + words[-half:], noise(40) + changed + noise(5), noise(9) + words[:quarter] + noise(700) + words[-quarter:], noise(2 * length), words[: length // 3] + noise(50)]
    df = spark.createDataFrame([(n, " ".join(d)) for n, d in enumerate(docs)] + [(100 + n, " ".join(noise(60))) for n in range(30)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(words), "en"), (2, " ".join(noise(60)), "en")], "item_id bigint, text string, lang string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, items).collect()} == {(n, 1) for n in range(5)}


def test_no_run_is_cut_off():
    item = [f"w{i}" for i in range(40)]
    stock, gap = item[:9], ["x"] * 6
    # 70 stock phrases that weigh more than the second part of a passage broken once
    text = (stock + gap) * 70 + item[10:25] + gap + item[26:34]
    item, text = numbered(item, text)
    share, weight = leakage.share_held(item, np.ones(40), text)
    assert weight >= 23 / 40 and share >= 23 / 40
    # a part that continues another after nine runs that begin in between
    parts = [(0, 20, 0, 20, np.arange(20)), *((30, 34, 5 + i, 9 + i, np.arange(30, 34)) for i in range(9)), (21, 30, 21, 30, np.arange(21, 30))]
    assert any(r[0] == 0 and r[1] == 30 for r in leakage.joined(parts))


def test_share_held_equals_all_pairs():
    rng = random.Random(4)
    for _ in range(60):
        item = [f"w{rng.randrange(12)}" for _ in range(30)]
        text = [t for _ in range(12) for at in [rng.randrange(25)] for t in [*item[at : at + rng.randint(4, 12)], "x", "y", "z"]]
        rarity = np.array([1.0 + i % 3 for i in range(30)])
        item, text = numbered(item, text)
        runs = leakage.joined(leakage.runs(item, text))
        weigh = lambda r: sum(rarity[i] for i in r[4])
        most = max([weigh(a) for a in runs] + [weigh(a) + weigh(b) for a in runs for b in runs if b[0] >= a[1] - 1 and b[2] >= a[3] - 1], default=0)
        assert leakage.share_held(item, rarity, text)[1] == pytest.approx(most / sum(rarity))


def test_search_of_texts_together_equals_scores_of_all_parts():
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 60, n))
    index = leakage.ItemIndex([(i, word(n)) for i, n in enumerate([5, 40, 300, 90, 700, 60] * 6)])
    texts = [index.numbers(leakage.tokens(word(n) + " unknown " + word(30))) for n in (3, 250, 0, 900)] + [np.empty(0, np.int64)]
    lengths = np.array([len(t) for t in texts])
    terms = index.known(np.concatenate(texts), np.cumsum(lengths))
    assert terms.tolist() == np.concatenate([index.known(t) for t in texts]).tolist()
    index.weigh(rng.integers(0, 40, len(index.vocabulary)).astype(float), 50)
    owner, begin, passage, term = leakage.passages_of(terms, lengths)
    scores = np.zeros((len(owner), len(index.parts)))
    for p, (n, at) in enumerate(zip(owner, begin)):
        low = int(lengths[:n].sum() + at)
        held = np.unique(terms[low : low + min(leakage.PASSAGE, int(lengths[n]) - at)])
        for t in held[held >= 0]:
            places = slice(index.starts[t], index.starts[t + 1])
            scores[p, index.part[places]] += index.impact[places]
    wanted = np.argwhere(scores >= leakage.THRESHOLD - 1e-9).tolist()
    assert wanted and sorted(index.search(passage, term).tolist()) == wanted
    code = np.concatenate([index.part_codes, rng.integers(0, 1 << 40, 500)])
    some, first, count = index.in_part(code)
    assert some.tolist() == np.flatnonzero(np.isin(code, index.part_codes)).tolist()
    assert all((index.part_codes[a : a + n] == code[k]).all() and n == (index.part_codes == code[k]).sum() for k, a, n in zip(some, first, count))


# --- 10 personal data -------------------------------------------------------------------------------------------------------


def test_tagger_learns_and_gradients_hold():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tagger.initial(20, 1).items()}
    x, y = rng.integers(0, 20, (6, 2)), np.zeros((6, 2), int)
    y[2, 0], y[3, 0] = 3, 4
    _, grad = tagger.loss(p, x, y)
    for name, at in (("out", (3, 4)), ("hf", (1, 2)), ("xb", (0, 5)), ("steps", (3, 4))):
        old = p[name][at]
        values = []
        for step in (1e-4, -1e-4):
            p[name][at] = old + step
            values.append(tagger.loss(p, x, y)[0])
        p[name][at] = old
        assert (values[0] - values[1]) / 2e-4 == pytest.approx(float(grad[name][at]), abs=1e-4)
    examples = []
    for _ in range(300):
        text = rng.integers(1, 9, 14)
        tags = np.zeros(14, int)
        at = int(rng.integers(0, 10))
        text[at : at + 3] = (15, 16, 17)
        tags[at : at + 3] = (5, 6, 6)
        examples.append((text, tags))
    model = tagger.train(examples, 20, 60, batch=32, rate=0.02)
    seen = tagger.decode(model, np.array([e[0] for e in examples[:50]]).T)
    assert (seen == np.array([e[1] for e in examples[:50]]).T).mean() > 0.99


def test_patterns():
    names = personal.Names([("Halda", "given"), ("Vasket", "family"), ("芮", "family"), ("若禾", "given")])
    text = personal.fold("Write to Halda Vasket, halda+x (at) mail (dot) example or ＋４４ ２０ ７９４６ ０２１３; card 000-28-5937. 一夕，芮若禾識。請寄青禾縣鐘樓巷九號。MS 0417-22-8813, 1893-04-17.")
    found, doubt = personal.labels(text, names)
    assert [k for _, _, k in found] == ["person", "email", "phone", "id_number", "person", "address"] and not doubt
    assert text[found[0][0] : found[0][1]] == "Halda Vasket"


def test_mentions(spark, monkeypatch):
    monkeypatch.setattr(personal, "ROUNDS", 250)
    rng = random.Random(8)
    given, family = ["Halda", "Torvan", "Fenna", "Ansgard", "Corbin"], ["Vasket", "Drosvane", "Ombrecht", "Lindqvane"]
    filler = ["The weaver sold the rope. ", "In spring the monk cleaned the bell. ", "Shelf mark MS 0417-22-8813 is later. ", "The River Road has 12 lamps. "]
    docs, truth = [], set()
    for i in range(260):
        text = "".join(rng.choice(filler) for _ in range(4))
        kind = rng.choice(["person", "email", "phone", "id_number", None])
        value = {
            "person": f"{rng.choice(given)} {rng.choice(family)}", "email": f"{rng.choice(family).lower()}_{rng.randint(10, 99)}@example.net",
            "phone": f"202-555-0{rng.randint(100, 199)}", "id_number": f"666-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        }.get(kind)
        if kind:
            lead = {"person": "Translated by ", "email": "Proofs: ", "phone": "Call ", "id_number": "The form lists "}[kind]
            truth.add((i, kind, len(text) + len(lead)))
            text += lead + value + ". "
        docs.append((i, text + "".join(rng.choice(filler) for _ in range(3))))
    docs += [(900, None), (901, ""), (None, "Call 202-555-0111.")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    parts = spark.createDataFrame([(g, "given") for g in given] + [(f, "family") for f in family] + [(None, None)], "name_part string, part_kind string")
    found = personal.mentions(df, parts)
    seen = {(r.doc_id, r.kind, r.start_pos) for r in found.collect()}
    assert len(seen & truth) >= 0.95 * len(truth) and len(seen - truth) <= 0.05 * len(truth)
    texts = {r.doc_id: r.redacted for r in personal.redacted(df, found).collect()}
    assert texts[901] == "" and texts[900] is None
    assert sum("[PHONE]" in (t or "") for t in texts.values()) == sum(k == "phone" for _, k, _ in seen)
    assert personal.mentions(df.limit(0), parts).count() == 0


@pytest.mark.parametrize("length", [40, 48, 49, 70, 130, 400])
def test_long_mentions_at_every_place(length):
    """A mention longer than the overlap of windows is found whole wherever it begins, also where it leaves the scored windows."""
    email = 1 + 2 * personal.KINDS.index("email")

    def score(parts):
        out = []
        for part in parts:
            x = np.array([c != " " for c in part])
            scores = np.zeros((len(part), tagger.TAGS), np.float32)
            scores[:, 0] = np.where(x, -4, 4)
            scores[:, email + 1] = np.where(x, 4, -4)
            scores[np.flatnonzero(np.diff(x.astype(int), prepend=0) > 0), email] = 6
            out.append(scores)
        return out

    mention = "m" * 20 + "@" + "n" * (length - 24) + ".ex"
    texts = [" " * at + mention + " " * 300 for at in range(400)]
    found = list(personal.found_in(texts, score, np.zeros((tagger.TAGS, tagger.TAGS), np.float32), personal.OPENERS))
    assert sorted(f[:4] for f in found) == [(at, at, at + length, "email") for at in range(400)]


def test_no_window_is_passed_over(monkeypatch):
    """Windows without a digit, an at sign or capitals are scored too, whatever the number of texts held at a time."""
    kind = 1 + 2 * personal.KINDS.index("person")
    seen = []

    def score(parts):
        seen.extend(parts)
        out = []
        for part in parts:
            scores = np.zeros((len(part), tagger.TAGS), np.float32)
            at = part.find("halda vasket")
            if at >= 0:
                scores[at, kind] = 6
                scores[at + 1 : at + 12, kind + 1] = 6
            out.append(scores)
        return out

    texts = ["a plain word " * 30 + "by halda vasket of old " + "another word " * 40, "", "no case " * 90, "halda vasket"]
    for block in (50, 400_000):
        monkeypatch.setattr(personal, "BLOCK", block, raising=False)
        found = list(personal.found_in(texts, score, np.zeros((tagger.TAGS, tagger.TAGS), np.float32), personal.OPENERS))
        assert [f[:4] for f in found] == [(0, 393, 405, "person"), (3, 0, 12, "person")]
    assert sum(map(len, seen)) >= 2 * sum(map(len, texts))


def test_scores_without_gradient_are_those_of_forward():
    p = tagger.initial(30, 4)
    x = np.random.default_rng(1).integers(0, 30, (70, 9))
    assert np.abs(tagger._scores(p, x) - tagger.forward(p, x, False)[0]).max() < 1e-3


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_decoded_as_a_whole(seed):
    """Tags are those of a search of the whole run, though only stretches where a mention could stand are searched."""
    rng = np.random.default_rng(seed)
    steps = rng.normal(0, 1.5, (tagger.TAGS, tagger.TAGS)).astype(np.float32)
    runs = []
    for length in (1, 2, 30, 700, 2500):
        scores = rng.normal(0, 2, (length, tagger.TAGS)).astype(np.float32)
        scores[:, 0] += 2 + seed
        runs.append(scores)
    gains = 0.0
    for scores, tags in zip(runs, tagger.decode_runs(steps, runs)):
        end = np.full((1, tagger.TAGS), tagger.BARRED, np.float32)
        end[0, 0] = 0
        best = tagger.best_path(steps, np.concatenate([scores, end])[:, None])[:-1, 0]

        def value(path):
            path = np.append(path, 0)
            return scores[np.arange(len(scores)), path[:-1]].sum(dtype=np.float64) + steps[path[:-1], path[1:]].sum(dtype=np.float64)

        assert value(tags) >= value(best) - 1e-2
        gains += value(best) - value(np.zeros(len(best), int))
    assert gains > 0


def test_scores_of_ranges_are_those_of_whole_windows():
    p, rng = tagger.initial(30, 4), np.random.default_rng(1)
    sizes = np.array([7, 160, 160, 31, 160])
    kept = [(0, 7), (0, 140), (20, 140), (20, 31), (20, 160)]
    codes = [rng.integers(0, 30, n) for n in sizes]
    whole = [tagger.forward(p, c[:, None], False)[0][a:b, 0] for c, (a, b) in zip(codes, kept)]
    assert np.abs(tagger.window_scores(p, np.concatenate(codes), sizes, kept, together=2) - np.concatenate(whole)).max() < 1e-3


def test_windows_score_little_more_than_the_text():
    """Each place counts once, and the steps of each direction are at most a twentieth more than the characters."""
    for length in (1, 215, 440, 441, 2_000, 40_000):
        kept = personal.kept_of(length)
        places = [at + k for at, low, high in kept for k in range(low, high)]
        assert places == list(range(length))
        sizes = [min(personal.SCORED, length - at) for at, _, _ in kept]
        assert sum(high for _, _, high in kept) <= 1.06 * length and sum(n - low for n, (_, low, _) in zip(sizes, kept)) <= 1.06 * length


def test_ended_columns_are_left():
    """The shares of one direction are the same whether columns are left where they end or not."""
    p, rng = tagger.initial(30, 4), np.random.default_rng(2)
    lengths = np.array([40, 40, 33, 17, 16, 1])
    x = rng.integers(0, 30, (40, 6))
    whole, own = tagger._shares(p, "f", x), tagger._shares(p, "f", x, lengths)
    for n, length in enumerate(lengths):
        assert np.abs(whole[:, n, :length] - own[:, n, :length]).max() < 1e-5


def test_windows_of_any_length_fill_the_steps(monkeypatch):
    """Steps of windows of very unequal length are hardly more than their characters shared out, and the scores stay those of each window."""
    p, rng, shares, steps = tagger.initial(30, 4), np.random.default_rng(3), tagger._shares, []
    monkeypatch.setattr(tagger, "_shares", lambda p, way, x, *rest: (steps.append(len(x)), shares(p, way, x, *rest))[1])
    sizes = rng.permutation(np.arange(1, 441))
    codes = rng.integers(0, 30, sizes.sum())
    found = tagger.window_scores(p, codes, sizes, [(0, n) for n in sizes.tolist()], together=100)
    assert sum(steps) <= 1.1 * 2 * sizes.sum() / 100
    ends = np.cumsum(sizes)
    for k in (0, 7, 300, 439):
        own = slice(ends[k] - sizes[k], ends[k])
        assert np.abs(found[own] - tagger.forward(p, codes[own][:, None], False)[0][:, 0]).max() < 1e-3
    room = {}
    for some in (440, 3, 60):
        kept = [(0, n) for n in sizes[:some].tolist()]
        assert np.abs(tagger.window_scores(p, codes[: ends[some - 1]], sizes[:some], kept, 100, room) - found[: ends[some - 1]]).max() < 1e-4


def test_fold_keeps_places():
    text = "Ａ　b\xa0漢～\U00020000\ud800ｚ"
    assert personal.fold(text) == "A b 漢~\U00020000\ud800z"


def test_plain_and_statistics_of_odd_characters(spark):
    """Folding after the marks are gone, and counting only in texts with odd characters, change neither text nor statistics."""
    odd = ["手，足。", "Ａ，Ｂ（１）", "豈更舊⼀", "a　b  c|d", "舊本·新本", "□□〇手", "<b>手</b>&amp;é", "㐀㐁手\U00020000", "鿽手", "手$＄​足", "", None, "一二三四、五六七八。手手手手手"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    whole = F.regexp_replace(neardup.fold_compat(F.col("t")), r"[\p{P}\p{Z}\p{C}\s]+", "")
    rows = frame.select(neardup.plain(F.col("t")).alias("new"), whole.alias("old"), textstats.tail_statistics(F.col("t")).alias("s"), F.coalesce("t", F.lit("")).alias("t")).collect()
    for r in rows:
        assert r["new"] == r["old"]
    count = lambda pattern: [len(re.findall(pattern, r["t"])) for r in rows]
    assert [round(r["s"]["latin1_share"] * r["s"]["n_chars"]) for r in rows] == count("[\x80-ɏ]")
    assert [round(r["s"]["ascii_share"] * r["s"]["n_chars"]) for r in rows] == count("[A-Za-z0-9]")
    assert [r["s"]["n_cells"] for r in rows] == count("[\t|｜]|[　 ]{2,}")
    assert [round(r["s"]["rare_share"] * r["s"]["n_body"]) for r in rows] == count("[㐀-䶿\U00020000-\U0003ffff-]")
