"""Test items inside training texts: BM25 retrieval of items by passage with block-max pruning, then verification."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphdrift.session import written

K1, B = 1.2, 0.5
PASSAGE, STRIDE = 160, 64  # tokens of a passage and from one's start to the next's; they cover the whole text
PART = 96  # tokens of a part of an item; items of less than twice as many are one part if they fit a passage
BLOCK_PARTS = 16
THRESHOLD = 0.125  # least share of a part's own score: half of what must be held (it may stand in two places), and of that half the word pairs without a change
SEARCHED = 300_000  # tokens of the texts that are searched together
INDEX_TOKENS = 2_000_000  # characters of the items of one index; more are searched by further passes
LEAST_SHARE = 0.5  # of an item's wording
LEAST_WEIGHT = 0.45  # of the summed rarity of an item's words, so that stock phrases alone don't make a case
JUMP = 2  # equal tokens of a running passage lie at most this far apart: single tokens may differ
LEAST_RUN = 4  # equal tokens of a run
DRIFT = 32  # by half as many tokens, put in or left out, a place may differ from its part of the item

IDEOGRAPH = "㐀-䶿一-鿿\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[{IDEOGRAPH}]|[^\W_{IDEOGRAPH}]+")


def tokens(text: str) -> list[str]:
    """Words, and single ideographs, without case, width, punctuation and spacing."""
    return TOKEN.findall(unicodedata.normalize("NFKC", text).lower())


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``counts`` places from ``starts`` on: the run's number, and the places."""
    return np.repeat(np.arange(len(counts)), counts), places(starts, counts)


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of runs of ``counts`` from ``starts`` on."""
    out = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    out += np.arange(len(out))
    return out


class ItemIndex:
    """Inverted index of the parts of test items, with BM25 impacts as shares of a part's own score.

    Terms are pairs of neighbouring words or ideographs, as single ones tell little. A term's postings are the parts
    that hold it with its impact there; ``block_top`` holds a term's largest impact within each block of parts, and
    ``top`` that of all. Items are ordered by language so that the parts of a block are alike.
    """

    def __init__(self, items: list[tuple[int, str]]) -> None:
        texts = [tokens(t) for _, t in items]
        self.ids = [i for i, _ in items]
        self.number = {w: n for n, w in enumerate(sorted({w for t in texts for w in t}))}
        self.words = [self.numbers(t) for t in texts]
        codes = [self.codes(w) for w in self.words]
        self.vocabulary = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)
        self.terms = [np.searchsorted(self.vocabulary, c) for c in codes]
        self.parts = [(n, a, b) for n, w in enumerate(self.words) for a, b in parts_of(len(w))]

    def numbers(self, words: list[str]) -> np.ndarray:
        """Word numbers, -1 for words of no item."""
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def codes(self, words: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """A code for each place, of the word and its follower; -1 where one is in no item. ``words`` may hold several texts, with their ``ends``."""
        follower = np.append(words[1:], -2)  # -2: the end
        if ends is not None:
            follower[ends[ends > 0] - 1] = -2
        return np.where((words < 0) | (follower == -1), -1, (words << 31) | (follower + 2))

    def known(self, words: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """Term number of each place of a text (or of several, see ``codes``), -1 for terms of no item."""
        code = self.codes(words, ends)
        out = np.full(len(words), -1, np.int64)
        some = np.flatnonzero(code >= 0)
        at = np.minimum(np.searchsorted(self.vocabulary, code[some]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == code[some]
        out[some[same]] = at[same]
        return out

    def weigh(self, seen: np.ndarray, total: int) -> None:
        """Fill the postings from the number of corpus texts, of ``total``, that hold each term."""
        rarity = np.log(1 + (max(total, seen.max(initial=0)) - seen + 0.5) / (seen + 0.5))
        self.rarity = [rarity[t] for t in self.terms]
        mean = sum(b - a for _, a, b in self.parts) / max(1, len(self.parts))
        term, part, impact = [], [], []
        for p, (n, a, b) in enumerate(self.parts):
            own, times = np.unique(self.terms[n][a:b], return_counts=True)
            weight = rarity[own] * times * (K1 + 1) / (times + K1 * (1 - B + B * (b - a) / mean))
            term.append(own)
            part.append(np.full(len(own), p))
            impact.append(weight / (weight.sum() or 1.0))
        term, part, impact = np.concatenate(term), np.concatenate(part), np.concatenate(impact)
        order = np.lexsort((part, term))
        self.part, self.impact = part[order], impact[order]
        self.part_block = self.part // BLOCK_PARTS
        self.starts = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        blocks = -(-len(self.parts) // BLOCK_PARTS)
        key = term[order] * blocks + self.part // BLOCK_PARTS
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.block, self.block_top = key[first] % blocks, np.maximum.reduceat(self.impact, first)
        self.block_starts = np.searchsorted(key[first] // blocks, np.arange(len(self.vocabulary) + 1))
        self.top = np.maximum.reduceat(self.impact, self.starts[:-1])
        sizes = np.array([b - a for _, a, b in self.parts])
        self.part_starts = np.cumsum(sizes) - sizes
        self.part_rarity = np.concatenate([self.rarity[n][a:b] for n, a, b in self.parts])
        self.part_weight = np.maximum(np.add.reduceat(self.part_rarity, self.part_starts), 1e-9)
        codes = np.concatenate([(p << 31) | self.words[n][a:b] for p, (n, a, b) in enumerate(self.parts)])
        order = np.argsort(codes, kind="stable")
        self.part_codes, self.part_places = codes[order], np.concatenate([np.arange(n) for n in sizes])[order]
        first = np.flatnonzero(np.diff(self.part_codes, prepend=-1))
        self.part_runs = np.repeat(np.diff(np.append(first, len(codes))), np.diff(np.append(first, len(codes))))
        self.shift = 64 - max(12, int(len(codes)).bit_length() + 5)
        self.marked = np.zeros(1 << (64 - self.shift), bool)
        self.marked[self.mark(self.part_codes)] = True

    def mark(self, code: np.ndarray) -> np.ndarray:
        """A place in ``marked``, where only codes of parts are true, and few others."""
        return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def in_part(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the codes (part and word) are in a part, and of those the first place in ``part_codes`` and how many."""
        some = np.flatnonzero(self.marked[self.mark(code)])
        low = np.minimum(np.searchsorted(self.part_codes, code[some]), len(self.part_codes) - 1)
        same = self.part_codes[low] == code[some]
        return some[same], low[same], self.part_runs[low[same]]

    def search(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """(passage, part) of every score of at least the threshold; ``passage`` is sorted, its terms are distinct.

        A passage's terms are put in rising order of their largest impact. Those before the pivot, where the sum of
        largest impacts reaches the threshold, can't bring a part there alone: only blocks with a posting of a later
        term are looked at, if the sum of the block's largest impacts reaches it, and only their parts are scored.
        """
        order = np.lexsort((self.top[term], passage))
        passage, term = passage[order], term[order]
        total = np.cumsum(self.top[term])
        first = np.flatnonzero(np.diff(passage, prepend=-1))
        before = np.repeat((total - self.top[term])[first], np.diff(np.append(first, len(passage))))
        late = np.flatnonzero(total - before >= THRESHOLD - 1e-9)
        blocks = -(-len(self.parts) // BLOCK_PARTS)
        size = (int(passage[-1]) + 1 if len(passage) else 0) * blocks
        counts = np.diff(self.block_starts)
        seen = np.zeros(size, bool)
        seen[np.repeat(passage[late] * blocks, counts[term[late]]) + self.block[places(self.block_starts[term[late]], counts[term[late]])]] = True
        own = np.flatnonzero(seen.reshape(-1, blocks).any(1)[passage])
        at = places(self.block_starts[term[own]], counts[term[own]])
        bounds = np.bincount(np.repeat(passage[own] * blocks, counts[term[own]]) + self.block[at], self.block_top[at], size)
        seen &= bounds >= THRESHOLD - 1e-9
        own = np.flatnonzero(seen.reshape(-1, blocks).any(1)[passage])
        kept = np.flatnonzero(seen)
        slot = np.full(size, -1, np.int64)
        slot[kept] = np.arange(len(kept))
        counts = np.diff(self.starts)[term[own]]
        at = places(self.starts[term[own]], counts)
        inside = slot[np.repeat(passage[own] * blocks, counts) + self.part_block[at]]
        some = np.flatnonzero(inside >= 0)
        key = inside[some] * BLOCK_PARTS + self.part[at[some]] % BLOCK_PARTS
        found = np.flatnonzero(np.bincount(key, self.impact[at[some]], len(kept) * BLOCK_PARTS) >= THRESHOLD - 1e-9)
        place = kept[found // BLOCK_PARTS]
        return np.stack([place // blocks, place % blocks * BLOCK_PARTS + found % BLOCK_PARTS], 1)


def parts_of(length: int) -> list[tuple[int, int]]:
    """An item's parts: of about ``PART`` tokens, the whole item if a passage's step can't miss it."""
    count = max(1, length // PART) if length > PASSAGE - STRIDE + PART // 4 else min(1, length)
    bounds = [length * n // count for n in range(count + 1)] if count else []
    return list(zip(bounds, bounds[1:]))


def passages_of(terms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages of the texts' term numbers, which stand one after the other: the text and beginning of each, then passage and term of each distinct known term."""
    count = np.maximum(1, -(-(lengths - PASSAGE) // STRIDE) + 1)
    text = np.repeat(np.arange(len(lengths)), count)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    offset = np.cumsum(lengths) - lengths
    size = np.minimum(PASSAGE, lengths[text] - begin)
    row, at = spread(offset[text] + begin, size)
    held = np.flatnonzero(terms[at] >= 0)
    key = np.sort((row[held] << 32) | terms[at[held]])
    key = key[np.flatnonzero(np.diff(key, prepend=-1))]
    return text, begin, key >> 32, key & (2**32 - 1)


def places_of(index: ItemIndex, words: np.ndarray, ends: np.ndarray, begin: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For each hit, of a passage that begins at ``begin`` and a part: the largest weight of its runs there that shift by less than ``DRIFT``, as a share of the part's.

    ``words`` holds texts one after the other and ``ends`` the end of each hit's text. The surroundings of half a step on
    either side belong to a passage, so every place of a part lies whole in one of them.
    """
    known = np.flatnonzero(words >= 0)
    first, last = np.searchsorted(known, begin), np.searchsorted(known, np.minimum(begin + PASSAGE + STRIDE, ends))
    at = places(first, last - first)
    some, low, count = index.in_part(np.repeat(part << 31, last - first) | words[known][at])
    row = np.repeat(np.searchsorted(np.cumsum(last - first), some, side="right"), count)
    i = index.part_places[places(low, count)]
    key = np.sort((row << 44) | ((np.repeat(known[at[some]], count) - begin[row] - i + 2 * PASSAGE + 2**14) << 20) | i)
    way, i = key >> 20, key & (2**20 - 1)
    first = np.flatnonzero((np.diff(way, prepend=-1) != 0) | (np.diff(i, prepend=0) > JUMP))
    if not len(first):
        return np.zeros(len(begin))
    last = np.append(first[1:], len(i)) - 1
    hit, count = way[first] >> 24, last + 1 - first
    kept = (count >= LEAST_RUN) & (count >= 0.7 * (i[last] + 1 - i[first]))
    weight = np.add.reduceat(index.part_rarity[index.part_starts[part[way >> 24]] + i], first)
    hit, weight, shift = hit[kept], weight[kept], (way[first] & (2**24 - 1))[kept]
    best = np.zeros(len(begin))
    for half in (0, DRIFT // 2):
        band = (hit << 24) | ((shift + half) // DRIFT)
        ends_of = np.flatnonzero(np.diff(band, append=-1)) if len(band) else np.empty(0, np.int64)
        total = np.diff(np.cumsum(weight)[ends_of], prepend=0.0)
        np.maximum.at(best, hit[ends_of], total)
    return best / index.part_weight[part]


Run = tuple[int, int, int, int, np.ndarray]


def runs(item: np.ndarray, text: np.ndarray) -> list[Run]:
    """Running passages: (item start, item end, text start, text end, item positions of equal tokens), by diagonals.

    A run holds equal tokens of one diagonal with at most ``JUMP`` - 1 differing ones between neighbours, and has at
    least ``LEAST_RUN`` equal tokens. Neighbouring diagonals (a word left out or put in) are joined afterwards.
    """
    order = np.argsort(item, kind="stable")
    low, high = np.searchsorted(item[order], text), np.searchsorted(item[order], text, side="right")
    row, at = spread(low, np.where(text < 0, 0, high - low))
    i = order[at]
    way = row - i
    order = np.lexsort((i, way))
    i, way = i[order], way[order]
    first = np.flatnonzero((np.diff(way, prepend=way[:1] - 1) != 0) | (np.diff(i, prepend=0) > JUMP))
    ends = np.append(first[1:], len(i))
    length = i[ends - 1] + 1 - i[first] if len(i) else np.empty(0, np.int64)
    kept = np.flatnonzero((ends - first >= LEAST_RUN) & (ends - first >= 0.7 * length))
    return [(int(i[a]), int(i[b - 1]) + 1, int(i[a] + way[a]), int(i[b - 1] + way[a]) + 1, i[a:b]) for a, b in zip(first[kept].tolist(), ends[kept].tolist())]


def joined(pieces: list[Run]) -> list[Run]:
    """Runs that continue each other with a small shift become one.

    Open runs are kept by the place where they end in the text and in the item, so every earlier run is within reach;
    of several that a run continues, the latest begun counts.
    """
    out: list[Run] = []
    ends: dict[tuple[int, int], list[int]] = {}
    near = range(-2, JUMP + 1)
    for r in sorted(pieces, key=lambda r: (r[2], r[0])):
        reach = (n for x in near for y in near for n in ends.get((r[2] - x, r[0] - y), ()) if r[1] > out[n][1])
        n = max(reach, default=None)
        if n is None:
            n = len(out)
            out.append(r)
        else:
            q = out[n]
            ends[q[3], q[1]].remove(n)
            out[n] = (q[0], r[1], q[2], r[3], np.append(q[4], r[4][r[4] > q[4][-1]]))
        ends.setdefault((out[n][3], out[n][1]), []).append(n)
    return out


def share_held(item: np.ndarray, rarity: np.ndarray, text: np.ndarray) -> tuple[float, float]:
    """Of the item, the share of tokens and of their rarity in the text's best running passage, broken at most once.

    Both parts of a broken passage stand in the item's order. The best later part of each run comes from a sweep over
    falling text places; ``best`` holds, for each place in the item, the best run that begins there or later.
    """
    pieces = joined(runs(item, text))
    length, whole = max(1, len(item)), float(rarity.sum()) or 1.0
    weight = [float(rarity[r[4]].sum()) for r in pieces]
    top = (0.0, 0.0)
    later = sorted(range(len(pieces)), key=lambda n: -pieces[n][2])
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)] * (len(item) + 1)
    at = 0
    for a in sorted(range(len(pieces)), key=lambda n: -pieces[n][3]):
        start, end, _, text_end, _ = pieces[a]
        while at < len(later) and pieces[later[at]][2] >= text_end - 1:
            b = later[at]
            own = (weight[b], pieces[b][1] - pieces[b][0], pieces[b][0])
            for place in range(pieces[b][0], -1, -1):
                if best[place] >= own:
                    break
                best[place] = own
            at += 1
        top = max(top, (weight[a] / whole, (end - start) / length))
        more, more_length, first = best[max(0, end - 1)]
        if more_length:
            top = max(top, ((weight[a] + more) / whole, (end - start + first + more_length - max(first, end)) / length))
    return top[1], top[0]


def _number(index: ItemIndex) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [index.numbers(tokens(t)).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.binary())], names=["doc_id", "words"])

    return run


def _count(index: ItemIndex) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(index.vocabulary), np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lengths = np.array([len(w) // 4 for w in texts], np.int64)
            term = index.known(np.frombuffer(b"".join(texts), "<i4").astype(np.int64), np.cumsum(lengths))
            held = np.flatnonzero(term >= 0)
            key = np.sort(np.repeat(np.arange(len(texts)), lengths)[held] * len(seen) + term[held])
            seen += np.bincount(key[np.flatnonzero(np.diff(key, prepend=-1))] % len(seen), minlength=len(seen))
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], names=["term", "n"])

    return run


def _scan(index: ItemIndex) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    item_of = np.array([n for n, _, _ in index.parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(w, "<i4").astype(np.int64) for w in batch.column(1).to_pylist()]
            docs, items, shares = [], [], []
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size < SEARCHED):
                    size += len(texts[last])
                    last += 1
                near = texts[first:last]
                words, lengths = np.concatenate(near), np.array([len(t) for t in near], np.int64)
                owner, begin, passage, term = passages_of(index.known(words, np.cumsum(lengths)), lengths)
                hits = index.search(passage, term)
                offset = np.cumsum(lengths) - lengths
                text = owner[hits[:, 0]]
                held = places_of(index, words, (offset + lengths)[text], offset[text] + np.maximum(0, begin[hits[:, 0]] - STRIDE // 2), hits[:, 1])
                hits = hits[held >= LEAST_WEIGHT / 2 - 1e-9]
                for key in np.unique(owner[hits[:, 0]] * len(index.ids) + item_of[hits[:, 1]]).tolist():
                    doc, item = first + key // len(index.ids), key % len(index.ids)
                    share, weight = share_held(index.words[item], index.rarity[item], texts[doc])
                    if share >= LEAST_SHARE and weight >= LEAST_WEIGHT:
                        docs.append(batch.column(0)[doc].as_py())
                        items.append(index.ids[item])
                        shares.append(share)
                first = last
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(items, pa.int64()), pa.array(shares, pa.float64())], names=["doc_id", "item_id", "share"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, share) of every document that holds at least half of a test item's wording.

    The parts of the items form an inverted index that goes to every task (items of at most ``INDEX_TOKENS`` characters, as the
    test material is small; further items are searched by further passes). Each overlapping passage of each text
    (written once as word numbers) retrieves all parts whose BM25 score reaches ``THRESHOLD`` of their own, by block-max pruning behind a pivot; term
    rarity is counted over the corpus. Of an item that is half held in at most two places, one place holds a quarter
    of a part at least; passages without such a place are passed over, and the item is then verified token by token
    against the whole text. Items or texts that are null or without tokens hold nothing; repeated document rows
    give one row, repeated items one row for each item id. Rows without ids are left out.
    """
    rows = items.select(F.col("item_id").cast("bigint"), F.col("text"), F.col("lang")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    texts = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found, total = None, texts.count()
    length = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-length // INDEX_TOKENS)
    for n in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == n).orderBy("lang", "item_id", "text")
        index = ItemIndex([(r[0], r[1]) for r in part.collect() if tokens(r[1])])
        if index.ids:
            kind = texts.schema["doc_id"].dataType.simpleString()
            numbered = written(texts.mapInArrow(_number(index), f"doc_id {kind}, words binary"))
            counts = numbered.mapInArrow(_count(index), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()
            seen = np.zeros(len(index.vocabulary))
            for term, n in counts:
                seen[term] = n
            index.weigh(seen, total)
            hits = numbered.mapInArrow(_scan(index), f"doc_id {kind}, item_id bigint, share double")
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return documents.sparkSession.createDataFrame([], f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, item_id bigint, share double")
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
