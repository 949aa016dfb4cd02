"""Lay items of varying length into containers of fixed capacity: best-two-fit in blocks."""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphdrift.session import written

CAPACITY = 2_048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pieces of one block. A block wastes at most about a container, so larger blocks gain nothing.
BLOCK_PIECES = 20_000


def encoder(path: str) -> object:
    """The tokenizer of a rank file; a task loads it once."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for batch in batches:
            sizes = [0 if t is None else len(tokenizer.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["item", "size"])

    return run


def token_sizes(df: DataFrame, ident: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(item, size) in tokens of the whole text; null text has size 0."""
    rows = df.select(F.col(ident).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(_sizes(path), f"item {rows.schema['item'].dataType.simpleString()}, size bigint")


class Stock:
    """Unpacked items by size."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        order = np.argsort(sizes, kind="stable")
        bounds = np.searchsorted(sizes[order], np.arange(capacity + 2))
        self.items = [order[bounds[s] : bounds[s + 1]].tolist() for s in range(capacity + 1)]
        self.left = len(sizes)
        self.refresh()

    def refresh(self) -> None:
        self.present = np.array([s for s, x in enumerate(self.items) if x], np.int64)

    def largest(self, gap: int) -> int:
        """Largest present size of at most ``gap``, 0 if none."""
        at = int(np.searchsorted(self.present, gap, side="right"))
        return int(self.present[at - 1]) if at else 0

    def take(self, size: int) -> int:
        item = self.items[size].pop()
        self.left -= 1
        if not self.items[size]:
            self.present = np.delete(self.present, np.searchsorted(self.present, size))
        return item

    def give(self, size: int, item: int) -> None:
        if not self.items[size]:
            self.present = np.insert(self.present, np.searchsorted(self.present, size), size)
        self.items[size].append(item)
        self.left += 1

    def best_two(self, gap: int) -> tuple[int, int]:
        """Two sizes of greatest sum within ``gap``, (0, 0) if there are none."""
        first = self.present[: np.searchsorted(self.present, gap)]
        if not len(first):
            return 0, 0
        at = np.searchsorted(self.present, np.minimum(first, gap - first), side="right") - 1
        first, second = first[at >= 0], self.present[at[at >= 0]]
        twice = np.array([a != b or len(self.items[a]) > 1 for a, b in zip(first.tolist(), second.tolist())], bool)
        first, second = first[twice], second[twice]
        if not len(first):
            return 0, 0
        best = int((first + second).argmax())
        return int(first[best]), int(second[best])


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of positions in ``sizes`` (1 to capacity each).

    A container is filled with the largest items that fit; then its smallest item is exchanged for the two
    unpacked ones that fill the gap it leaves most tightly, if they fill more than it did.
    """
    stock, out = Stock(np.asarray(sizes), capacity), []
    while stock.left:
        gap, held = capacity, []
        while size := stock.largest(gap):
            held.append((size, stock.take(size)))
            gap -= size
        if gap and len(held) > 1:
            size, item = held[-1]
            a, b = stock.best_two(gap + size)
            if a + b > size:
                held[-1:] = [(a, stock.take(a)), (b, stock.take(b))]
                stock.give(size, item)
        out.append([item for _, item in held])
    return out


PACKED = "container bigint, place int, item {0}, piece int, start bigint, size bigint"


def _pack(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        sizes, block = rows["size"].to_numpy(), int(rows["block"][0].as_py())
        containers = best_two_fit(sizes, capacity)
        at = np.array([i for c in containers for i in c], np.int64)
        number = np.repeat(np.arange(len(containers)), [len(c) for c in containers])
        place = np.concatenate([np.arange(len(c)) for c in containers]).astype(np.int32)
        taken = rows.take(pa.array(at))
        return pa.table({"container": pa.array((np.int64(block) << 32) + number), "place": pa.array(place), **{c: taken[c] for c in ("item", "piece", "start", "size")}})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Where each item goes: container, place in it, item, piece, start (token offset of the piece), size.

    ``items`` has item and size; of a repeated item the largest size counts. An item larger than the capacity is
    cut into pieces, all but the last of them full, and only such an item is cut. Items of size 0, null size or
    null item take no room and are left out. ``items`` is read twice, so its sizes should be materialised. Pieces are spread evenly over blocks by a hash; each block is packed by
    best-two-fit, full pieces fill a container alone. An empty table gives no rows.
    """
    kind = items.schema["item"].dataType.simpleString()
    one = items.where(F.col("item").isNotNull() & (F.col("size") > 0)).groupBy("item").agg(F.max("size").alias("whole"))
    pieces = one.select(
        "item", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1, F.lit(capacity).cast("bigint"))).alias("piece", "start"), "whole"
    ).select("item", "piece", "start", F.least(F.col("whole") - F.col("start"), F.lit(capacity)).cast("bigint").alias("size"))
    count = one.agg(F.sum(F.ceil(F.col("whole") / capacity))).first()[0] or 0
    blocks = max(1, math.ceil(int(count) / BLOCK_PIECES))
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)))
    return blocked.groupBy("block").applyInArrow(_pack(capacity), PACKED.format(kind))


def packed_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """Layout of ``documents.text`` (problem 8)."""
    out = pack(written(token_sizes(documents, "doc_id", "text", path)), capacity)
    return out.select("container", "place", F.col("item").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))
