"""Sentence occurrences with vectors: a pluggable token embedder and the pooling of token vectors to characters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphdrift.functions.text import overlap_length


Tokens = list[tuple[int, int, np.ndarray]]


class Embedder(Protocol):
    """Token spans and vectors (start, end, vector) of each sentence of a batch."""

    def __call__(self, sentences: list[str]) -> list[Tokens]: ...


class HashEmbedder:
    """A stand-in without a model: one token for each two characters, its vector drawn from a hash of the token and its neighbours."""

    def __init__(self, size: int = 16, width: int = 2) -> None:
        self.size, self.width = size, width

    def __call__(self, sentences: list[str]) -> list[Tokens]:
        return [self.tokens(s) for s in sentences]

    def tokens(self, sentence: str) -> Tokens:
        out = []
        for at in range(0, len(sentence), self.width):
            end = min(len(sentence), at + self.width)
            seed = hashlib.sha256(sentence[max(0, at - 2) : end + 2].encode()).digest()[:8]
            out.append((at, end, np.random.default_rng(int.from_bytes(seed, "big")).standard_normal(self.size)))
        return out


def token_vectors(sentences: DataFrame, ident: str, text: str, factory: Callable[[], Embedder], together: int = 256) -> DataFrame:
    """(id, token_start, token_end, vector) of every token; only distinct rows that hold a target should come here.

    ``factory`` makes the embedder once in each task, so a model is loaded there and never sent; it gets ``together``
    sentences at a time. Null and empty sentences have no tokens.
    """
    rows = sentences.select(F.col(ident).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = factory()
        for batch in batches:
            held = [(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t]
            for first in range(0, len(held), together):
                part = held[first : first + together]
                found = [(i, a, b, v.tolist()) for (i, _), tokens in zip(part, embedder([t for _, t in part])) for a, b, v in tokens]
                columns = list(zip(*found)) or [(), (), (), ()]
                kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "token_start", "token_end", "vector"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, token_start int, token_end int, vector array<float>")


def pooled(characters: DataFrame, tokens: DataFrame) -> DataFrame:
    """Vector of each character span (id, char_pos): mean of its overlapping tokens' vectors, weighted by overlap share.

    A character no token covers is left out. The join is by sentence, then by overlap within it; the few tokens that
    cover a character are gathered and averaged in place.
    """
    spans = characters.select("id", "char_pos").distinct()
    both = tokens.join(spans, "id").withColumn("overlap", overlap_length("token_start", "token_end", "char_pos", F.col("char_pos") + 1)).where("overlap > 0")
    weight = F.col("overlap") / F.greatest(F.lit(1), F.col("token_end") - F.col("token_start"))
    held = both.groupBy("id", "char_pos").agg(F.collect_list(F.struct(weight.alias("w"), "vector")).alias("tokens"))
    whole = F.greatest(F.aggregate("tokens", F.lit(0.0), lambda s, t: s + t["w"]), F.lit(1e-9))
    place = lambda i: F.aggregate("tokens", F.lit(0.0), lambda s, t: s + t["w"] * t["vector"][i]) / F.col("whole")
    size = F.size(F.col("tokens")[0]["vector"])
    return held.withColumn("whole", whole).select("id", "char_pos", F.transform(F.sequence(F.lit(0), size - 1), place).alias("vector"))
