"""Texts from archives of JSON members: scan, polymorphic payload, keyed upsert."""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphdrift.functions.text import member_urn, strip
from glyphdrift.operators.latest import upsert_last_wins

MEMBERS = "archive string, place bigint, member string, payload string"


BLOCK_BYTES = 4_000_000  # payloads of one batch


class Chain(io.RawIOBase):
    """The bytes of some parts one after the other, without putting them together."""

    def __init__(self, parts: Iterator[bytes]) -> None:
        self.parts, self.left = parts, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: bytearray) -> int:
        while not len(self.left):
            part = next(self.parts, None)
            if part is None:
                return 0
            self.left = memoryview(part)
        n = min(len(buffer), len(self.left))
        buffer[:n], self.left = self.left[:n], self.left[n:]
        return n


def read_members(path: str, parts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """The JSON members of one archive in batches of a few MB; damaged members are passed over as far as the stream goes on."""

    def block() -> pa.RecordBatch:
        columns = [pa.array([path] * len(names), pa.string()), pa.array(range(place - len(names), place), pa.int64()), pa.array(names, pa.string()), pa.array(payloads, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["archive", "place", "member", "payload"])

    names, payloads, size, place = [], [], 0, 0
    try:
        with tarfile.open(fileobj=io.BufferedReader(Chain(parts), 1 << 20), mode="r|*", ignore_zeros=True) as archive:
            for member in archive:
                if member.isfile() and member.name.endswith(".json"):
                    content = archive.extractfile(member).read()
                    names.append(member.name)
                    payloads.append(content.decode("utf-8", "ignore"))
                    size, place = size + len(content), place + 1
                    if size >= BLOCK_BYTES:
                        yield block()
                        names, payloads, size = [], [], 0
    except (tarfile.TarError, EOFError, OSError, zlib.error):
        pass  # what was read before the damage stays
    yield block()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            yield from read_members(batch.column(0)[n].as_py(), iter([batch.column(1)[n].as_py()]))


def _split_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by folder and name; an archive's parts are read as they come."""
    rows = ((batch.column(0)[n].as_py(), batch.column(2)[n].as_py()) for batch in batches for n in range(batch.num_rows))
    for folder, parts in groupby(rows, key=lambda r: r[0]):
        yield from read_members(folder, (content for _, content in parts))


def members_of(files: DataFrame) -> DataFrame:
    """Members of the tar archives in ``content`` (with their ``path``), plain or compressed."""
    return files.select("path", "content").mapInArrow(_members, MEMBERS)


def scan_archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Members of tar archives, plain or compressed: archive, place in it, member name, payload.

    An archive is one task's work, as compressed tar files can't be split; many archives spread over tasks. Members come
    in batches of a few MB, damaged ones are passed over, other files than ``.json`` too. Paths that match nothing
    give no rows.
    """
    return members_of(spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths))


def scan_split_archive(spark: SparkSession, pattern: str) -> DataFrame:
    """Members of archives that are stored as parts; the parts of a folder in name order are the bytes of one.

    The parts of one gzip stream mean nothing alone, so one task reads them, one after the other; archives of several
    folders spread over tasks.
    """
    parts = spark.read.format("binaryFile").load(pattern).select(F.regexp_replace("path", r"[^/]*$", "").alias("folder"), "path", "content")
    return parts.repartition("folder").sortWithinPartitions("folder", "path").mapInArrow(_split_members, MEMBERS)


def payload_text(payload: Column) -> Column:
    """The text of a payload: an object's ``fulltext``, or of a list each item's first non-empty ``fulltext``, ``text``
    or ``content``, or the item itself if it is a string, joined. Stripped; null for malformed payloads and empty texts.
    """
    document = F.try_parse_json(payload)
    is_list = F.schema_of_variant(document).startswith("ARRAY")
    items = F.try_variant_get(document, "$", "array<variant>")
    pick = lambda v, key: F.nullif(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    of_item = lambda v: F.coalesce(F.when(is_text(v), F.try_variant_get(v, "$", "string")), pick(v, "fulltext"), pick(v, "text"), pick(v, "content"), F.lit(""))
    text = F.when(is_list, F.array_join(F.transform(items, of_item), "")).otherwise(pick(document, "fulltext"))
    return F.nullif(strip(text), F.lit(""))


def archive_texts(members: DataFrame, source_order: int) -> DataFrame:
    """urn, text and load order of an archive's members; members without urn or text are left out."""
    named = members.select(member_urn("member").alias("urn"), payload_text(F.col("payload")).alias("text"), "archive", "place")
    order = F.struct(F.lit(source_order).alias("source"), "archive", "place").alias("load_order")
    return named.where("urn IS NOT NULL AND urn <> '' AND text IS NOT NULL").select("urn", "text", order)


def text_map(*sources: DataFrame) -> DataFrame:
    """One text for each urn: the one loaded last, later sources over earlier ones."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    return upsert_last_wins(rows, "urn", "load_order", "text").withColumnRenamed("key", "urn")
