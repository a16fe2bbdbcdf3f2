"""Token ids in seekable files: independent zstandard frames, a document index and a trailing seek table.

A file holds the ids of whole documents end to end, as little-endian unsigned 32-bit
numbers, in ascending order of doc_id. In order, it consists of

- data frames, each of which decompresses by itself; a frame is closed when it is full,
  at the end of a document unless the document alone is longer than a frame;
- an index: a skippable frame with the file's place (task, number in the task) and,
  for each document, its id and its number of ids, compressed and with a checksum;
- a seek table: a skippable frame as in the public seekable format, with the compressed
  and decompressed size and the checksum (low 32 bits of xxh64 of the data) of each
  frame, then the number of frames, a descriptor byte and the magic number;
- an empty skippable frame, the line end of Spark's text writer, which stores the files
  and so commits each of them once, also when a task is run again.

So any zstandard decoder reads a file from its start, and a reader that wants some
documents finds them in the index and decompresses the frames that hold them and no
others. A frame whose checksum differs raises an error.

Rows are put in order by Spark's range partitioning, so no task holds more than its
range; a task holds one open frame and one open file of bounded size, or one document
where that is longer. Where documents start in the whole is a running total over
files, not a pass through the driver.

Null text is the empty text: its ids are the end id alone. Null ids come first. Rows
that share an id come in the order of their texts, equal rows come each. Extra columns
are not read. Very long texts are encoded whole and span frames. An empty table gives no
file with documents, and reads back as no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcurve.llm.common import partitions, shared_folder, shuffles_dropped, written
from foldcurve.operators.running import running_totals

#: Fixed values of the zstandard formats: magic numbers of skippable frames and of the seek table's foot.
INDEX_MAGIC, TABLE_MAGIC, FOOT_MAGIC = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
#: An empty skippable frame; all its bytes are plain characters, so it can be a line end.
FILE_END = "\x50\x2a\x4d\x18\x00\x00\x00\x00"

END_ID = 2
#: Ids in a frame and in a file.
FRAME_IDS, FILE_IDS = 1 << 16, 1 << 22
LEVEL = 3
#: Encoded pieces kept by a worker, and the longest of them.
CACHE_PIECES, CACHE_CHARS = 1 << 19, 64

#: Letters and white space on which all Unicode versions agree, and texts of them and other plain characters.
LETTERS, WHITE = "A-Za-zÀ-ÖØ-öø-ÿ", r" \t-\r"
PLAIN = re.compile(rf"[\x00-\x1b -~{LETTERS}]*")
#: The public split pattern of byte-level vocabularies, for plain texts.
PIECES = re.compile(rf"'(?:[sdmt]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^{WHITE}{LETTERS}0-9]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_chars() -> dict[int, int]:
    """The character for each byte in such vocabularies: its own where that prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(prints))
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(others)}


BYTE_CHARS = byte_chars()

ROWS = "task int, number int, place long, doc_id long, first long, n_tokens long, ids_crc32 long"


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public vocabulary; another file's path may be given to all functions here."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian bytes, with a cache of pieces.

    A byte-level vocabulary splits a text into pieces by a fixed pattern and merges
    within them only. Where all characters are such that any reading of the pattern
    agrees on them (`PLAIN`), texts are split here and the library's model encodes each
    different piece once. Other texts are cut ahead of each space that a non-space
    follows, which is a split in any case, whatever stands before it; cuts that are not
    plain go to the library whole. So do texts that hold one of the vocabulary's added
    tokens, and all texts of a vocabulary of another kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        kind = json.loads(self.library.to_str())
        split, model = kind["pre_tokenizer"] or {}, kind["model"]
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.pieces = byte_level and kind["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout")
        self.added = [t["content"] for t in kind["added_tokens"]]
        self.known: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        tokens = self.library.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARS))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def learned(self, text: str, encode: Callable[[str], bytes]) -> bytes:
        ids = encode(text)
        if len(text) <= CACHE_CHARS:
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            self.known[text] = ids
        return ids

    def plain(self, text: str) -> bytes:
        known = self.known
        return b"".join([known.get(p) or self.learned(p, self.piece) for p in PIECES.findall(text)])

    @staticmethod
    def cuts(text: str) -> list[str]:
        """The text cut ahead of spaces that are followed by what is no white space in any reading."""
        words = text.split(" ")
        out = words[:1]
        for word in words[1:]:
            if word and (word[0].isalnum() or "!" <= word[0] <= "~"):
                out.append(" " + word)
            else:
                out[-1] += " " + word
        return out

    def encode(self, text: str) -> bytes:
        if not self.pieces or any(t in text for t in self.added):
            return self.packed(text)
        if PLAIN.fullmatch(text):
            return self.plain(text)
        return b"".join([self.plain(c) if PLAIN.fullmatch(c) else self.known.get(c) or self.learned(c, self.packed) for c in self.cuts(text)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class FileWriter:
    """One file in memory, built document by document."""

    def __init__(self, frame_ids: int):
        self.frame_bytes = 4 * frame_ids
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.out, self.frames, self.open, self.held = [], [], [], 0
        self.doc_ids, self.counts, self.size = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held + len(ids) > self.frame_bytes:
            self.close_frame()
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.size += len(ids) // 4
        for at in range(0, len(ids), self.frame_bytes):
            self.open.append(ids[at : at + self.frame_bytes])
            self.held += len(self.open[-1])
            if self.held >= self.frame_bytes:
                self.close_frame()

    def close_frame(self) -> None:
        data = b"".join(self.open)
        packed = self.zstd.compress(data)
        self.out.append(packed)
        self.frames.append((len(packed), len(data), checksum(data)))
        self.open, self.held = [], 0

    def finish(self, task: int, number: int) -> bytes:
        if self.held:
            self.close_frame()
        known = np.array([i is not None for i in self.doc_ids], np.uint8)
        ids = np.array([i or 0 for i in self.doc_ids], "<i8")
        body = self.zstd.compress(known.tobytes() + ids.tobytes() + np.array(self.counts, "<u8").tobytes())
        index = struct.pack("<IIII", task, number, len(ids), checksum(body)) + body
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOT_MAGIC)
        return b"".join([*self.out, struct.pack("<II", INDEX_MAGIC, len(index)), index, struct.pack("<II", TABLE_MAGIC, len(table)), table])


class FileReader:
    """Documents of one file by their place in it; `decompressed` counts the frames that were read."""

    def __init__(self, data: bytes):
        end = FILE_END.encode()
        if not data.endswith(end):
            raise ValueError("a token file does not have its end")
        self.data, foot = data, len(data) - len(end) - 9
        n, descriptor, magic = struct.unpack_from("<IBI", data, foot)
        start = foot - 12 * n - 8
        if magic != FOOT_MAGIC or descriptor != CHECKSUMS or start < 0 or struct.unpack_from("<II", data, start) != (TABLE_MAGIC, 12 * n + 9):
            raise ValueError("a token file does not have its seek table")
        table = np.frombuffer(data, "<u4", 3 * n, start + 8).reshape(n, 3)
        self.sums = table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.first = np.concatenate([[0], np.cumsum(table[:, 1], dtype=np.int64)])
        magic, size = struct.unpack_from("<II", data, int(self.at[-1]))
        self.task, self.number, count, want = struct.unpack_from("<IIII", data, int(self.at[-1]) + 8)
        body = data[int(self.at[-1]) + 24 : int(self.at[-1]) + 8 + size]
        if magic != INDEX_MAGIC or checksum(body) != want:
            raise ValueError("the index of a token file is damaged")
        self.zstd = zstandard.ZstdDecompressor()
        body = self.zstd.decompress(body)
        known, ids = np.frombuffer(body, np.uint8, count), np.frombuffer(body, "<i8", count, count)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(body, "<u8", count, 9 * count).astype(np.int64))])
        if 4 * self.starts[-1] != self.first[-1]:
            raise ValueError("the index of a token file does not add up to its frames")
        self.decompressed, self.last = 0, (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            data = self.zstd.decompress(self.data[self.at[i] : self.at[i + 1]], max_output_size=int(self.first[i + 1] - self.first[i]))
            if checksum(data) != self.sums[i]:
                raise ValueError("a frame of a token file does not have its checksum")
            self.decompressed, self.last = self.decompressed + 1, (i, data)
        return self.last[1]

    def document(self, place: int) -> bytes:
        a, b = 4 * int(self.starts[place]), 4 * int(self.starts[place + 1])
        i = int(np.searchsorted(self.first, a, "right")) - 1
        out = []
        while a < b:
            stop = min(b, int(self.first[i + 1]))
            out.append(self.frame(i)[a - int(self.first[i]) : stop - int(self.first[i])])
            a, i = stop, i + 1
        return b"".join(out)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS) -> None:
    """Files with the ids of all rows under `path`."""
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(cast(text as string), '') as text")
    # Bounds are drawn from the start of the text, so that one id may fill several ranges and no long text is a bound.
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        file = FileWriter(frame_ids)

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file.finish(task, number)], pa.binary())], ["file"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = own.encode(text.as_py()) + end
                if file.size and file.size + len(ids) // 4 > file_ids:
                    yield finished()
                    number, file = number + 1, FileWriter(frame_ids)
                file.add(doc_id, ids)
        if file.size:
            yield finished()

    files = dealt.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    with shuffles_dropped(docs.sparkSession):
        files.write.option("lineSep", FILE_END).option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """task, number and place of each document in the files, doc_id, first (ids of the file before it), n_tokens, ids_crc32."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [field.split()[0] for field in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = FileReader(content.as_py())
                n = len(file.doc_ids)
                crc = [zlib.crc32(file.document(i)) for i in range(n)]
                columns = [[file.task] * n, [file.number] * n, range(n), file.doc_ids, file.starts[:-1], np.diff(file.starts), crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return _files(spark, path).mapInArrow(run, ROWS)


def lookup(spark: SparkSession, path: str, doc_ids: Iterable[int | None]) -> DataFrame:
    """doc_id and ids of the documents asked for; other frames stay compressed."""
    wanted = frozenset(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = FileReader(content.as_py())
                for place, doc_id in enumerate(file.doc_ids):
                    if doc_id in wanted:
                        ids = np.frombuffer(file.document(place), "<u4").astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _files(spark, path).mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes files to the shared folder and lists what they hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = shared_folder(spark)
    write(docs, path, tokenizer, end_id, frame_ids, file_ids)
    held = written(read(spark, path))
    files = held.groupBy("task", "number").agg(F.sum("n_tokens").alias("ids"))
    files = files.withColumn("file", F.expr("shiftleft(cast(task as long), 42) + number"))
    starts = running_totals(files, [], "file", ["ids"]).select(F.col("task").alias("of_task"), F.col("number").alias("of_number"), F.expr("through_ids - ids").alias("before"))
    placed = held.join(starts, (F.col("task") == F.col("of_task")) & (F.col("number") == F.col("of_number")))
    return placed.select("doc_id", F.expr("first + before").alias("start"), "n_tokens", "ids_crc32")
