"""Removal of byte strings that also start in an earlier document, by a logarithmic family of suffix arrays.

A byte goes if it is covered by a string of 50 bytes that also starts in a document with
a smaller doc_id. Suffixes are sampled, and no match is lost by that: every window of 50
bytes has an anchor, the 16 bytes in it whose hash is least (the first of equals), so
equal windows have equal anchors. Neighbouring windows with one anchor form a strip of
84 bytes at most, and strips are dealt to shards by the hash of their anchor: equal
windows meet in one shard.

Before the shuffle, each block of documents settles what repeats inside it: of equal strips the
smallest document's is sent, the others are removed at once, so a passage that many
documents share costs a shard one strip per block. A shard drops strips whose anchor no
other document has, settles equal strips, and indexes the rest: strips come in batches by
doc_id; each batch gets the sorted array of its window suffixes, which is merge-scanned
against all existing levels for 50-byte matches and becomes a level itself; levels of
about equal size are merged, so their number grows with the logarithm of the batches.

What is shuffled is the strips, packed and compressed per block and shard, then the
removed ranges, then the texts once, to meet their ranges. Shards follow the session's
shuffle partitions, so a shard's size stays the same when those are sized to the data.

Null texts are empty. A null doc_id is neither smaller nor greater than any: such rows
come back whole. Rows that share a doc_id remove nothing from each other. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.llm.common import partitions, written

MATCH = 50
ANCHOR = 16
SHARDS_PER_PARTITION = 4
#: Bytes of documents that are cut into strips at once.
BLOCK_BYTES = 4 << 20
#: Batches that a shard's strips come in.
BATCHES = 8


def mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place of `data` that has so many."""
    b = data.astype(np.uint64)
    two = b[:-1] | (b[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    return pair_hashes(eight[:-8], eight[8:])


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of ANCHOR bytes given as two little-endian words."""
    with np.errstate(over="ignore"):
        return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xD1B54A32D192ED03))


def anchor_hashes(contents: list[bytes], marks: list[int]) -> np.ndarray:
    """Hashes of the anchors of strips."""
    pairs = np.frombuffer(b"".join([c[m : m + ANCHOR] for c, m in zip(contents, marks)]), "<u8").reshape(-1, 2)
    return pair_hashes(pairs[:, 0], pairs[:, 1])


def anchors(hashes: np.ndarray) -> np.ndarray:
    """For each window start, how far behind it the first least hash of the window is."""
    width = MATCH - ANCHOR + 1
    least, away, reach = hashes, np.zeros(len(hashes), np.uint8), 1
    while reach < width:
        step = min(reach, width - reach)
        right, right_away = least[step:], away[step:]
        least, away = least[: len(right)], away[: len(right)]
        better = right < least
        least = np.where(better, right, least)
        away = np.where(better, right_away + np.uint8(step), away)
        reach += step
    return away


def strips(texts: list[bytes]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of the strips of the texts: which text, start, stop and anchor."""
    lengths = np.array([len(t) for t in texts])
    if lengths.sum() < MATCH:
        return [], [], [], []
    data = np.frombuffer(b"".join(texts), np.uint8)
    away = anchors(gram_hashes(data))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    n = len(data) - MATCH + 1
    inside = owner[:n] == owner[MATCH - 1 :]
    anchor = np.arange(n, dtype=np.int32) + away[:n]
    first = inside & np.concatenate([[True], ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (owner[1:n] != owner[: n - 1])])
    last = inside & np.concatenate([first[1:] | ~inside[1:], [True]])
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    own = owner[a]
    base = begins[own]
    return own.tolist(), (a - base).tolist(), (b - base + MATCH).tolist(), (anchor[a] - base).tolist()


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about BLOCK_BYTES in all, one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def ranges_bytes(ranges: list[tuple[int, int]]) -> bytes:
    return np.array(merged(ranges), np.uint32).tobytes()


def block_rows(texts: list[bytes], ids: np.ndarray, hashes: np.ndarray, shards: int) -> list[tuple]:
    """What one block of documents, in order of their ids, sends to the shards."""
    id_list = ids.tolist()
    seen: dict[bytes, int] = {}
    settled: dict[int, list[tuple[int, int]]] = {}
    rows, starts, marks, contents = [], [], [], []
    for i, a, b, p in zip(*strips(texts)):
        content = texts[i][a:b]
        owner = seen.setdefault(content, id_list[i])
        if owner != id_list[i]:
            settled.setdefault(i, []).append((a, b))
            continue
        rows.append(i)
        starts.append(a)
        marks.append(p - a)
        contents.append(content)
    del seen
    out: list[tuple] = [(id_list[i] % shards, id_list[i], int(hashes[i]), ranges_bytes(r)) for i, r in settled.items()]
    if not rows:
        return out
    shard = (anchor_hashes(contents, marks) >> np.uint64(20)) % np.uint64(shards)
    by = np.argsort(shard, kind="stable")
    shard, row = shard[by], np.array(rows)[by]
    start, mark = np.array(starts, np.uint32)[by], np.array(marks, np.uint8)[by]
    ordered = [contents[k] for k in by.tolist()]
    length = np.array([len(c) for c in ordered], np.uint8)
    cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]).tolist()
    press = zstandard.ZstdCompressor(level=3)
    for x, y in zip(cuts, cuts[1:]):
        part = row[x:y]
        columns = (np.array([y - x], np.uint32), ids[part], hashes[part], start[x:y], mark[x:y], length[x:y])
        out.append((int(shard[x]), None, None, press.compress(b"".join([c.tobytes() for c in columns] + ordered[x:y]))))
    return out


SENT = "shard int, doc_id long, hash long, payload binary"


def sent(docs: DataFrame, shards: int) -> DataFrame:
    """Rows for shards (doc_id null, packed strips) and ranges that a block has settled itself (doc_id set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(ids, kind="stable")
            texts = [(batch.column(2)[int(i)].as_py() or "").encode() for i in order]
            ids, hashes = ids[order], hashes[order]
            for a, b in blocks(texts):
                out = block_rows(texts[a:b], ids[a:b], hashes[a:b], shards)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["shard", "doc_id", "hash", "payload"])

    known = docs.where("doc_id is not null")
    return known.select("doc_id", "hash", "text").mapInArrow(run, SENT)


class Levels:
    """Sorted arrays of distinct 50-byte windows, each with the smallest document that has it."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Smallest earlier document for each of the sorted windows: a merge of both sorted arrays per level."""
        best = np.full(len(windows), np.iinfo(np.int64).max)
        for level, owners in self.levels:
            at = np.searchsorted(level, windows)
            at[at == len(level)] = 0
            same = level[at] == windows
            best[same] = np.minimum(best[same], owners[at[same]])
        return best

    def add(self, windows: np.ndarray, docs: np.ndarray) -> None:
        """Sorted distinct windows become a level; levels that are not twice as large are merged into it."""
        new = windows, docs
        while self.levels and len(self.levels[-1][0]) < 2 * len(new[0]):
            new = self.union(self.levels.pop(), new)
        self.levels.append(new)

    @staticmethod
    def union(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        windows, docs = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        # A stable sort of two sorted runs is a merge; the older level comes first among equals.
        order = np.argsort(windows, kind="stable")
        windows, docs = windows[order], docs[order]
        first = np.append(True, windows[1:] != windows[:-1])
        return windows[first], np.minimum.reduceat(docs, np.flatnonzero(first))


def search(entries: list[tuple[int, int, int, bytes]], found: dict[tuple[int, int], list[tuple[int, int]]]) -> None:
    """Adds to `found` the matches of strips (doc_id, hash, start, content), which come in order of doc_id."""
    levels = Levels()
    bounds = [len(entries) * i // BATCHES for i in range(BATCHES + 1)]
    for i in range(1, BATCHES):  # a document is not cut
        while 0 < bounds[i] < len(entries) and entries[bounds[i]][0] == entries[bounds[i] - 1][0]:
            bounds[i] += 1
    for x, y in zip(bounds, bounds[1:]):
        part = entries[x:y]
        if not part:
            continue
        text = np.frombuffer(b"".join([e[3] for e in part]), np.uint8)
        counts = np.array([len(e[3]) - MATCH + 1 for e in part])
        ends = np.cumsum([len(e[3]) for e in part])
        begins = ends - np.array([len(e[3]) for e in part])
        strip = np.repeat(np.arange(len(part)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        view = np.lib.stride_tricks.as_strided(text, (len(text) - MATCH + 1, MATCH), (1, 1))
        windows = np.ascontiguousarray(view[begins[strip] + offset]).view(f"V{MATCH}").reshape(-1)
        windows = sortable(windows)
        docs = np.array([e[0] for e in part])[strip]
        # The suffix array of the batch; of equal windows the smallest document comes first.
        order = np.argsort(windows, kind="stable")
        windows, docs, strip, offset = windows[order], docs[order], strip[order], offset[order]
        first = np.append(True, windows[1:] != windows[:-1])
        heads = np.flatnonzero(first)
        here = np.repeat(docs[heads], np.diff(np.append(heads, len(docs))))
        before = np.repeat(levels.scan(windows[heads], docs[heads]), np.diff(np.append(heads, len(docs))))
        for k in np.flatnonzero(np.minimum(here, before) < docs).tolist():
            e = part[strip[k]]
            a = e[2] + int(offset[k])
            found.setdefault((e[0], e[1]), []).append((a, a + MATCH))
        levels.add(windows[heads], docs[heads])


def sortable(windows: np.ndarray) -> np.ndarray:
    """Windows as strings that numpy orders: a last byte of 1 keeps zero bytes at the end."""
    out = np.ones((len(windows), MATCH + 1), np.uint8)
    out[:, :MATCH] = windows.view(np.uint8).reshape(len(windows), MATCH)
    return out.view(f"S{MATCH + 1}").reshape(-1)


def shard_ranges(table: pa.Table) -> pa.Table:
    """Removed ranges of the documents of one shard."""
    spread = zstandard.ZstdDecompressor()
    passed = [(r["doc_id"], r["hash"], r["payload"]) for r in table.select(["doc_id", "hash", "payload"]).to_pylist() if r["doc_id"] is not None]
    ids, hashes, starts, marks, contents = [], [], [], [], []
    for payload, doc_id in zip(table["payload"], table["doc_id"]):
        if doc_id.as_py() is not None:
            continue
        body = spread.decompress(payload.as_py())
        n, at = int(np.frombuffer(body, np.uint32, 1)[0]), 4
        columns = []
        for kind in (np.int64, np.int64, np.uint32, np.uint8, np.uint8):
            columns.append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
        ids.append(columns[0])
        hashes.append(columns[1])
        starts.append(columns[2])
        marks.append(columns[3])
        stops = at + np.cumsum(columns[4].astype(np.int64))
        contents.extend([body[a:b] for a, b in zip((stops - columns[4]).tolist(), stops.tolist())])
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    if contents:
        doc, text_hash, start = np.concatenate(ids), np.concatenate(hashes), np.concatenate(starts)
        mark = np.concatenate(marks).tolist()
        h = anchor_hashes(contents, mark)
        keep = shared(h, doc)
        keep = keep[np.argsort(doc[keep], kind="stable")]
        seen: dict[bytes, int] = {}
        rest = []
        for k, d in zip(keep.tolist(), doc[keep].tolist()):
            owner = seen.setdefault(contents[k], d)
            if owner < d:
                found.setdefault((d, int(text_hash[k])), []).append((int(start[k]), int(start[k]) + len(contents[k])))
            else:
                rest.append(k)
        rest = np.array(rest, int)
        rest = rest[np.sort(shared(h[rest], doc[rest]))] if len(rest) else rest
        search([(int(doc[k]), int(text_hash[k]), int(start[k]), contents[k]) for k in rest.tolist()], found)
    passed.extend((d, t, ranges_bytes(r)) for (d, t), r in found.items())
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    return pa.Table.from_arrays([pa.array([p[i] for p in passed], kinds[i]) for i in range(3)], ["doc_id", "hash", "ranges"])


def shared(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places whose hash stands in more than one document."""
    if not len(h):
        return np.zeros(0, int)
    order = np.lexsort((doc, h))
    s, d = h[order], doc[order]
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    ends = np.append(starts[1:], len(s))
    return order[np.repeat(d[starts] != d[ends - 1], ends - starts)]


def removed_ranges(docs: DataFrame) -> DataFrame:
    """For `hashed` documents, doc_id, hash and ranges: arrays of packed (start, stop) pairs in bytes."""
    shards = SHARDS_PER_PARTITION * partitions(docs.sparkSession)
    found = sent(docs, shards).groupBy("shard").applyInArrow(shard_ranges, "doc_id long, hash long, ranges binary")
    return written(found).groupBy("doc_id", "hash").agg(F.collect_list("ranges").alias("ranges"))


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, hash, text: the hash tells rows apart that share an id, and is 0 for all others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again = written(rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("again")))
    own = F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return rows.join(again, "doc_id", "left").select("doc_id", own.alias("hash"), "text")


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes where `with_text`; one row per document."""
    docs = hashed(docs)
    ranges = removed_ranges(docs)
    both = docs.join(ranges, ["doc_id", "hash"], "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                pairs = np.frombuffer(b"".join(ranges.as_py() or ()), np.uint32).reshape(-1, 2).tolist()
                spans, kept, at = merged([tuple(p) for p in pairs]), [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                row = (len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest())
                out.append(row + (left,) if with_text else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 1 + len(columns)])

    return both.mapInArrow(run, schema)
