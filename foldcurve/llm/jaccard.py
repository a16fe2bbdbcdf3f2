"""Exact Jaccard join of documents by word shingles, as a blocked sparse matrix product.

Rows of the matrix are documents, columns are hashed shingles. Columns are dealt to
blocks; each block multiplies its part with its transpose, list by list, and the overlap
counts of a pair are added up over blocks. Bounds by size keep the product small:

* two sets can only link if the smaller has three quarters of the larger one's size;
* in one order of all shingles, sets that link share their first ones: a set of n enters
  the product with the first n - ceil(0.75 n) + r of its shingles, and a pair needs r
  common ones there (r: 3, or less for sets that small). Frequent shingles come last in
  the order, so that common passages stay out of the product.

Shingles are counted over all documents, in the same blocks; the most frequent ones,
their number bounded, are sent to all tasks. They only set the order, which may be any,
so results never depend on them. Equal sets are one row of the matrix. Pairs go
in three rounds; documents found linked are one component in the next. The first compares
each document with one other, the smallest id of the lists they share most of. The second
compares it with the few of other components that are nearest by their sketches, among
those of a like size in its lists. The third makes all pairs of *different* components that
pass the bounds, so a group of near copies is never expanded into its pairs, and no link
between components is lost. Every reported link comes from the exact sizes of intersection
and union.

Lists of few documents are worked off where they are: each makes all its pairs, whose number is
bounded by that of its entries. Only longer lists, few of a corpus, go on to the sketches of their
documents, so a document's sketch travels to the blocks of its long lists alone. The overlap of a
pair is that in its short lists and that in its long ones.

A sketch is the parity of a set's shingles by some bits of their hashes. The bits in which
two sketches differ are at most the shingles in one set alone, and sets link only if those
are at most a seventh of both sizes: a pair beyond that leaves the product for sure. Without
this, near copies that miss the threshold by little would all become pairs.

Shingles are 64-bit hashes of words; texts are lower-cased in A-Z alone. Null texts and
texts without words have the empty set and link with nothing. Rows that share a doc_id
are one node: what links one links all. A null doc_id has no component but itself: its
component_id is null. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from foldcurve.llm.common import partitions, written
from foldcurve.llm.components import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
COMMON = 3
#: Most frequent shingles that the order knows, twelve bytes each, and the least count of one. Both change the
#: speed alone: any order gives the same links.
FREQUENT_KEPT, FREQUENT_LEAST = 1_000_000, 4
#: Bits of a hash that counting tells apart inside a block.
COUNTED_BITS = 40
BLOCKS_PER_PARTITION = 2
#: Shingles of a document that look for one to be compared with first.
PROBES = 6
#: Sketches have the power of two of bits from twice the set's size on, within these.
SKETCH_LEAST, SKETCH_MOST = 128, 4096
#: Lists of at most so many documents make all their pairs; longer ones go by sketches.
SHORT_LIST = 16
#: The second round looks at so many documents of the next sizes in a list, and keeps so many of the nearest. The
#: third round makes up for what these leave out, so they change the speed alone.
WINDOW, NEAREST = 128, 4
#: Pairs of places in lists, and pairs of sketches, that a task holds at once.
PAIRS_HELD, SKETCHES_HELD = 1 << 20, 1 << 16
#: Bits that tell ids apart before their texts are moved: 8 MB for all tasks at most.
ID_BITS = 1 << 26
#: Documents compared with one leader in one group.
LEADER_GROUP = 512

FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1B54A32D192ED03, 0xA0761D6478BD642F], np.uint64)


def mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    if not text:
        return np.zeros(0, np.uint64)
    words = WORDS.findall(text.encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([xxh3_64_intdigest(w) for w in words], np.uint64)
    n = min(SHINGLE, len(hashes))
    with np.errstate(over="ignore"):
        z = np.full(len(hashes) - n + 1, n, np.uint64)
        for i in range(n):
            # Each place is mixed by itself, so that the order of words counts.
            z = mixed(z * FACTORS[i] + hashes[i : len(hashes) - n + 1 + i])
    return np.unique(z)


def least_overlap(n: np.ndarray | int):
    """ceil of three quarters of n: any partner shares so many."""
    return -(-NUMERATOR * n // DENOMINATOR)


class Frequent:
    """Ranks of the most frequent shingles: hashes are told apart by their block and COUNTED_BITS of them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, blocks: int):
        order = np.argsort(keys)
        self.keys, self.blocks = keys[order], np.uint64(blocks)
        # Rarer shingles rank first; equal counts rank by key.
        by_count = np.lexsort((self.keys, counts[order]))
        self.ranks = np.empty(len(keys), np.int32)
        self.ranks[by_count] = np.arange(len(keys), dtype=np.int32)
        self.marked = np.zeros(1 << 22, bool)
        self.marked[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def rank(self, found: np.ndarray) -> np.ndarray:
        """The rank of each hash, -1 for those not known as frequent."""
        out = np.full(len(found), -1, np.int32)
        at = np.flatnonzero(self.marked[(found & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(at):
            keys = counted_key(found[at], self.blocks)
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            same = self.keys[place] == keys
            out[at[same]] = self.ranks[place[same]]
        return out


def block_of(h: np.ndarray, blocks) -> np.ndarray:
    return (h >> np.uint64(COUNTED_BITS)) % np.uint64(blocks)


def counted_key(h: np.ndarray, blocks) -> np.ndarray:
    return (block_of(h, blocks) << np.uint64(COUNTED_BITS)) | (h & np.uint64((1 << COUNTED_BITS) - 1))


def prefix(found: np.ndarray, frequent: Frequent | None) -> np.ndarray:
    """The first shingles of a set in the common order: infrequent by hash, then frequent by rank."""
    n = len(found)
    need = least_overlap(n)
    length = n - need + min(COMMON, need)
    if frequent is not None and len(frequent.keys):
        found = found[np.argsort(frequent.rank(found), kind="stable")]
    return found[:length]


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")


def sketch(found: np.ndarray) -> bytes:
    """The parity of the set's hashes by their lowest bits: its two halves xored are the sketch of half the bits."""
    bits = min(max(1 << (2 * len(found) - 1).bit_length(), SKETCH_LEAST), SKETCH_MOST)
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


COUNTED = "block int, doc_id long, n long, key binary, sketch binary, h binary, c binary"


def sets(docs: DataFrame, blocks: int) -> DataFrame:
    """A row per document (doc_id, n, its sketch, and a key that equal sets share), and rows of the most frequent
    shingles of a block, packed with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in COUNTED.split(", ")]
        for batch in batches:
            n, keys, sketches, distinct = [], [], [], {}
            for text in batch.column(1):
                found = shingles(text.as_py())
                n.append(len(found))
                key = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
                keys.append(key)
                sketches.append(sketch(found) if len(found) else None)
                if key is not None and key not in distinct:
                    distinct[key] = counted_key(found, blocks)
            blank = pa.nulls(len(n), pa.binary())
            # Document rows go along to any block.
            yield pa.RecordBatch.from_arrays([pa.array([i % blocks for i in range(len(n))], kinds[0]), batch.column(0), pa.array(n, kinds[1]), pa.array(keys, kinds[3]), pa.array(sketches, kinds[3]), blank, blank], names)
            if not distinct:
                continue
            # Sorted in place: the hashes of a batch are the most that a task holds.
            every = np.concatenate(list(distinct.values()))
            distinct.clear()
            every.sort()
            starts, ends = runs(every)
            key, count = every[starts], np.minimum(ends - starts, 65535).astype("<u2")
            del every
            block = (key >> np.uint64(COUNTED_BITS)).astype(np.int32)
            low = key.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, : COUNTED_BITS // 8]
            starts, ends = runs(block)
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for x in (low, count)]
            none = pa.nulls(len(starts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(block[starts]), none, none, *[pa.nulls(len(starts), pa.binary())] * 2, *packed], names)

    def count_block(table: pa.Table) -> pa.Table:
        rows = table.filter(pc.is_null(table["h"]))
        packed = table.filter(pc.is_valid(table["h"]))
        size = COUNTED_BITS // 8
        low = np.frombuffer(b"".join(packed["h"].to_pylist()), np.uint8).reshape(-1, size)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :size] = low
        key, back = np.unique(wide.view("<u8").reshape(-1), return_inverse=True)
        count = np.bincount(back, np.frombuffer(b"".join(packed["c"].to_pylist()), "<u2"), len(key)).astype(np.int64)
        often = np.flatnonzero(count >= FREQUENT_LEAST)
        most = -(-FREQUENT_KEPT // blocks)
        if len(often) > most:
            often = often[np.lexsort((key[often], -count[often]))[:most]]
        full = key[often] | np.uint64((table["block"][0].as_py() if len(table) else 0) << COUNTED_BITS)
        names = ["doc_id", "n", "key", "sketch", "h", "c"]
        kept = pa.Table.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([full.tobytes()], pa.binary()), pa.array([count[often].tobytes()], pa.binary())], names
        )
        return pa.concat_tables([rows.select(names), kept])

    return ids_and_texts(docs).mapInArrow(run, COUNTED).groupBy("block").applyInArrow(count_block, COUNTED.replace("block int, ", ""))


def prefixes(docs: DataFrame, frequent) -> DataFrame:
    """A row per set: a document that has it, its size, and its first shingles in the common order, packed by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Of equal sets the representative, which has the smallest id, is needed: a batch keeps its smallest.
            least: dict[bytes, tuple[int, int, bytes]] = {}
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_id = doc_id.as_py()
                found = shingles(text.as_py())
                if doc_id is None or not len(found):
                    continue
                key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if key not in least:
                    least[key] = doc_id, len(found), np.sort(prefix(found, frequent.value)).tobytes()
                elif doc_id < least[key][0]:
                    least[key] = doc_id, *least[key][1:]
            doc, n, h = zip(*least.values()) if least else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.binary())], ["doc", "n", "h"])

    return ids_and_texts(docs).mapInArrow(run, "doc long, n long, h binary")


#: Columns of a block's packed entries, besides their hashes. The component is packed less the document.
ENTRY = {"doc": np.int64, "n": np.int32, "component": np.int64}


def postings(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows of the matrix (doc, n, component, packed h) cut into column blocks: a row per batch and block with packed entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("h").to_pylist()
            h = np.frombuffer(b"".join(packed), np.uint64)
            row = np.repeat(np.arange(len(packed)), [len(x) // 8 for x in packed])
            block = block_of(h, blocks).astype(np.int32)
            order = np.argsort(block, kind="stable")
            h, row, block = h[order], row[order], block[order]
            starts, ends = runs(block)
            values = {c: batch.column(c).to_numpy() for c in ENTRY}
            # Most documents are a component by themselves: the distance to it packs well.
            values["component"] = values["component"] - values["doc"]
            entries = [h, *(values[c].astype(kind)[row] for c, kind in ENTRY.items())]
            columns = [pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for x in entries]
            yield pa.RecordBatch.from_arrays([pa.array(block[starts]), *columns], ["block", "h", *ENTRY])

    return rows.select("h", *ENTRY).mapInArrow(run, "block int, h binary, doc binary, n binary, component binary")


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
    return starts, np.append(starts[1:], len(values))


STARS = "block int, h binary, doc long, n long, leader long, common long"


def multiply_stars(table: pa.Table) -> pa.Table:
    """Of one column block: its lists, and overlap counts with each list's smallest id.

    The lists come as a row per document, with the packed hashes of those where another has a size that allows a link.
    """
    names = ["block", "h", "doc", "n", "leader", "common"]
    h = np.frombuffer(b"".join(table["h"].to_pylist()), np.uint64)
    doc = np.frombuffer(b"".join(table["doc"].to_pylist()), np.int64)
    n = np.frombuffer(b"".join(table["n"].to_pylist()), np.int32)
    order = np.lexsort((doc, h))
    h, doc, n = h[order], doc[order], n[order]
    starts, ends = runs(h)
    size = ends - starts
    keep = np.repeat(size > 1, size)
    h, doc, n = h[keep], doc[keep], n[keep]
    starts, ends = runs(h)
    lead = np.repeat(starts, ends - starts)
    small, large = np.minimum(n, n[lead]), np.maximum(n, n[lead])
    star = (doc != doc[lead]) & (DENOMINATOR * small.astype(np.int64) >= NUMERATOR * large.astype(np.int64))
    pairs = np.stack([doc[star], doc[lead][star]], 1)
    pairs, common = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0, int))
    # By size, a partner of any size that fits means that the next one on some side fits.
    order = np.lexsort((n, h))
    h, doc, n = h[order], doc[order], n[order]
    fits = (h[1:] == h[:-1]) & (DENOMINATOR * n[:-1].astype(np.int64) >= NUMERATOR * n[1:].astype(np.int64))
    keep = np.append(fits, False) | np.append(False, fits) if len(h) else np.zeros(0, bool)
    h, doc, n = h[keep], doc[keep], n[keep]
    order = np.lexsort((n, doc))
    h, doc, n = h[order], doc[order], n[order]
    starts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (n[1:] != n[:-1]))) if len(h) else np.zeros(0, int)
    ends = np.append(starts[1:], len(h))
    packed = pa.array([h[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
    block = np.full(len(starts), table["block"][0].as_py() if table.num_rows else 0, np.int32)
    none = pa.nulls(len(starts), pa.int64())
    lists = pa.Table.from_arrays([pa.array(block), packed, pa.array(doc[starts]), pa.array(n[starts].astype(np.int64)), none, none], names)
    m = len(pairs)
    none = pa.nulls(m, pa.int64())
    stars = pa.Table.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(pairs[:, 0]), none, pa.array(pairs[:, 1]), pa.array(common.astype(np.int64))], names)
    return pa.concat_tables([lists, stars])


#: The columns of multiply_stars, and those of pairs.
PRODUCT = "block int, h binary, doc long, n long, leader long, common long, other long, need long"


def multiply_short(table: pa.Table) -> pa.Table:
    """Of one column block: overlap counts of all pairs of different components in short lists (doc, other, need,
    common), and the long lists of several components, a row per document. Without components, each document is one."""
    names = [c.split()[0] for c in PRODUCT.split(", ")]
    h, doc, n = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("h", np.uint64), ("doc", np.int64), ("n", np.int32)))
    component = doc + np.frombuffer(b"".join(table["component"].to_pylist()), np.int64) if "component" in table.column_names else doc
    order = np.lexsort((n, h))
    h, doc, n, component = h[order], doc[order], n[order].astype(np.int64), component[order]
    # By size, a partner of any size that fits means that the next one on some side fits.
    fits = (h[1:] == h[:-1]) & (DENOMINATOR * n[:-1] >= NUMERATOR * n[1:])
    keep = np.append(fits, False) | np.append(False, fits) if len(h) else np.zeros(0, bool)
    h, doc, n, component = h[keep], doc[keep], n[keep], component[keep]
    starts, ends = runs(h)
    if len(starts):
        several = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
        keep = np.repeat(several, ends - starts)
        h, doc, n, component = h[keep], doc[keep], n[keep], component[keep]
        starts, ends = runs(h)
    # The documents of the block by id and size, and the place of each entry among them.
    order = np.lexsort((n, doc))
    first = np.append(True, (doc[order][1:] != doc[order][:-1]) | (n[order][1:] != n[order][:-1]))[: len(order)]
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(first) - 1
    doc, n, component = (x[order][first] for x in (doc, n, component))
    few = np.repeat(ends - starts <= SHORT_LIST, ends - starts)
    short_h, short = h[few], row[few]
    codes, wide = [np.zeros(0, np.int64)], len(doc)
    for step in range(1, min(SHORT_LIST, len(short))):
        small, large = short[:-step], short[step:]
        pair = (short_h[:-step] == short_h[step:]) & (DENOMINATOR * n[small] >= NUMERATOR * n[large]) & (component[small] != component[large])
        codes.append(small[pair] * wide + large[pair])
    code, common = np.unique(np.concatenate(codes), return_counts=True)
    small, large = code // max(wide, 1), code % max(wide, 1)
    need = np.minimum(COMMON, least_overlap(n[small]))
    a, b, m = np.minimum(doc[small], doc[large]), np.maximum(doc[small], doc[large]), len(code)
    none = pa.nulls(m, pa.int64())
    pairs = [pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(a), none, none, pa.array(common.astype(np.int64)), pa.array(b), pa.array(need)]
    h, row = h[~few], row[~few]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    starts, ends = runs(row)
    packed = pa.array([h[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())
    block = np.full(len(starts), table["block"][0].as_py() if table.num_rows else 0, np.int32)
    none = pa.nulls(len(starts), pa.int64())
    lists = [pa.array(block), packed, pa.array(doc[row[starts]]), pa.array(n[row[starts]]), none, none, none, none]
    return pa.concat_tables([pa.Table.from_arrays(lists, names), pa.Table.from_arrays(pairs, names)])


class Sketches:
    """The sketches of a block's documents by level (their bits as a power of two)."""

    def __init__(self, packed: list[bytes | None]):
        # Documents without a sketch, whose id stands for several sets, are at no level.
        self.level = np.array([-1 if x is None else (8 * len(x)).bit_length() - 1 for x in packed], np.int64)
        self.place: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}
        for level in np.unique(self.level[self.level >= 0]):
            own, above = np.flatnonzero(self.level == level), np.flatnonzero(self.level == level + 1)
            width = 1 << (level - 6)
            whole = np.frombuffer(b"".join(packed[i] for i in own), np.uint64).reshape(-1, width)
            twice = np.frombuffer(b"".join(packed[i] for i in above), np.uint64).reshape(-1, 2 * width)
            self.rows[level] = np.concatenate([whole, twice[:, :width] ^ twice[:, width:]])
            self.place[level] = np.zeros(len(packed), np.int64)
            self.place[level][np.concatenate([own, above])] = np.arange(len(own) + len(above))

    def apart(self, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        """At least so many shingles are in one set of each pair alone. The larger set may be a level higher."""
        out = np.zeros(len(small), np.int64)
        level = np.where(self.level[large] < 0, -1, self.level[small])
        for one in np.unique(level[level >= 0]):
            at = np.flatnonzero(level == one)
            rows, place = self.rows[one], self.place[one]
            for i in range(0, len(at), SKETCHES_HELD):
                part = at[i : i + SKETCHES_HELD]
                out[part] = np.bitwise_count(rows[place[small[part]]] ^ rows[place[large[part]]]).sum(1, dtype=np.int64)
        return out


def pairs_apart(table: pa.Table, window: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Of one column block: pairs of different components that sizes and sketches allow to link, each part of the lists
    by itself. (document rows, small and large; how many lists of the part hold the pair; shingles apart at least)"""
    n, comp = table["n"].to_numpy(), table["component"].to_numpy()
    packed = table["h"].to_pylist()
    sketches = Sketches(table["sketch"].to_pylist())
    row = np.repeat(np.arange(len(n)), [len(x) // 8 for x in packed])
    h = np.frombuffer(b"".join(packed), np.uint64)
    del packed
    # Lists ordered by size: partners of a document stand in a window behind it.
    order = np.lexsort((row, n[row], h))
    h, row = h[order], row[order]
    starts, ends = runs(h)
    if not len(starts):
        return
    several = np.minimum.reduceat(comp[row], starts) != np.maximum.reduceat(comp[row], starts)
    row = row[np.repeat(several, ends - starts)]
    length = (ends - starts)[several]
    if not len(row):
        return
    part = np.repeat(np.arange(len(length)), length) << 40
    size = n[row]
    stop = np.searchsorted(part + size, part + DENOMINATOR * size // NUMERATOR, side="right")
    here = np.arange(len(row))
    if window is not None:
        stop = np.minimum(stop, here + 1 + window)
    total = np.append(0, np.cumsum(stop - here - 1))
    first = 0
    while first < len(row):
        last = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS_HELD, side="right")) - 1)
        partners = np.diff(total[first : last + 1])
        small = np.repeat(here[first:last], partners)
        large = small + 1 + np.arange(len(small)) - np.repeat(total[first:last] - total[first], partners)
        small, large = row[small], row[large]
        differ = comp[small] != comp[large]
        code, held = np.unique(small[differ] * len(n) + large[differ], return_counts=True)
        small, large = code // len(n), code % len(n)
        delta = sketches.apart(small, large)
        may = (DENOMINATOR - NUMERATOR) * (n[small] + n[large]) >= (DENOMINATOR + NUMERATOR) * delta
        yield small[may], large[may], held[may], delta[may]
        first = last


def multiply_near(table: pa.Table) -> pa.Table:
    """Of one column block: for each document the nearest few of other components, by sketches, in a window of sizes."""
    doc = table["doc"].to_numpy()
    best = np.zeros((0, 3), np.int64)
    for small, large, _, delta in pairs_apart(table, WINDOW):
        both = np.concatenate([best, np.stack([small, delta, large], 1), np.stack([large, delta, small], 1)])
        best = np.unique(both, axis=0)
        starts, ends = runs(best[:, 0])
        best = best[np.arange(len(best)) - np.repeat(starts, ends - starts) < NEAREST]
    return pa.Table.from_arrays([pa.array(doc[best[:, 0]]), pa.array(doc[best[:, 2]]), pa.array(best[:, 1])], ["doc", "other", "delta"])


def multiply_apart(table: pa.Table) -> pa.Table:
    """Of one column block: overlap counts of all pairs of different components that sizes and sketches allow to link."""
    doc, n = table["doc"].to_numpy(), table["n"].to_numpy()
    found = [np.stack([doc[small], doc[large], np.minimum(COMMON, least_overlap(n[small])), held], 1) for small, large, held, _ in pairs_apart(table, None)]
    pairs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    ends = np.sort(pairs[:, :2], axis=1)
    keyed, back = np.unique(np.concatenate([ends, pairs[:, 2:3]], 1), axis=0, return_inverse=True)
    common = np.bincount(back.reshape(-1), pairs[:, 3], len(keyed)).astype(np.int64)
    return pa.Table.from_arrays([pa.array(keyed[:, i].astype(np.int64)) for i in range(3)] + [pa.array(common)], ["a", "b", "need", "common"])


def allowed(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that the sizes and sketches of both (n, sketch; other_n, other_sketch) allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate([batch.column(c).to_numpy() for c in ("n", "other_n")])
            sketches = Sketches(batch.column("sketch").to_pylist() + batch.column("other_sketch").to_pylist())
            first = np.arange(m)
            small, large = np.where(n[:m] <= n[m:], first, first + m), np.where(n[:m] <= n[m:], first + m, first)
            may = (DENOMINATOR - NUMERATOR) * (n[small] + n[large]) >= (DENOMINATOR + NUMERATOR) * sketches.apart(small, large)
            yield batch.select(["a", "b"]).filter(pa.array(may))

    return pairs.select("a", "b", "n", "sketch", "other_n", "other_sketch").mapInArrow(run, "a long, b long")


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is in `ids` (id), and few others: those that share a bit of a table of bounded size.

    Texts that no pair asks for stay where they are, however many ids there are to join.
    """
    place = "bitmap_bit_position(pmod(xxhash64({0}), {1}L))"
    bucket = "bitmap_bucket_number(pmod(xxhash64({0}), {1}L))"
    asked = ids.selectExpr(f"{bucket.format('id', ID_BITS)} as bucket", f"{place.format('id', ID_BITS)} as place").repartition("bucket")
    bits = asked.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    own = docs.selectExpr("*", f"{bucket.format('doc_id', ID_BITS)} as bucket", f"{place.format('doc_id', ID_BITS)} as place")
    byte = "cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int)"
    return own.join(F.broadcast(bits), "bucket").where(f"shiftright({byte}, cast(place % 8 as int)) % 2 = 1").select(*docs.columns)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets link by their exact sizes. Texts are moved only for documents in a pair.

    The documents b of one a come in groups of bounded size, each with the text of a.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEADER_GROUP).cast("int").alias("groups"))
    counts = written(counts)
    dealt = pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    leaders = counts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    wanted = written(dealt.select(F.col("b").alias("id"), "a", "part").unionByName(leaders))
    texts = among(ids_and_texts(docs), wanted).join(wanted, F.col("doc_id") == F.col("id")).select("a", "part", "doc_id", "text")

    def run(table: pa.Table) -> pa.Table:
        a = table["a"][0].as_py()
        own, out = [], []
        ids = table["doc_id"].to_pylist()
        for doc_id, text in zip(ids, table["text"]):
            if doc_id == a:
                own.append(shingles(text.as_py()))
        for doc_id, text in zip(ids, table["text"]):
            if doc_id != a:
                found = shingles(text.as_py())
                for mine in own:
                    both = len(np.intersect1d(mine, found, assume_unique=True))
                    if DENOMINATOR * both >= NUMERATOR * (len(mine) + len(found) - both) > 0:
                        out.append(doc_id)
                        break
        return pa.Table.from_arrays([pa.array([a] * len(out), pa.int64()), pa.array(out, pa.int64())], ["a", "b"])

    return texts.groupBy("a", "part").applyInArrow(run, "a long, b long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    spark = docs.sparkSession
    blocks = BLOCKS_PER_PARTITION * partitions(spark)
    both = written(sets(docs, blocks))
    rows = both.where("n is not null").select("doc_id", "n", "key", "sketch")
    # One row per block: FREQUENT_KEPT shingles at most in all.
    often = both.where("h is not null").select("h", "c").collect()
    keys = np.frombuffer(b"".join(bytes(r.h) for r in often), np.uint64)
    counts = np.frombuffer(b"".join(bytes(r.c) for r in often), np.int64)
    frequent = spark.sparkContext.broadcast(Frequent(keys, counts, blocks))

    # Equal sets: links to the smallest id.
    full = rows.where("doc_id is not null and key is not null")
    same = full.groupBy("key").agg(F.min("doc_id").alias("a"))
    same = written(full.join(written(same), "key").select("a", F.col("doc_id").alias("b"), "n").distinct())
    # Only representatives take part in pairs.
    chosen = written(same.where("a = b").select(F.col("a").alias("doc")))
    rows_of = written(prefixes(docs, frequent))
    # A few shingles of each prefix, the first by hash, find the document that it is first compared with.
    probes = rows_of.select("doc", "n", F.col("doc").alias("component"), F.substring("h", 1, 8 * PROBES).alias("h")).join(chosen, "doc")
    stars = postings(probes, blocks).groupBy("block").applyInArrow(multiply_stars, STARS).where("leader is not null")
    stars = stars.groupBy("doc", "leader").agg(F.sum("common").alias("common"))
    best = stars.groupBy("doc").agg(F.max(F.struct("common", (-F.col("leader")).alias("l"))).alias("best"))
    first = written(verified(docs, written(best.select((-F.col("best")["l"]).alias("a"), F.col("doc").alias("b")))))
    known = written(components(same.select("a", "b").unionByName(first)))

    # An id that stands for several sets has no sketch.
    several = full.groupBy("doc_id").agg(F.min("key").alias("k"), F.max("key").alias("l"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    drawn = several.join(chosen, F.col("doc_id") == F.col("doc")).select("doc", "n", F.expr("if(k = l, sketch, null)").alias("sketch"))
    drawn = written(drawn)
    # The matrix knows the components, so that lists and pairs within one of them are never made.
    own = chosen.join(known, F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("component", "doc").alias("component"))
    product = written(postings(rows_of.join(written(own), "doc"), blocks).groupBy("block").applyInArrow(multiply_short, PRODUCT))
    pairs = product.where("other is not null").groupBy(F.col("doc").alias("a"), F.col("other").alias("b"))
    pairs = written(pairs.agg(F.sum("common").alias("common"), F.min("need").alias("need")))
    lists = product.where("other is null").select("block", "h", "doc", "n")
    # Partners share as many lists as a link needs, so a document in fewer has none.
    held = lists.groupBy("doc").agg(F.sum(F.length("h") / 8).alias("held"), F.least(F.lit(COMMON), F.ceil(F.min("n") * NUMERATOR / DENOMINATOR)).alias("need"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc"), F.col("common").alias("held")).groupBy("doc").agg(F.sum("held").alias("more"))
    enough = held.join(ends, "doc", "left").where("held + coalesce(more, 0) >= need").select("doc")
    lists = lists.join(written(drawn.drop("n").join(enough, "doc")), "doc")

    def labelled(known: DataFrame):
        rows = lists.join(known, F.col("doc") == F.col("node"), "left")
        return rows.select("block", "h", "doc", "n", F.coalesce("component", "doc").alias("component"), "sketch").groupBy("block")

    nearest = labelled(known).applyInArrow(multiply_near, "doc long, other long, delta long").groupBy("doc")
    # At most NEAREST partners from each block.
    nearest = nearest.agg(F.slice(F.array_sort(F.collect_set(F.struct("delta", "other"))), 1, NEAREST).alias("others"))
    nearest = nearest.select("doc", F.explode("others.other").alias("other"))
    middle = written(verified(docs, written(nearest.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct())))
    known = written(components(known.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(middle)))

    apart = labelled(known).applyInArrow(multiply_apart, "a long, b long, need long, common long")
    label = known.select("node", "component")
    short = pairs.join(label.select(F.col("node").alias("a"), F.col("component").alias("of_a")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("component").alias("of_b")), "b", "left")
    short = short.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "need", "common")
    near = apart.unionByName(short).groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("need").alias("need")).where("common >= need").select("a", "b")
    near = written(near).join(drawn.withColumnRenamed("doc", "a"), "a").join(drawn.select(F.col("doc").alias("b"), F.col("n").alias("other_n"), F.col("sketch").alias("other_sketch")), "b")
    second = written(verified(docs, written(allowed(near))))
    final = components(known.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(second))
    out = rows.join(final, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
