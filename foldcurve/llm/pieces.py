"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes one symbol per character; an agenda holds the adjacent pairs whose
concatenation is a piece, best score first and leftmost first among equals; the best
pair is merged until none is left. The agendas of many parts are worked off side by side, as
the rows of a matrix of pair ranks; a long part has a heap of its own. Symbols that are no
piece fall back to their bytes. No piece of a vocabulary handled here has a space mark after another character, so
merges never cross the start of a run of marks: the text is cut there, and each cut
part is encoded once per worker while it stays in a bounded cache. `Encoder` refuses
vocabularies for which that does not hold.

Every Arrow batch is checked against the sentencepiece library: its ids for the whole
texts must equal ours, or the job fails; the ids are then decoded by it. Whole texts are
encoded; memory is that of one Arrow batch and the cache. Nothing is shuffled.

Null and empty texts give no ids and decode to the empty text. Repeated rows give
repeated rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

#: Most cut parts that a worker keeps, and the longest that it keeps.
CACHE_PARTS = 600_000
CACHE_CHARS = 48
#: Longer parts have a heap; others share a matrix, so many at a time.
MATRIX_CHARS, MATRIX_ROWS = 48, 8192
#: Characters of whole texts whose parts are looked up together.
TEXTS_CHARS = 1 << 22
NO_PAIR, ABSENT = np.iinfo(np.int32).max, np.iinfo(np.int32).min


def cut_parts(text: str) -> list[str]:
    """The parts of a text, each without its first mark."""
    marked = text.replace(" ", MARK)
    if marked.startswith(MARK) or MARK + MARK in marked:
        return [p[1:] for p in PARTS.findall(MARK + marked)]
    return marked.split(MARK)


class Pairs:
    """Numbered symbols (pieces and characters), and for each pair of them that makes a piece its rank and its symbol.

    Ranks follow the scores, best first; equal scores have equal ranks.
    """

    def __init__(self, ranks: dict[str, tuple[float, int]]):
        self.symbols = list(ranks)
        self.number = {s: i for i, s in enumerate(self.symbols)}
        scores = {s: i for i, s in enumerate(sorted({r[0] for r in ranks.values()}))}
        found = []
        for piece, (score, _) in ranks.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if (cut == 1 or left in ranks) and (len(right) == 1 or right in ranks):
                    found.append((self.add(left), self.add(right), scores[score], self.number[piece]))
        left, right, rank, made = np.array(found, np.int64).reshape(-1, 4).T
        order = np.argsort((left << 32) | right)
        self.keys, self.rank, self.made = ((left << 32) | right)[order], rank[order].astype(np.int32), made[order]

    def add(self, symbol: str) -> int:
        found = self.number.get(symbol)
        if found is None:
            found = self.number[symbol] = len(self.symbols)
            self.symbols.append(symbol)
        return found

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_PAIR: none) and symbol of each pair; a negative symbol stands for none."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NO_PAIR), np.where(hit, self.made[at], -1)

    def merge(self, parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of parts whose agenda is empty, and a row of symbols for each, ABSENT where none is. Characters in no pair are -1 - code point.

        A symbol stays at the place of its first character; each knows the places of those before and after it, so a
        merge touches a few places of a row.
        """
        n, lengths = len(parts), np.array([len(p) for p in parts])
        width = int(lengths.max(initial=1))
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        different, back = np.unique(codes, return_inverse=True)
        numbers = np.array([self.number.get(chr(c), -1 - int(c)) for c in different], np.int32)
        symbols = np.full((n, width), ABSENT, np.int32)
        symbols[np.arange(width) < lengths[:, None]] = numbers[back]
        # The pair of each symbol and the next; the last place has none.
        ranks, made = np.full((n, width), NO_PAIR, np.int32), np.full((n, width), -1, np.int32)
        at = np.flatnonzero((symbols[:, 1:] != ABSENT).reshape(-1))
        row, place = at // max(width - 1, 1), at % max(width - 1, 1)
        if len(different) ** 2 <= len(at):
            # Few characters: their pairs are looked up once.
            every = np.repeat(numbers, len(numbers)), np.tile(numbers, len(numbers))
            first = np.delete(np.arange(len(back)), np.cumsum(lengths) - 1)
            pair = back[first] * len(numbers) + back[first + 1]
            ranks[row, place], made[row, place] = (x[pair] for x in self.lookup(*every))
        else:
            ranks[row, place], made[row, place] = self.lookup(symbols[row, place], symbols[row, place + 1])
        after, before = (np.broadcast_to(np.arange(width, dtype=np.int32) + d, (n, width)).copy() for d in (1, -1))
        rows, own = np.arange(n), np.arange(n)
        done = np.zeros(n, bool)
        while len(own):
            best = ranks[own].argmin(axis=1) if len(own) < len(ranks) else ranks.argmin(axis=1)
            going = ranks[own, best] < NO_PAIR
            done[own[~going]] = True
            own, best = own[going], best[going]
            if 4 * len(own) <= 3 * len(rows):
                # Finished rows leave when they are many.
                yield rows[done], symbols[done]
                kept = ~done
                rows, symbols, ranks, made, after, before = (x[kept] for x in (rows, symbols, ranks, made, after, before))
                own, done = np.arange(len(rows)), np.zeros(len(rows), bool)
            gone, length = after[own, best], lengths[rows[own]]
            further, earlier = after[own, gone], before[own, best]
            symbols[own, best] = made[own, best]
            symbols[own, gone], ranks[own, gone] = ABSENT, NO_PAIR
            ranks[own, best], after[own, best] = NO_PAIR, further
            right, left = np.flatnonzero(further < length), np.flatnonzero(earlier >= 0)
            before[own[right], further[right]] = best[right]
            row = np.concatenate([own[right], own[left]])
            first = np.concatenate([best[right], earlier[left]])
            second = np.concatenate([further[right], best[left]])
            ranks[row, first], made[row, first] = self.lookup(symbols[row, first], symbols[row, second])
        if len(rows):
            yield rows, symbols


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes and decodes with the model file at `path`."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(size)]
        self.pieces = pieces
        #: Piece to (-score, id): the agenda takes the least first.
        self.ranks = {p: (-self.library.get_score(i), i) for i, p in enumerate(pieces) if not special[i]}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if self.library.is_byte(i)}
        bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.raw = [bytes((bytes_of[i],)) if i in bytes_of else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in self.ranks):
            raise ValueError("the vocabulary has pieces that go on over a space")
        self.pairs = Pairs(self.ranks)
        # The id of each symbol that has one id, else -1: by number, and from the end the 128 characters of one byte, by
        # -1 - code point. The place before these stands for all other characters.
        single = [*map(self.ids_of, self.pairs.symbols), (), *(self.ids_of(chr(c)) for c in range(127, -1, -1))]
        self.one_id = np.array([x[0] if len(x) == 1 else -1 for x in single], np.int32)
        self.digits = [str(i) for i in range(size)]
        # Packed ids of parts, by the part without its first mark, and those too long to stay.
        self.cache: dict[str, bytes] = {}
        self.long: list[str] = []
        self.own_ids: dict[int, bytes] = {}

    def ids_of(self, symbol: str) -> tuple[int, ...]:
        rank = self.ranks.get(symbol)
        return (rank[1],) if rank is not None else tuple(self.byte_ids[b] for b in symbol.encode())

    def merge(self, part: str) -> list[str]:
        """The symbols of `part` when the agenda is empty."""
        ranks = self.ranks
        symbols: list[str | None] = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            rank = ranks.get(part[i : i + 2])
            if rank is not None:
                agenda.append((rank[0], i, part[i : i + 2]))
        heapq.heapify(agenda)
        while agenda:
            _, i, text = heapq.heappop(agenda)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            # Entries stay on the agenda when a neighbour has changed; such an entry is void.
            if j >= n or len(text) != len(left) + len(symbols[j]) or left + symbols[j] != text:
                continue
            symbols[i], symbols[j] = text, None
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                rank = ranks.get(text + symbols[j])
                if rank is not None:
                    heapq.heappush(agenda, (rank[0], i, text + symbols[j]))
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] + text)
                if rank is not None:
                    heapq.heappush(agenda, (rank[0], h, symbols[h] + text))
        return [s for s in symbols if s is not None]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are gathered, marks become spaces, the first space is the one encoding put there."""
        return self.decoded(ids)[1:] if ids and self.pieces[ids[0]].startswith(MARK) else self.decoded(ids)

    def decoded(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")

    def ids_at(self, symbol: int) -> bytes:
        """Packed ids of a numbered symbol, or of the character -1 - symbol."""
        found = self.own_ids.get(symbol)
        if found is None:
            found = self.own_ids[symbol] = self.packed([self.pairs.symbols[symbol] if symbol >= 0 else chr(-1 - symbol)])
        return found

    def packed(self, symbols: Iterable[str]) -> bytes:
        return np.array([i for s in symbols for i in self.ids_of(s)], np.int32).tobytes()

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Packed ids of each part."""
        return dict(zip(parts, self.ids_each(parts)))

    def ids_each(self, parts: list[str]) -> list[bytes]:
        """Packed ids of the parts, in their order."""
        out = [b""] * len(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(lengths, kind="stable")
        short = order[: np.searchsorted(lengths[order], MATRIX_CHARS, side="right")]
        for at in range(0, len(short), MATRIX_ROWS):
            some = short[at : at + MATRIX_ROWS]
            for rows, symbols in self.pairs.merge([parts[i] for i in some.tolist()]):
                there = symbols != ABSENT
                # Numbered symbols, then those of one byte without a number; any other is -1.
                ids = self.one_id[np.where(there, np.maximum(symbols, -129), 0)]
                plain = ((ids >= 0) | ~there).all(axis=1)
                data, ends = ids[plain][there[plain]].tobytes(), 4 * np.cumsum(there[plain].sum(axis=1))
                start = 0
                for place, end in zip(some[rows[plain]].tolist(), ends.tolist()):
                    out[place] = data[start:end]
                    start = end
                for i in np.flatnonzero(~plain):
                    out[some[rows[i]]] = b"".join(map(self.ids_at, symbols[i][there[i]].tolist()))
        for place in order[len(short) :].tolist():
            out[place] = self.packed(self.merge(parts[place]))
        return out

    def found(self, keys: set[str]) -> dict[str, bytes]:
        """Packed ids of the parts MARK + key, at least of `keys`; new ones are learned together and, where short, kept."""
        for key in self.long:
            self.cache.pop(key, None)
        new = keys.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_PARTS:
            self.cache = {key: self.cache[key] for key in keys - new}
        parts = [MARK + key for key in new]
        self.cache.update(zip(new, self.learn(parts).values()))
        self.long = [key for key in new if len(key) >= CACHE_CHARS]
        return self.cache

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [cut_parts(t) if t else [] for t in texts]
        known = self.found(set().union(*cut))
        return [np.frombuffer(b"".join(map(known.__getitem__, keys)), np.int32) for keys in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def listed(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.digits.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def grouped(column: pa.Array) -> Iterator[list[str]]:
    """Texts in lists of bounded size, a longer text alone."""
    texts, size = [], 0
    for text in column:
        text = text.as_py() or ""
        if texts and size + len(text) > TEXTS_CHARS:
            yield texts
            texts, size = [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield texts


def encode_documents(docs: DataFrame, path: str | None = None, check: bool = True, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids where `with_ids`.

    `path` names the model file on every machine; by default the installed public one.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path or model_path())
        for batch in batches:
            counts, hashes, back, lists = [], [], [], []
            for texts in grouped(batch.column(1)):
                for text, ids in zip(texts, own.encode_all(texts)):
                    if check and not np.array_equal(own.library.encode_as_numpy(text), ids):
                        raise ValueError(f"the library encodes a text of {len(text)} characters otherwise: {text[:80]!r}")
                    ids = ids.tolist()
                    decoded = own.library.decode(ids)
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(own.listed(ids).encode()).hexdigest())
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        lists.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path or model_path())
        for batch in batches:
            texts = [own.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) as doc_id", "ids").mapInArrow(run, "doc_id long, text string")
