"""Clusters, dialogue repair and token files against brute force, and their edges."""

import collections
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldcurve.llm import clusters, dialogue, queries, tokenfiles
from foldcurve.llm.common import shared_folder

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, v int, cluster int, away int"
TURNS = "conv_id long, turn long, role string, text string, copies int, seen int, cost int"
DOCS = "doc_id long, text string, task int, start int, n_tokens int"


# --- clusters


def lloyd(vectors: list, k: int, rounds: int) -> tuple[list, list]:
    """(id, v) in, (id, cluster, distance) and centroids out, in plain whole numbers."""
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in vectors)[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, v in vectors:
            held[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(held[j]) for x in zip(*held[j])] if held[j] else c for j, c in enumerate(centroids)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in vectors], centroids


def test_clusters_follow_plain_rounds_and_skip_far_centroids(spark):
    rng = np.random.default_rng(5)
    spots = rng.normal(size=(8, 64)) * 3
    rows = [(i, [float(x) for x in spots[i % 8] + rng.normal(size=64) * 0.1], 0, 1, 2, 3) for i in range(400)]
    model = clusters.fit(clusters.scaled(spark.createDataFrame(rows, VECTORS)))
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows]
    want, centroids = lloyd(whole, 8, 10)
    got = clusters.digest(model).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    total, per = sum(d for *_, d in want), collections.Counter()
    for _, c, d in want:
        per[c] += d
    for r in got:
        assert (r.inertia, r.cluster_inertia) == (total, per[r.cluster])
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
    assert model.measured[-1] < 400 * 8 / 2


def test_clusters_edges(spark):
    good = [float(x) for x in range(64)]
    bad = [None, [1.0] * 63, [1.0] * 63 + [None], [1.0] * 63 + [math.nan], [1.0] * 63 + [math.inf], []]
    rows = [(1, good, 0, 0, 0, 0), (1, good, 0, 0, 0, 0), (None, [-x - 0.0003 for x in good], 0, 0, 0, 0), (2, good, None, None, None, None)]
    table = spark.createDataFrame(rows + [(9, v, 0, 0, 0, 0) for v in bad], VECTORS)
    got = sorted((r.vec_id or 0, r.cluster, r.distance) for r in clusters.digest(clusters.fit(clusters.scaled(table))).collect())
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows]
    assert got == sorted((i or 0, c, d) for i, c, d in lloyd(whole, 8, 10)[0])
    none = clusters.digest(clusters.fit(clusters.scaled(table.where("vec_id = 9"))))
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="too large"):
        clusters.scaled(spark.createDataFrame([(1, [1e30] * 64, 0, 0, 0, 0)], VECTORS)).collect()


def test_bounds_lose_no_tie():
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, size=(300, 4))
    centroids, anchors = rng.integers(-3, 4, size=(9, 4)), x[:5]
    away = np.stack([np.sqrt(((x - a) ** 2).sum(axis=1)) for a in anchors], axis=1)
    owner, best, measured = clusters.nearest(x, away, centroids, clusters._to_pivots(centroids, anchors))
    d = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (owner == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and measured < d.size


# --- dialogue


def cheapest(shape: str) -> tuple[int, str]:
    """Cost and least initials by trying every arc, row by row."""

    def inserted(best):
        for _ in range(3):
            for q, (c, s) in list(best.items()):
                after = dialogue.NEXT[q]
                best[after] = min(best.get(after, (99999, "")), (c + 5, s + "I"))
        return best

    best = {dialogue.EMPTY: (0, "")}
    for symbol in shape:
        following = {}
        for q, (c, s) in inserted(best).items():
            for cost, ahead, behind, letter in dialogue.arcs_of(symbol, q):
                if ahead:
                    following[behind] = min(following.get(behind, (99999, "")), (c + cost, s + letter))
        best = following
    best = inserted(best)
    return min(best[q] for q in (dialogue.EMPTY, dialogue.ASSISTANT) if q in best)


def test_auction_finds_the_least_of_the_cheapest():
    random.seed(1)
    for _ in range(400):
        shape = "".join(random.choice("-sssuuuuaaaaxSUAX") for _ in range(random.randint(0, 45)))
        edits, state, cost = dialogue.traced(shape, dialogue.EMPTY, dialogue.FINAL)
        assert (cost, edits + dialogue.ENDS[state]) == cheapest(shape), shape


def test_prices_never_exceed_distances():
    random.seed(2)
    shape = "".join(random.choice("-suaxUA") for _ in range(40))
    prices = dialogue.settled(shape, dialogue.FINAL)
    for row in range(40):
        for q in range(4):
            for cost, ahead, behind, _ in dialogue.ARCS[shape[row]][q]:
                assert prices[4 * row + q] <= cost + prices[4 * (row + ahead) + behind]


def plain_report(rows: list) -> dict:
    """(conv_id, turn, role, text) after damage in, the report out."""
    out, space = {}, " \t\n\x0b\x0c\r"
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in own:
            body = text.strip(space)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] if r[2][:1] in ("s", "u", "a") else "x" for r in own]
        shape = "".join("-" if f in ("blank", "duplicate") else i.upper() if f else i for i, f in zip(initials, faults))
        cost, audit = cheapest(shape)
        texts, row, state = [], 0, 0
        for letter in audit:
            if letter in "IR":
                state = dialogue.NEXT[state]
                texts.append(("user:" if state == 2 else "assistant:") + ("" if letter == "I" else own[row][3]))
            elif letter == "K":
                state = {"s": 1, "u": 2, "a": 3}[own[row][2][0]]
                texts.append(own[row][2] + ":" + own[row][3])
            row += letter != "I"
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def reported(df) -> dict:
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def conversation(n_rows: int, seed: int) -> list:
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", ""], ["Hi.", "Why?", "so", "", " \n", "Good! ", "word" * 50 + "."]
    return [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(n_rows // 2)]), rng.choice(roles), rng.choice(texts)) for _ in range(n_rows)]


@pytest.mark.parametrize("chunk_rows", [3, 7, 1024])
def test_a_hot_conversation_in_many_chunks(spark, chunk_rows):
    rows = conversation(240, chunk_rows)
    solution = dialogue.solved(spark.createDataFrame([(*r, 0, 0, 0) for r in rows], TURNS), chunk_rows)
    assert reported(dialogue.report(solution)) == plain_report(rows)
    kept = dialogue.repaired(solution).where("edit <> 'D'").orderBy("conv_id", "task", "number", "place").collect()
    by = collections.defaultdict(list)
    for r in kept:
        by[r.conv_id].append(r.role + ":" + r.text)
    want = plain_report(rows)
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in by.items()} == {c: w[-1] for c, w in want.items() if c in by}


def test_dialogue_edges(spark):
    rows = [(1, 0, "user", "A."), (1, 1, None, None), (2, None, "user", "B"), (2, None, "user", "B"), (3, 5, "system", "x" * 300_000 + "."), (None, 1, "assistant", "C?")]
    table = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], TURNS)
    plain = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    assert reported(dialogue.report(dialogue.solved(table))) == plain_report(plain)
    assert dialogue.digest(table.where("false")).count() == 0
    # crc32 decides the damage; a conversation that loses all rows is still reported.
    gone = [(c, t) for c in range(400) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][0]
    out = reported(dialogue.digest(spark.createDataFrame([(*gone, "user", "A.", 0, 0, 0)], TURNS)))
    assert out == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_dialogue_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three? four.") for c in range(60) for t in range(4)] + [(None, None, None, None)]
    got = sorted((r.conv_id if r.conv_id is not None else -1, r.turn or 0, r.role, r.text) for r in dialogue.damaged(spark.createDataFrame([(*r, 0, 0, 0) for r in rows], TURNS)).collect())
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        want += [(-1 if c is None else c, t or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want) and {0, 1, 2, 3, 4} <= {zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, *_ in rows[:-1]}


# --- token files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenfiles.default_tokenizer())


def ids_of(library, text) -> list[int]:
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def test_cached_cuts_give_the_library_ids(library):
    rng = random.Random(3)
    own = tokenfiles.Encoder(tokenfiles.default_tokenizer())
    pieces = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "don't", "'s", "42", "é", "日本", "!", "...", " ", "　", "\x1c", "\x85", "<|endoftext|>", "🙂", "​", "A"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        for _ in range(2):  # the second time from the cache
            assert own.encode(text) == struct.pack(f"<{len(ids_of(library, text)) - 1}I", *ids_of(library, text)[:-1]), repr(text)


def test_token_files_round_trip_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, want = 0, []
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = ids_of(library, r.text)
        want.append((r.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    # Files and frames so small that documents span frames and tasks have many files.
    out = tokenfiles.round_trip(docs, tokenfiles.default_tokenizer(), frame_ids=500, file_ids=3000)
    assert sorted(map(tuple, out.collect())) == want
    assert sorted(map(tuple, queries.QUERIES["op13_token_files"](spark, SF).collect())) == want


def test_token_files_edges(spark, library):
    rows = [(5, "long text " * 30_000, 1, 2, 3), (None, "x", 1, 2, 3), (5, "b", 1, 2, 3), (5, "a", 1, 2, 3), (5, "a", 1, 2, 3), (7, None, 1, 2, 3), (8, "", 1, 2, 3)]
    out = tokenfiles.round_trip(spark.createDataFrame(rows, DOCS), tokenfiles.default_tokenizer(), frame_ids=1000).collect()
    at, want = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(library, text)
        want.append((doc_id or -1, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted((r[0] or -1, *r[1:]) for r in out) == sorted(want)
    assert tokenfiles.round_trip(spark.createDataFrame([], DOCS), tokenfiles.default_tokenizer()).count() == 0


def test_a_reader_decompresses_only_what_it_needs():
    file = tokenfiles.FileWriter(frame_ids=100)
    docs = [np.arange(n, dtype="<u4").tobytes() for n in (30, 40, 50, 250, 10, 1)]
    for i, ids in enumerate(docs):
        file.add(i, ids)
    data = file.finish(4, 2) + tokenfiles.FILE_END.encode()
    # Any decoder reads the frames in a row and skips the index and the tables.
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(docs)
    for i, frames in ((0, 1), (2, 1), (3, 3), (4, 1), (5, 1)):
        reader = tokenfiles.FileReader(data)
        assert (reader.task, reader.number) == (4, 2)
        assert reader.document(i) == docs[i] and reader.decompressed == frames
    for at in (3, len(data) - 9):
        broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        with pytest.raises((ValueError, zstandard.ZstdError)):
            tokenfiles.FileReader(broken).document(0)


def test_lookup_and_damaged_files(spark, library, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = shared_folder(spark)
    tokenfiles.write(docs, path, tokenfiles.default_tokenizer(), frame_ids=2000)
    texts = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin(3, 150)).collect()}
    assert {r.doc_id: list(r.ids) for r in tokenfiles.lookup(spark, path, [3, 150]).collect()} == {i: ids_of(library, t) for i, t in texts.items()}
    (tmp_path / "part").write_bytes(b"not a token file")
    with pytest.raises(PythonException, match="does not have its end"):
        tokenfiles.read(spark, str(tmp_path)).collect()
