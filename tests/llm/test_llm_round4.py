"""Short lists of the Jaccard join, and the cut and merge of parts for encoding."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.test_llm_brute_force import component_ids, table
from tests.llm.test_llm_sketches import family

from foldcurve.llm import jaccard, pieces


def column_block(sets):
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n = np.array([len(s) for s in sets], np.int32)[doc]
    packed = {"h": h, "doc": doc.astype(np.int64), "n": n}
    return pa.table({"block": pa.array([3], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in packed.items()}})


def test_short_lists_make_their_pairs_and_long_ones_stay():
    draw = np.random.default_rng(8)
    # Two and three copies share lists of their own; forty share long ones.
    sets = family(draw, 2, 60, 0.2) + family(draw, 3, 80, 0.2) + family(draw, 40, 100, 0.2)
    got = jaccard.multiply_short(column_block(sets)).to_pylist()
    pairs = {(r["doc"], r["other"]): r for r in got if r["other"] is not None}
    lists = [r for r in got if r["other"] is None and r["leader"] is None]
    members = {}
    for i, s in enumerate(sets):
        for h in s.tolist():
            members.setdefault(h, []).append(i)
    short = {h for h, docs in members.items() if 1 < len(docs) <= jaccard.SHORT_LIST}
    long = {h for h, docs in members.items() if len(docs) > jaccard.SHORT_LIST}
    assert short and long
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            common = len(short & set(sets[a].tolist()) & set(sets[b].tolist()))
            assert common == (pairs[a, b]["common"] if (a, b) in pairs else 0)
            assert not common or pairs[a, b]["need"] == jaccard.COMMON
    assert {r["doc"] for r in lists} == set(range(5, 45)) and {r["block"] for r in lists} == {3}
    assert all(set(np.frombuffer(r["h"], np.uint64).tolist()) == long & set(sets[r["doc"]].tolist()) for r in lists)
    assert jaccard.multiply_short(column_block([np.arange(9, dtype=np.uint64)])).num_rows == 0


@pytest.mark.parametrize("most", [1, 3, 16, 1000])
def test_lists_of_any_bound_give_the_same_links(spark, monkeypatch, most):
    """A pair may share some lists that are short and some that are long."""
    monkeypatch.setattr(jaccard, "SHORT_LIST", most)
    draw = random.Random(9)
    rows = []
    for size, copies, edits in ((60, 2, 3), (90, 3, 6), (120, 25, 7), (8, 4, 1), (2, 3, 0)):
        for family_of in range(4):
            base = [f"w{size}.{family_of}.{i}" for i in range(size)]
            for _ in range(copies):
                words = list(base)
                for _ in range(draw.randrange(edits + 1)):
                    words[draw.randrange(size)] = f"x{draw.randrange(10**6)}"
                rows.append((len(rows) * 7 % 9973, " ".join(words)))
    want = {i: c for i, (_, c) in component_ids(rows).items()}
    assert {r.doc_id: r.component_id for r in jaccard.join(table(spark, rows)).collect()} == want


def test_cut_parts_are_those_of_the_pattern():
    draw = random.Random(10)
    for _ in range(2000):
        text = "".join(draw.choice(["a", "b", " ", " ", pieces.MARK, "\n", "é"]) for _ in range(draw.randrange(1, 12)))
        assert [pieces.MARK + key for key in pieces.cut_parts(text)] == pieces.PARTS.findall(pieces.MARK + text.replace(" ", pieces.MARK))


def test_parts_are_learned_once_and_long_ones_go(monkeypatch):
    own, learned = pieces.Encoder(pieces.model_path()), []
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda parts: learned.extend(parts) or learn(parts))
    texts = ["one two  three", "x" * 60 + " two", "naïve 你好 \U0001f600 one", "", "▁▁ a \n b "]
    for bound in (600_000, 2):
        monkeypatch.setattr(pieces, "CACHE_PARTS", bound)
        for some in (texts, texts[::-1], texts[:2], texts):
            for text, ids in zip(some, own.encode_all(some)):
                assert ids.tolist() == own.library.encode(text)
        if bound > 2:
            short = [p for p in learned if len(p) <= pieces.CACHE_CHARS]
            assert len(short) == len(set(short))
    assert all(len(key) < 60 for key in own.cache if key not in own.long)


def test_merges_by_places_are_those_of_the_agenda():
    own, draw = pieces.Encoder(pieces.model_path()), random.Random(11)
    parts = list({pieces.MARK + "".join(draw.choice("abcdeinrstuzé你") for _ in range(draw.randrange(1, 40))) for _ in range(500)})
    found = own.learn(parts)
    assert all(found[p] == own.packed(own.merge(p)) for p in parts)


def test_texts_that_no_pair_asks_for_stay(spark):
    docs = table(spark, [(i * 31 - 5000, f"text {i}") for i in range(2000)]).select("doc_id", "text")
    ids = spark.createDataFrame([(i * 31 - 5000,) for i in range(0, 2000, 40)] * 2, "id long")
    got = [tuple(r) for r in jaccard.among(docs, ids).collect()]
    assert {(i * 31 - 5000, f"text {i}") for i in range(0, 2000, 40)} <= set(got)
    assert len(got) == len(set(got)) < 60
