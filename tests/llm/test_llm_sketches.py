"""Sketch bounds of the Jaccard join and its rounds over near misses, against plain pairs."""

import random

import numpy as np
import pyarrow as pa
from tests.llm.test_llm_brute_force import component_ids, table

from foldcurve.llm import jaccard


def family(draw, n, size, change):
    """Sets that differ from one base in some members, so that many pairs just miss the threshold."""
    base = draw.integers(0, 2**63, size).astype(np.uint64)
    out = []
    for _ in range(n):
        kept = base[draw.random(size) > draw.random() * change]
        out.append(np.unique(np.concatenate([kept, draw.integers(0, 2**63, size - len(kept)).astype(np.uint64)])))
    return out


def links(a, b):
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def block(sets, components, without=()):
    """All lists of the sets as one column block."""
    rows = [i for i, s in enumerate(sets) if len(s)]
    return pa.table({
        "h": pa.array([sets[i].tobytes() for i in rows], pa.binary()),
        "doc": pa.array(rows, pa.int64()),
        "n": pa.array([len(sets[i]) for i in rows], pa.int64()),
        "component": pa.array([components[i] for i in rows], pa.int64()),
        "sketch": pa.array([None if i in without else jaccard.sketch(sets[i]) for i in rows], pa.binary()),
    })


def test_sketches_never_exceed_the_difference():
    draw = np.random.default_rng(2)
    for size in (1, 5, 63, 64, 65, 900, 6000):
        sets = sorted(family(draw, 12, size, 0.5), key=len)
        sketches = jaccard.Sketches([jaccard.sketch(s) for s in sets])
        a, b = np.triu_indices(len(sets), 1)
        # Sizes of a like order only: the larger set is one level higher at most.
        for x, y, apart in zip(a, b, sketches.apart(a, b)):
            assert apart <= len(np.setxor1d(sets[x], sets[y]))


def test_sketch_levels_fold():
    draw = np.random.default_rng(3)
    small, large = np.unique(draw.integers(0, 2**63, 120).astype(np.uint64)), np.unique(draw.integers(0, 2**63, 140).astype(np.uint64))
    assert len(jaccard.sketch(small)) * 2 == len(jaccard.sketch(large))
    half = np.frombuffer(jaccard.sketch(large), np.uint8).reshape(2, -1)
    odd = np.bincount((large & np.uint64(255)).astype(np.int64), minlength=256) & 1
    assert (np.packbits(odd.astype(np.uint8)) == half[0] ^ half[1]).all()


def test_product_keeps_every_link_and_few_others():
    draw = np.random.default_rng(4)
    sets = family(draw, 80, 100, 0.35) + family(draw, 60, 250, 0.4) + [np.zeros(0, np.uint64)]
    components = [i // 3 for i in range(len(sets))]
    for without in ((), (3, 100)):
        got = jaccard.multiply_apart(block(sets, components, without))
        pairs = set(zip(got["a"].to_pylist(), got["b"].to_pylist()))
        assert len(pairs) == got.num_rows
        want, near = set(), 0
        for a in range(len(sets) - 1):
            for b in range(a + 1, len(sets) - 1):
                if components[a] != components[b] and len(np.intersect1d(sets[a], sets[b])):
                    near += 1
                    if links(sets[a], sets[b]):
                        want.add((a, b))
        assert want <= pairs
        assert all(c >= n for c, n in zip(got["common"].to_pylist(), got["need"].to_pylist()))
        if not without:
            assert len(pairs) < len(want) + (near - len(want)) / 4


def test_parts_of_a_block_add_up(monkeypatch):
    draw = np.random.default_rng(5)
    whole = block(family(draw, 40, 60, 0.4), list(range(40)))
    first = jaccard.multiply_apart(whole).to_pydict()
    monkeypatch.setattr(jaccard, "PAIRS_HELD", 7)
    monkeypatch.setattr(jaccard, "SKETCHES_HELD", 3)
    assert jaccard.multiply_apart(whole).to_pydict() == first


def test_nearest_are_few_and_of_other_components():
    draw = np.random.default_rng(6)
    components = [i // 2 for i in range(90)]
    got = jaccard.multiply_near(block(family(draw, 90, 80, 0.3), components))
    rows = list(zip(got["doc"].to_pylist(), got["other"].to_pylist()))
    assert rows and len(set(rows)) == len(rows)
    assert all(components[a] != components[b] for a, b in rows)
    assert max(sum(a == d for a, _ in rows) for d in range(90)) <= jaccard.NEAREST


def test_lists_without_a_partner_of_a_like_size_go():
    sizes = {1: 100, 2: 134, 3: 75, 4: 300, 5: 301, 6: 100}
    held = {7: [1, 2, 4], 8: [1, 3], 9: [4, 5, 2], 10: [6]}
    rows = [(h, d) for h, docs in held.items() for d in docs]
    packed = {"h": np.uint64, "doc": np.int64, "n": np.int32}
    columns = {"h": [h for h, _ in rows], "doc": [d for _, d in rows], "n": [sizes[d] for _, d in rows]}
    whole = pa.table({"block": pa.array([0], pa.int32()), **{c: pa.array([np.array(columns[c], t).tobytes()], pa.binary()) for c, t in packed.items()}})
    got = jaccard.multiply_stars(whole).to_pylist()
    lists = {r["doc"]: np.frombuffer(r["h"], np.uint64).tolist() for r in got if r["leader"] is None}
    assert lists == {1: [8], 3: [8], 4: [9], 5: [9]}
    assert {(r["doc"], r["leader"], r["common"]) for r in got if r["leader"] is not None} == {(3, 1, 1)}


def test_empty_blocks():
    none = block([], [])
    assert jaccard.multiply_apart(none).num_rows == jaccard.multiply_near(none).num_rows == 0
    alone = block([np.arange(9, dtype=np.uint64)], [0])
    assert jaccard.multiply_apart(alone).num_rows == jaccard.multiply_near(alone).num_rows == 0


def test_near_misses_of_one_base(spark):
    """A group of edited copies around the threshold: some link, some do not, some only by way of others."""
    draw = random.Random(7)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(220):
        words = list(base)
        for _ in range(draw.randrange(1, 9)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        rows.append((draw.randrange(10**6) * 220 + i, " ".join(words)))
    # One id for two texts: what links one links all.
    rows += [(5, rows[0][1]), (5, "quite another text that is alone in this table")]
    got = {r.component_id for r in jaccard.join(table(spark, rows)).collect()}
    single = [r for r in rows if r[0] != 5]
    want = component_ids(single)
    by_id = {r.doc_id: r.component_id for r in jaccard.join(table(spark, single)).collect()}
    assert by_id == {i: c for i, (_, c) in want.items()}
    assert 5 in got and 1 < len(set(by_id.values())) < len(single)
