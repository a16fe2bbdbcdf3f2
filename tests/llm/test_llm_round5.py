"""The Jaccard product between components, and characters of one byte that are no piece."""

import numpy as np
import pyarrow as pa
from tests.llm.test_llm_brute_force import table
from tests.llm.test_llm_round4 import column_block
from tests.llm.test_llm_sketches import family

from foldcurve.llm import jaccard, pieces


def in_components(sets, components):
    apart = np.repeat(np.array(components, np.int64) - np.arange(len(sets)), [len(s) for s in sets])
    return column_block(sets).append_column("component", pa.array([apart.tobytes()], pa.binary()))


def test_lists_within_a_component_make_no_rows():
    draw = np.random.default_rng(11)
    sets = family(draw, 12, 60, 0.2) + family(draw, 40, 100, 0.2)
    whole = jaccard.multiply_short(in_components(sets, [0] * 12 + [12] * 40))
    assert whole.num_rows == 0
    # Of two components in short lists, only the pairs between them are made, with all that they share there.
    got = jaccard.multiply_short(in_components(sets[:12], [0] * 5 + [5] * 7)).to_pylist()
    every = jaccard.multiply_short(column_block(sets[:12])).to_pylist()
    between = {(r["doc"], r["other"], r["common"], r["need"]) for r in every if (r["doc"] < 5) != (r["other"] < 5)}
    assert between and {(r["doc"], r["other"], r["common"], r["need"]) for r in got} == between


def test_blocks_hold_every_first_shingle_once(spark):
    texts = [(i, " ".join(f"w{i}.{j % 50}" for j in range(70))) for i in range(30)] + [(30, texts_of := "one two"), (31, None), (None, "x y"), (32, texts_of)]

    class Nothing:
        value = None

    rows = jaccard.prefixes(table(spark, texts).coalesce(1), Nothing)
    first = {r.doc: (r.n, np.frombuffer(r.h, np.uint64).tolist()) for r in rows.collect()}
    sets = {i: jaccard.shingles(t) for i, t in texts if i is not None and t and i != 32}
    assert first == {i: (len(s), sorted(jaccard.prefix(s, None).tolist())) for i, s in sets.items()}
    found = []
    for r in jaccard.postings(rows.selectExpr("*", "doc + 100 as component"), 7).collect():
        h, doc, n, component = (np.frombuffer(r[c], k) for c, k in (("h", np.uint64), ("doc", np.int64), ("n", np.int32), ("component", np.int64)))
        assert (jaccard.block_of(h, 7) == r.block).all() and (component == 100).all()
        found += zip(doc.tolist(), n.tolist(), h.tolist())
    assert sorted(found) == sorted((i, n, h) for i, (n, hashes) in first.items() for h in hashes)


def test_characters_of_one_byte_need_no_list_of_their_own(monkeypatch):
    own = pieces.Encoder(pieces.model_path())
    texts = ["one.\nTwo\tthree \n\n four\x7f\x00 five", "a\nb", "".join(map(chr, range(128))) + " z"]
    want = [own.library.encode(t) for t in [*texts, "é\x80\n你 \U0001f600"]]
    real = own.ids_at
    monkeypatch.setattr(own, "ids_at", None)
    # Parts of up to MATRIX_CHARS characters go without it.
    assert [ids.tolist() for ids in own.encode_all(texts)] == want[:3]
    monkeypatch.setattr(own, "ids_at", real)
    assert own.encode("é\x80\n你 \U0001f600") == want[3]
    # Few and many characters for the pairs of a matrix.
    draw = np.random.default_rng(12)
    for letters in ("abce", "".join(map(chr, range(0x4E00, 0x4F00))) + "the in"):
        some = ["".join(draw.choice(list(letters), draw.integers(1, 30))) for _ in range(40)]
        assert [ids.tolist() for ids in own.encode_all(some)] == [own.library.encode(t) for t in some]
