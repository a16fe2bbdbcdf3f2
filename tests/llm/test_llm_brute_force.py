"""Operators against plain versions of what they compute."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldcurve.llm import jaccard, language, mixing, pieces, quality, secrets, suffixes, topk, toxicity
from foldcurve.llm.common import crc_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[j : j + 5]) for j in range(max(len(words) - 4, 1))} if words else set()


def component_ids(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_against_all_pairs(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    common = [draw.choice(words) for _ in range(40)]
    rows = []
    for i in range(240):
        kind = draw.randrange(5)
        if kind == 0 and rows:
            base = list(draw.choice(rows)[1].split())
            for _ in range(draw.randrange(4)):
                if base:
                    base[draw.randrange(len(base))] = draw.choice(words)
        elif kind == 1:
            base = common + [draw.choice(words) for _ in range(draw.randrange(1, 30))]
        elif kind == 2:
            base = [draw.choice(words) for _ in range(draw.randrange(7))]
        else:
            base = [draw.choice(words) for _ in range(draw.randrange(5, 120))]
        rows.append((draw.randrange(10**6) * 240 + i, " ".join(base).upper() if draw.random() < 0.2 else " ".join(base)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(table(spark, rows)).collect()}
    assert got == component_ids(rows)
    assert len({c for _, c in got.values()}) < len(rows)


def test_near_copies_do_not_become_pairs(spark):
    """A chain of copies, each one word on: all linked, though its ends are not alike."""
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[i : i + 100])) for i in range(60)]
    got = {r.component_id for r in jaccard.join(table(spark, rows)).collect()}
    assert got == {0}


def test_prefixes_share_what_is_needed():
    draw = np.random.default_rng(1)
    known = np.arange(0, 200, 3).astype(np.uint64)
    some = jaccard.Frequent(jaccard.counted_key(known, 7), draw.integers(1, 9, len(known)), 7)
    for _ in range(300):
        n = int(draw.integers(1, 60))
        a = np.unique(draw.integers(0, 200, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) < 0.9], draw.integers(0, 200, 3).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
            continue
        need = min(jaccard.COMMON, jaccard.least_overlap(min(len(a), len(b))))
        for order in (None, some):
            assert len(np.intersect1d(jaccard.prefix(a, order), jaccard.prefix(b, order))) >= need


def removed(rows):
    first, out = {}, {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - 49):
            if first.setdefault(data[a : a + 50], i) < i:
                gone[a : a + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_against_all_windows(spark, seed):
    draw = random.Random(seed)
    base = ["".join(draw.choice("ab ") for _ in range(200)) for _ in range(4)] + ["a" * 300, "\0" * 120, "é" * 80, "ab" * 100]
    rows = [(i, "".join(draw.choice(base)[draw.randrange(60) : draw.randrange(60, 300)] for _ in range(draw.randrange(6)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "x" * 49), (503, "x" * 50), (504, "y" + "x" * 50)]
    got = {r[0]: tuple(r)[1:] for r in suffixes.dedup(table(spark, rows)).collect()}
    assert got == removed(rows)


def test_suffixes_of_one_id_do_not_remove_each_other(spark):
    text = "abcdefghij" * 12
    out = suffixes.dedup(table(spark, [(3, text), (3, text), (None, text)]), with_text=True).collect()
    assert all(r.n_removed == 0 and bytes(r.kept).decode() == text for r in out)


def test_levels_grow_with_the_logarithm():
    levels = suffixes.Levels()
    for i in range(64):
        windows = suffixes.sortable(np.frombuffer(b"%050d" % i, f"V{suffixes.MATCH}"))
        levels.add(windows, np.array([i]))
    assert len(levels.levels) <= 7 and sum(len(w) for w, _ in levels.levels) == 64


BASE = (
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def base_spans(text):
    spans = sorted((m.start(), i, k, m.end()) for i, (k, x, ok) in enumerate(BASE) for m in x.finditer(text or "") if ok(m))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def test_secrets_against_python(spark):
    draw = random.Random(4)
    bits = ["token", "Token: ", "password", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "é😀", "api_key=", "apikey", "secret = ", "x", "abcdefgh", "\n", "passwd="]
    rows = [(i, "".join(draw.choice(bits) for _ in range(draw.randrange(14)))) for i in range(400)]
    got = {r.doc_id: r for r in secrets.digest(table(spark, rows)).collect()}
    for i, text in rows:
        want = base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))


def test_randomness_battery(spark):
    draw = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(draw.choice(alphabet) for _ in range(40)) for _ in range(60)]
    plain = ["section1subsection2paragraph3of4the5text6again", "aaaaaaaaaaaaaaaaaaaa1111111111111111", "abc123" * 8, "the_quick_brown_fox_jumps_over_1_lazy_dog"]
    rows = [(i, f"see {k} there") for i, k in enumerate(keys + plain)]
    got = {r.doc_id: r.spans for r in secrets.digest(table(spark, rows)).collect()}
    hits = sum(got[i] == "random:4:44" for i in range(len(keys)))
    assert hits >= 55
    # No run is called random; two of them are spans of 32 or more hexadecimal digits, which the base always reports.
    assert [got[len(keys) + i] for i in range(len(plain))] == ["", "hex:4:40", "hex:4:52", ""]


def test_one_key_among_ordinary_runs(spark):
    """Runs in no encoding do not raise the bar for a key in the same document."""
    draw = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lower = ["".join(draw.choice(letters) for _ in range(draw.randrange(5, 9))) for _ in range(800)]
    ordinary = [draw.choice("/_-").join(lower[i : i + 4]) for i in range(0, 800, 4)]
    assert len(ordinary) == 200 and all(len(x) >= 20 for x in ordinary)
    upper = letters.upper()
    kinds = {"decimal": ("0123456789", 28), "base 62": (letters + upper + "0123456789", 20), "base 32": (upper + "234567", 32), "letters": (letters + upper, 24), "upper": (upper, 32)}
    rows, keys = [], {}
    for kind, (alphabet, n) in kinds.items():
        for _ in range(20):
            at, key = len(rows), "".join(draw.choice(alphabet) for _ in range(n))
            rows.append((at, " ".join([*ordinary[:100], key, *ordinary[100:]])))
            start = len(" ".join(ordinary[:100])) + 1
            keys[at] = (kind, f"random:{start}:{start + n}")
    got = {r.doc_id: r.spans for r in secrets.digest(table(spark, rows)).collect()}
    found = {kind: sum(got[i] == span for i, (k, span) in keys.items() if k == kind) for kind in kinds}
    assert all(n >= 17 for n in found.values()), found
    assert all(got[i] in ("", span) for i, (_, span) in keys.items())


def test_quality_against_python(spark):
    draw = random.Random(8)
    bits = ["the", "cat", "\n", " ", "\t", "#a", "von", "$$", "\n\n", "é", "a b c", "The"]
    rows = [(i, draw.choice(["", " "]).join(draw.choice(bits) for _ in range(draw.randrange(150)))) for i in range(200)]
    got = {r.doc_id: r for r in quality.judge(table(spark, rows)).collect()}
    for i, text in rows:
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        times = Counter(grams)
        repeated = {j + d for j, g in enumerate(grams) if times[g] > 1 for d in range(3)}
        r = got[i]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_topk_against_all_pairs(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i), draw.integers(-3, 4, 6).astype(float).tolist()) for i in range(700)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(topk.scaled(vectors), F.col("vec_id") % 50 == 0).collect())
    m = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    want = []
    for q in range(0, 700, 50):
        scores = m @ m[q]
        order = [int(i) for i in np.lexsort((np.arange(700), -scores)) if i != q][:5]
        want += [(q, r + 1, i, int(scores[i])) for r, i in enumerate(order)]
    assert got == sorted(want)


def test_dual_tree_drops_pairs():
    """Two far clusters: the queries of one never meet the leaves of the other."""
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.integers(0, 9, (900, 3)) + 5000, draw.integers(0, 9, (900, 3)) - 5000])
    found = topk.block_top(np.arange(900), x[:900], np.arange(1800), x, 3)
    scores = x[:900] @ x.T
    np.fill_diagonal(scores, -(2**60))
    for q, _, s in found:
        assert s >= np.sort(scores[q])[-3]


ENCODER = pieces.Encoder(pieces.model_path())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" ▁ab\n\tthe", max_size=60))
def test_pieces_equal_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    ids = ENCODER.encode(text)
    assert ids == ENCODER.library.encode(text)
    assert ENCODER.decode(ids) == ENCODER.library.decode(ids)


def test_pieces_of_long_parts():
    for text in ("a" * 20000, " " * 5000 + "x", "日本" * 3000, "ab" * 10000):
        ids = ENCODER.encode(text)
        assert ids == ENCODER.library.encode(text) and ENCODER.decode(ids) == ENCODER.library.decode(ids)


def test_mix_meets_targets_and_is_repeatable(spark):
    draw = random.Random(9)
    rows = [(i, "w " * draw.choice([0, 1, 3, 30, 200]), draw.choice(["a", "b", "b", "c", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    by = {}
    for r in out:
        assert r.size == rows[r.doc_id][1].count("w") and r.taken <= 2 * r.size
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.size
        s[1] += r.taken
    total = sum(s[0] for s in by.values())
    assert abs(sum(s[2] for s in by.values()) - 1.5 * total) < 1e-6 * total
    for size, taken, target, source_size in by.values():
        assert size == source_size and abs(taken - target) <= 200
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


def water(sizes, budget):
    """Targets by resharing the excess until none is above its cap."""
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    open_, out, left = set(sizes), {}, budget * sum(sizes.values())
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] > 2 * sizes[s]}
        if not full:
            return out | {s: share * weights[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 5, "b": 300, "c": 10, "d": 1000, "e": 0, "f": 70}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = water(sizes, 1.5)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * 1500 for s in want)


def test_rounding_in_levels(spark):
    """Groups of eight: several levels, and the words of the source are kept but for one document."""
    rows = spark.range(2000).selectExpr("1 as number", "id as doc_id", "1 + id % 7 as size", "0.3D as share", "2000L as n_docs")
    out = mixing.rounded(rows, group=8).collect()
    assert sorted(r.doc_id for r in out) == list(range(2000)) and {r.share for r in out} == {0.0, 1.0}
    assert abs(sum(r.size * r.share for r in out) - 0.3 * sum(r.size for r in out)) <= 7
    # Small and large documents alike are taken with their chance.
    for size in range(1, 8):
        shares = [r.share for r in out if r.size == size]
        assert abs(sum(shares) / len(shares) - 0.3) < 0.12


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.labelled(docs.where(crc_mod("doc_id", 4) != 2), labels))
    rows = toxicity.tag(docs, model).join(labels, "doc_id").where(crc_mod("doc_id", 4) == 2).collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean)
    assert wins / len(toxic) / len(clean) >= 0.8
    assert all(s < 0.3 for s in clean)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        for s in r.spans:
            assert toxicity.TOKEN.fullmatch(texts[r.doc_id][s.start : s.stop])


def test_messages_equal_enumeration():
    """Marginals of a short chain in neutral text, by the sum over all labellings of it and its surroundings."""
    model = toxicity.Field({}, -2.0, np.array([[0.0, -1.0], [0.0, 0.7]]))
    weights = np.array([0.0, 3.0, 0.0, 4.0])
    got = 1 / (1 + np.exp(-model.marginals(weights, np.array([True, False, False, False]))))
    pad = 9
    emit = np.concatenate([np.zeros(pad), weights, np.zeros(pad)]) + model.bias
    n = len(emit)
    total, on = 0.0, np.zeros(n)
    states = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
    score = states @ emit + sum(model.step[states[:, i], states[:, i + 1]] for i in range(n - 1))
    p = np.exp(score)
    total, on = p.sum(), (states * p[:, None]).sum(axis=0)
    assert np.allclose(got, (on / total)[pad : pad + 4], atol=1e-4)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    part = crc_mod("doc_id", 5)
    learned = language.prototypes(docs.where(part != 0))
    rows = language.identify(docs, learned).join(docs.select("doc_id", "lang"), "doc_id").where(part == 0).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert learned.keys() == {"de", "en", "es", "fr"}


def test_language_windows_of_long_texts():
    """Cuts of a long text give the vector that the whole gives."""
    profiles = language.Profiles(64)
    text = "Some text, with gaps --- and more. " * 30
    whole = profiles.encode([text, "", None, "x"])
    before = language.BLOCK_CHARS
    try:
        language.BLOCK_CHARS = 37
        assert np.allclose(language.Profiles(64).encode([text, "", None, "x"]), whole)
    finally:
        language.BLOCK_CHARS = before
    assert not whole[1].any() and not whole[2].any() and whole[3].any()
