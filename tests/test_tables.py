"""Folds, scaling, memberships, alignment, rankings, sources and sinks."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from foldcurve.operators import align, folds, fuzzy, ranking, scale
from foldcurve.sources import sinks, tables


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, i % 4, int(i % 3 == 0), float(i * i % 17), math.sin(i), "abc"[i % 3]) for i in range(120)]
    return spark.createDataFrame(data, "row_id long, part int, y int, a double, `b-c` double, s string").cache()


@pytest.mark.parametrize("seed", [None, 7])
def test_stratified_folds(rows, seed):
    dealt = folds.stratified_folds(rows.drop("part"), 7, seed=seed, cell_rows=5).collect()
    assert sorted(r.row_id for r in dealt) == list(range(120))
    for y in (0, 1):
        sizes = [sum(r.y == y and r.part == k for r in dealt) for k in range(7)]
        assert max(sizes) - min(sizes) <= 1


def test_roles(rows):
    roles = folds.fold_roles(rows, 4)
    assert roles.where("role = 'test'").groupBy("row_id").count().where("count <> 1").count() == 0
    assert roles.where("role = 'valid'").count() == 120
    merged = folds.merge_valid(roles)
    assert folds.in_role(merged, folds.TRAIN).count() == 3 * 120
    joined = folds.with_roles(rows.select("row_id"), roles.select("row_id", "fold_id", "role"))
    assert joined.count() == 480


def test_masks(spark):
    masks = spark.createDataFrame(
        [(0, [1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1])], "fold_id int, train array<int>, valid array<int>, test array<int>"
    )
    got = {r.row_id: r.role for r in folds.masks_to_rows(masks).collect()}
    assert got == {0: "train", 1: "train", 2: "valid", 3: "test"}


def test_moments_and_scaling(rows):
    data = rows.collect()
    scaled = {r.row_id: r for r in scale.standardize(rows, ["a", "b-c"]).collect()}
    for part in range(4):
        train = [r["b-c"] for r in data if r.part != part]
        mean, std = statistics.fmean(train), statistics.pstdev(train)
        for r in data:
            if r.part == part:
                assert scaled[r.row_id]["b-c"] == pytest.approx((r["b-c"] - mean) / std)


def test_constant_column_is_only_centred(spark):
    df = spark.createDataFrame([(i, i % 2, 5.0) for i in range(6)], "row_id long, part int, x double")
    assert {r.x for r in scale.standardize(df, ["x"]).collect()} == {0.0}


def triangle(v, lo, hi, n, k):
    if v <= lo:
        return 1.0 if k == 0 else 0.0
    if v >= hi:
        return 1.0 if k == n - 1 else 0.0
    width = (hi - lo) / (n - 1)
    peak = lo + k * width
    return max(0.0, min((v - peak + width) / width, (peak + width - v) / width))


@pytest.mark.parametrize("n", [2, 3, 5])
def test_memberships(rows, n):
    domain = fuzzy.fuzzy_domain(rows, ["a", "b-c", "s"])
    limits = {(r.fold_id, r.column): r for r in domain.collect()}
    out = fuzzy.fuzzify(rows, ["a", "b-c", "s"], domain, n, keep=["row_id", "part"]).collect()
    data = {r.row_id: r for r in rows.collect()}
    assert len(out) == 120 and len(out[0]) == 2 + 2 * n + 3
    for r in out:
        source = data[r.row_id]
        for c in ("a", "b-c"):
            limit = limits[(r.part, c)]
            train = [x[c] for x in data.values() if x.part != r.part]
            assert (limit.lo, limit.hi) == (min(train), max(train))
            grades = [r[f"{c}-{k}"] for k in range(n)]
            assert sum(grades) == pytest.approx(1)
            for k in range(n):
                assert grades[k] == pytest.approx(triangle(source[c], limit.lo, limit.hi, n, k))
        assert [r[f"s-{k}"] for k in range(3)] == [float(source.s == v) for v in "abc"]


def test_number_categories_sort_as_numbers(spark):
    df = spark.createDataFrame([(i, i % 2, (i % 3) * 5) for i in range(12)], "row_id long, part int, n int")
    out = fuzzy.fuzzify(df, ["n"], fuzzy.fuzzy_domain(df, ["n"]), keep=["n"])
    assert {(r.n, r["n-0"], r["n-1"], r["n-2"]) for r in out.collect()} == {(0, 1, 0, 0), (5, 0, 1, 0), (10, 0, 0, 1)}


def test_bad_requests_are_errors(spark, rows):
    domain = fuzzy.fuzzy_domain(rows, ["a", "s"])
    for columns, n in ((["a", "s"], 1), (["a", "s"], [3]), (["a", "s"], [3, 2]), (["a", "s"], [1, 3]), (["a"], 3)):
        with pytest.raises(ValueError):
            fuzzy.fuzzify(rows, columns, domain, n)
    flat = spark.createDataFrame([(i, i % 2, 1.0) for i in range(4)], "row_id long, part int, x double")
    with pytest.raises(ValueError):
        fuzzy.fuzzify(flat, ["x"], fuzzy.fuzzy_domain(flat, ["x"]), 3)
    with pytest.raises(ValueError):
        fuzzy.column_kinds(rows.withColumn("t", F.current_timestamp()), ["t"])


def test_missing_values(spark):
    df = spark.createDataFrame([(0, 0, 1.0, "x"), (1, 1, None, "y"), (2, 0, 3.0, None)], "row_id long, part int, v double, s string")
    assert [r.row_id for r in fuzzy.complete_rows(df, ["v", "s"]).collect()] == [0]
    gone = fuzzy.dropped_rows(df, ["v", "s"], "row_id")
    assert {r.row_id: list(r.missing) for r in gone.collect()} == {1: ["v"], 2: ["s"]}
    assert fuzzy.without_keys(df, gone, "row_id").count() == 1


@pytest.fixture(scope="module")
def predictions(spark):
    data = [
        (m, i % 3, i, i % 2, (i * (k + 3) % 11) / 11, int((i * (k + 3) % 11) / 11 > 0.5))
        for k, m in enumerate(["M1", "M2"])
        for i in range(30)
    ]
    return spark.createDataFrame(data, "model string, fold_id int, row_id long, y int, p double, yhat int").cache()


def test_wide_tables(predictions):
    wide = align.result_table(predictions, ["M1", "M2"]).collect()
    assert len(wide) == 30 and all(r.M1 == (r.row_id * 3 % 11) / 11 and r["class"] == r.row_id % 2 for r in wide)
    labels = align.class_table(predictions, ["M1", "M2"])
    assert labels.where("M1 <> M2").count() == 0
    long = align.to_long(align.result_table(predictions, ["M1", "M2"]), ["M1", "M2"], keep=["fold_id", "row_id"])
    assert long.count() == 60
    shares = {r.model: r for r in align.accuracy(predictions).collect()}
    cc = align.correctness_table(predictions, ["M1", "M2"]).agg(F.sum("M1").alias("s")).first()
    assert cc.s == shares["M1"].n_correct == pytest.approx(shares["M1"].accuracy * 30)
    assert align.pool(predictions, predictions).count() == 120


def test_positions(spark, predictions):
    one = predictions.where("model = 'M1'")
    baseline = spark.range(100, 130).selectExpr("id as k", "double(id) as base")
    out = align.attach_by_position(one, baseline, ["base"], "fold_id", "row_id", "k").orderBy("position").collect()
    order = sorted(range(30), key=lambda i: (i % 3, i))
    assert [r.row_id for r in out] == order and [r.base for r in out] == [100.0 + i for i in range(30)]
    with pytest.raises(ValueError):
        align.attach_by_position(one, baseline.limit(4), ["base"], "fold_id", "row_id", "k")


def test_rankings(spark):
    assert len(ranking.grid_cells({"a": [1, 2], "b": [3, 4, 5]})) == 6
    assert ranking.grid_table(spark, {"a": [1], "b": [2, 3]}).count() == 2
    scores = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.7), (0, 2, 0.7), (1, 0, 0.9), (1, 1, None)], "fold_id int, cell int, auc double")
    best = {r.fold_id: r.cell for r in ranking.best_cell(scores, ["fold_id"], score="auc").collect()}
    assert best == {0: 1, 1: 0}
    values = spark.createDataFrame([(0, 0.2), (1, 0.5), (2, 0.5), (3, 0.1)], "index int, value double")
    ranked = ranking.importance_rank(values)
    assert [r["index"] for r in ranked.orderBy("rank").collect()] == [2, 1, 0, 3]
    assert ranking.selected_features(ranked).first().text == "1, 2"
    assert ranking.weakest([0.5, -0.1, 0.1]) == 1


def test_sources_and_sinks(spark, predictions, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("﻿BFP,KNN,class\n0.5,0.1,1\n0.25,0.2,0\n", encoding="utf-8")
    base = tables.read_baseline(spark, str(path))
    assert base.columns == ["BFP", "class"] and base.count() == 2
    features = tables.read_features(spark, str(path), format="csv")
    assert features.columns == ["row_id", "BFP", "KNN", "y"]
    replay = tables.read_results(spark, str(path), format="csv")
    assert {r.model for r in replay.collect()} == {"BFP", "KNN"}
    assert tables.preview(base, 1)[0] == ["BFP", "class"]
    x, y = tables.features_and_label(features, ["BFP", "KNN"])
    assert (x.columns, y.columns) == (["BFP", "KNN"], ["y"])

    folder, models = str(tmp_path / "out"), ["M1", "M2"]
    runs = [dict(zip(sinks.RUN, ("sa", "2", v))) for v in ("crisp", "fuzzy")]
    for run in [*runs, runs[0]]:
        sinks.write_class(predictions, models, folder, run)
        sinks.write_cc(predictions, models, folder, run, format="csv")
        sinks.write_result(predictions, models, folder, run, baseline=predictions.where("model = 'M1'").select("fold_id", "row_id", F.col("p").alias("BFP")))
    assert spark.read.parquet(f"{folder}/class").count() == 60
    one = spark.read.parquet(f"{folder}/result").where("variant = 'fuzzy'")
    assert one.count() == 30 and {"BFP", "M1", "M2", "class"} <= set(one.columns)
    best = spark.createDataFrame([(0, "M1", {"k": "3"}), (0, "M2", {"C": "1"})], "fold_id int, model string, params map<string,string>")
    sinks.write_params(best, models, folder, runs[0])
    assert spark.read.parquet(f"{folder}/params").first().M1 == '{"k":"3"}'

    roles = spark.createDataFrame([(0, 5, "train")], "fold_id int, row_id long, role string")
    roles.write.parquet(str(tmp_path / "folds"))
    assert tables.fold_count(tables.read_folds(spark, str(tmp_path / "folds"))) == 1


def test_rows_without_a_key_have_ids_of_their_own(spark, tmp_path):
    """Equal rows in several files: different ids, the same in every reading."""
    rows = [(1.0, 0)] * 50 + [(float(i), 1) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, class int")
    df.repartition(5).write.parquet(str(tmp_path / "p"))
    df.repartition(5).write.option("header", True).csv(str(tmp_path / "c"))
    for path, how in (("p", {}), ("c", {"format": "csv", "schema": "a double, class int"})):
        first = tables.read_features(spark, str(tmp_path / path), **how).collect()
        again = tables.read_features(spark, str(tmp_path / path), **how).repartition(3).collect()
        assert sorted(first) == sorted(again) and len({r.row_id for r in first}) == 80
        assert sorted((r.a, r.y) for r in first) == sorted(rows)
    numbered = tables.read_features(spark, str(tmp_path / "p"))
    assert sorted(r.row_id for r in numbered.collect()) == list(range(80))


def test_bitmaps_hold_roles_by_block(spark, tmp_path):
    ids = [-40000, -32768, -5, 0, 1, 2, 32768, 32769, 100_000, 5_000_000_000]
    roles = spark.createDataFrame([(f, i, "test" if k % 3 == f else "train") for f in (0, 1) for k, i in enumerate(ids)], "fold_id int, row_id long, role string")
    maps = folds.rows_to_bitmaps(roles.unionByName(roles))
    assert maps.agg(F.max(F.octet_length("bitmap"))).first()[0] == 4096
    assert sorted(folds.bitmaps_to_rows(maps).select(*roles.columns).collect()) == sorted(roles.collect())
    maps.write.parquet(str(tmp_path / "m"))
    assert sorted(tables.read_folds(spark, str(tmp_path / "m")).select(*roles.columns).collect()) == sorted(roles.collect())
    assert folds.bitmaps_to_rows(maps.where("false")).count() == 0
