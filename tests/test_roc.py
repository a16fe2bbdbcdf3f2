"""ROC statistics against brute force, edge cases and properties."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from foldcurve.functions.ordering import with_sortable_bits
from foldcurve.operators import roc
from foldcurve.operators.running import ordinal, running_totals


def bits(v):
    n = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
    return -n if v < 0 else n


def test_sortable_bits_equal_the_bits_of_the_number(spark):
    random.seed(1)
    values = [0.0, -0.0, 5e-324, 2.0**-1022, 1e-310, 1.7976931348623157e308, math.inf, -math.inf, 7.999999999999999, 8.0]
    values += [random.uniform(-1, 1) * 10 ** random.randint(-300, 300) for _ in range(500)]
    values += [2.0**k * s for k in range(-1074, 1024, 7) for s in (1, -1)]
    values += [2.0**k * (1 - 2**-53) for k in range(-1000, 1024, 9)]
    rows = with_sortable_bits(spark.createDataFrame([(v,) for v in values], "v double"), "v", "b").collect()
    assert all(r.b == bits(r.v) for r in rows)


@pytest.mark.parametrize("cell_rows", [1, 10, 1 << 20])
def test_running_totals_with_crowded_cells(spark, cell_rows):
    random.seed(2)
    # Crowded low values, a wide spread, and neighbours that differ in the last bits only.
    orders = {random.randrange(3000) for _ in range(700)}
    orders |= {random.randrange(-(1 << 62), 1 << 62) for _ in range(300)} | {(1 << 50) + i for i in range(300)}
    data = [(g, o, 1 + (o % 5)) for g in ("a", "b", None) for o in orders]
    df = spark.createDataFrame(data, "g string, o long, n long")
    got = running_totals(df, ["g"], "o", ["n"], with_start=True, cell_rows=cell_rows).collect()
    assert len(got) == len(data) + 3
    for g in ("a", "b", None):
        run = 0
        mine = sorted((r for r in got if r.g == g and r.o is not None), key=lambda r: r.o)
        for r in mine:
            run += r.n
            assert r.through_n == run
        assert {r.total_n for r in mine} == {run}
    assert sum(r.o is None for r in got) == 3


def test_ordinal_without_keys(spark):
    df = spark.range(0, 2000).select((F.col("id") * 7919 % 2000).alias("k"))
    rows = ordinal(df, [], "k", "nth", cell_rows=64).collect()
    assert all(r.nth == r.k + 1 for r in rows)


def brute_points(pairs):
    """(threshold, tp, fp) by falling score, after the origin."""
    out, tp, fp = [(math.inf, 0, 0)], 0, 0
    for s in sorted({p for _, p in pairs}, reverse=True):
        tp += sum(y for y, p in pairs if p == s)
        fp += sum(1 - y for y, p in pairs if p == s)
        out.append((s, tp, fp))
    return out


def brute_report(pairs, levels=(0.9, 0.75)):
    points = brute_points(pairs)
    P, N = points[-1][1], points[-1][2]
    area = sum((b[2] - a[2]) * (b[1] + a[1]) for a, b in zip(points, points[1:])) / (2 * P * N)
    q1, q2 = area / (2 - area), 2 * area**2 / (1 + area)
    se = math.sqrt((area * (1 - area) + (P - 1) * (q1 - area**2) + (N - 1) * (q2 - area**2)) / (P * N))
    rates = [(t / P, f / N) for _, t, f in points]
    best = min(range(len(rates)), key=lambda i: math.sqrt((1 - rates[i][0]) ** 2 + rates[i][1] ** 2))
    out = {"AUC": area, "SE": se, "OpSen": rates[best][0], "OpSpe": 1 - rates[best][1]}
    for i, level in enumerate(levels):
        x = 1 - level
        j = max(k for k in range(len(rates)) if rates[k][1] <= x)
        (y0, x0), (y1, x1) = rates[j], rates[j + 1]
        out[f"SensLevel{i}"] = (y1 - y0) / (x1 - x0) * (x - x0) + y0
    z = 1.959963984540054
    out |= {"AucCI_lo": area - z * se, "AucCI_hi": area + z * se}
    for name, share, n in (("Sen", out["OpSen"], P), ("Spe", out["OpSpe"], N)):
        half = 1.96 * math.sqrt(share * (1 - share) / n)
        out |= {f"{name}CI_lo": share - half, f"{name}CI_hi": share + half}
    return out


def as_table(spark, curves):
    rows = [(m, y, float(p)) for m, pairs in curves.items() for y, p in pairs]
    return spark.createDataFrame(rows, "model string, y int, p double")


CURVES = {
    "noise": [(i % 3 == 0, (i * 37 % 101) / 101) for i in range(200)],
    "ties": [(i % 2, (i * 7 % 5) / 5) for i in range(60)],
    "good": [(1, 0.5 + i / 100) for i in range(30)] + [(0, 0.2 + i / 60) for i in range(30)],
    "perfect": [(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)],
    "reversed": [(0, 0.9), (0, 0.8), (1, 0.2), (1, 0.1)],
    "one positive": [(1, 0.6)] + [(0, i / 20) for i in range(20)],
    "negative scores": [(i % 2, (i % 9) - 4.5 + i % 2) for i in range(50)],
}
CURVES = {m: [(int(y), float(p)) for y, p in pairs] for m, pairs in CURVES.items()}


@pytest.mark.parametrize("cell_rows", [3, 1 << 20])
def test_report_equals_brute_force(spark, cell_rows):
    rows = roc.roc_report(as_table(spark, CURVES), cell_rows=cell_rows).collect()
    assert len(rows) == len(CURVES)
    for r in rows:
        for name, want in brute_report(CURVES[r["model"]]).items():
            assert r[name] == pytest.approx(want, abs=1e-12), (r["model"], name)


def test_points_equal_brute_force(spark):
    got = roc.roc_points(as_table(spark, CURVES)).collect()
    for model, pairs in CURVES.items():
        mine = sorted(((r.threshold, r.tp, r.fp) for r in got if r.model == model), reverse=True)
        assert mine == brute_points(pairs)


def test_equal_scores_and_single_class(spark):
    df = as_table(spark, {"flat": [(1, 0.5), (0, 0.5), (0, 0.5)], "only": [(1, 0.3), (1, 0.7)]})
    rows = {r["model"]: r for r in roc.roc_report(df).collect()}
    assert rows["flat"]["AUC"] == 0.5
    assert (rows["flat"]["OpSen"], rows["flat"]["OpSpe"]) == (0.0, 1.0)
    assert all(v is None for k, v in rows["only"].asDict().items() if k != "model")


def test_equal_distances_take_the_highest_threshold(spark):
    df = as_table(spark, {"m": [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)]})
    # (tpr, fpr) = (0.5, 0) and (1, 0.5) are equally near to the corner.
    assert roc.optimal_cutoff(df).first().threshold == 0.9


def test_rank_sum_and_symmetry(spark):
    df = as_table(spark, CURVES)
    area = {r.model: r.auc for r in roc.auc(df).collect()}
    ranks = {r.model: r.auc for r in roc.auc_rank_sum(df).collect()}
    flipped = {r.model: r.auc for r in roc.auc(df.withColumn("p", -F.col("p"))).collect()}
    shifted = {r.model: r.auc for r in roc.auc(df.withColumn("p", F.exp("p") * 3)).collect()}
    for m in CURVES:
        assert ranks[m] == pytest.approx(area[m])
        assert flipped[m] == pytest.approx(1 - area[m])
        assert shifted[m] == pytest.approx(area[m])


def test_area_beyond_long_range(spark):
    """Counts so large that the plain product sum would not fit a LONG."""
    big = 3 * 10**11
    points = spark.createDataFrame(
        [(0, 0, 0, 0), (big, 0, big, 0), (0, big, big, big)], "pos long, neg long, tp long, fp long"
    ).selectExpr("*", f"{big}L as positives", f"{big}L as negatives")
    sums = points.agg(*roc._counts(), *roc._area_sums())
    assert sums.selectExpr(f"{roc.AREA} as auc").first().auc == 1.0


def test_rows_without_score_are_on_no_curve(spark):
    df = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.1), ("m", 1, None), ("m", None, 0.5)], "model string, y int, p double")
    row = roc.auc(df).first()
    assert (row.positives, row.negatives, row.auc) == (1, 1, 1.0)


def test_level_outside_range(spark):
    with pytest.raises(ValueError):
        roc.sensitivity_at(1.2)
