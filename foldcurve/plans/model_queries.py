"""Registered queries that fit models. SQL cannot fit them; where it can, it says what must hold of a fit.

Features come from the whole text of every labelled document. Outer and inner folds, grids
and sizes are those of the evaluation: a nested query searches the whole grid of its model,
a query with one cell takes it from that grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcurve.operators import folds, ranking, roc, symbolic
from foldcurve.plans import reports, stacked, stacked_trees
from foldcurve.plans.evaluate import Evaluation, eliminate, evaluate
from foldcurve.plans.estimators import Standardize
from foldcurve.plans.queries import query, table
from foldcurve.plans.registry import MODELS, ModelSpec
from foldcurve.plans.search import Search
from foldcurve.plans.stacked_search import search_all
from foldcurve.session import cut_lineage

OUTER = INNER = 10
#: The cell of the symbolic searches: the least of the grid that draws from all depths. Without a fitness that ends
#: it, every generation is bred.
SEARCH = {"start_depth": (2, 6), "population": 100, "tournament": 7, "generations": 5, "stop_at": None}
TEXT_FEATURES = ["n_chars", "n_words", "n_lines", "word_length", "digits", "capitals", "marks", "spread"]


def document_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with counts taken from their text, dealt out to outer folds.

    Characters are counted by the length of a text without the others: regexp_count copies the text for each match.
    """
    documents = table(spark, folder, "documents").selectExpr(
        "doc_id",
        "double(n_chars) as n_chars",
        "double(size(split(text, ' '))) as n_words",
        "double(length(regexp_replace(text, '[^\\n]+', '')) + 1) as n_lines",
        "n_chars / size(split(text, ' ')) as word_length",
        "length(regexp_replace(text, '[^0-9]+', '')) / greatest(n_chars, 1) as digits",
        "length(regexp_replace(text, '[^A-Z]+', '')) / greatest(n_chars, 1) as capitals",
        "length(regexp_replace(text, '[A-Za-z0-9 ]+', '')) / greatest(n_chars, 1) as marks",
        "size(array_distinct(split(text, ' '))) / size(split(text, ' ')) as spread",
    )
    labels = table(spark, folder, "labels").selectExpr("doc_id", "quality as y")
    rows = documents.join(labels, "doc_id").withColumnRenamed("doc_id", "row_id")
    return folds.stratified_folds(rows, OUTER)


def out_of_fold(spark: SparkSession, folder: str, spec: ModelSpec, **how) -> Evaluation:
    # Every fit reads the rows many times; the texts are read and counted once.
    rows = cut_lineage(document_rows(spark, folder))
    return evaluate(rows, spec, TEXT_FEATURES, n_outer=OUTER, n_inner=INNER, parallelism=OUTER, **how)


def fixed(name: str, **cell) -> ModelSpec:
    """A model of the registry with one parameter cell."""
    return MODELS[name].with_grid(**{k: [v] for k, v in cell.items()})


@query("logreg_scores")
def logreg_scores(spark: SparkSession, folder: str) -> DataFrame:
    return out_of_fold(spark, folder, fixed("LOGR", C=1), search=False).predictions


@query("tree_scores")
def tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    return out_of_fold(spark, folder, fixed("DT", depth=3, impurity="gini"), search=False).predictions


@query("forest_scores")
def forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    return out_of_fold(spark, folder, fixed("RF", trees=10, depth=3), search=False).predictions


@query("gbt_scores")
def gbt_scores(spark: SparkSession, folder: str) -> DataFrame:
    return out_of_fold(spark, folder, fixed("XGB", trees=10, depth=2), search=False).predictions


@query("gbt_slow_scores")
def gbt_slow_scores(spark: SparkSession, folder: str) -> DataFrame:
    return out_of_fold(spark, folder, fixed("LGB", trees=10, depth=2), search=False).predictions


@query("adaboost_scores")
def adaboost_scores(spark: SparkSession, folder: str) -> DataFrame:
    # The least number of rounds in the grid after which the rows were written out at least once.
    return out_of_fold(spark, folder, fixed("ADAB", depth=1, rounds=30), search=False).predictions


@query("rbf_scores")
def rbf_scores(spark: SparkSession, folder: str) -> DataFrame:
    return out_of_fold(spark, folder, fixed("SVM", C=1, gamma=0.1), search=False).predictions


@query("knn_scores")
def knn_scores(spark: SparkSession, folder: str) -> DataFrame:
    return out_of_fold(spark, folder, fixed("KNN", k=5), search=False).predictions


@query("search_scores")
def search_scores(spark: SparkSession, folder: str) -> DataFrame:
    return out_of_fold(spark, folder, fixed("GP", **SEARCH), search=False).predictions


@query("rfe_features")
def rfe_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features that elimination keeps, for two sizes."""
    rows = document_rows(spark, folder)
    rows = cut_lineage(rows)
    scaled = Standardize(TEXT_FEATURES).fit(rows).transform(rows).select("y", "features").persist()
    kept = eliminate(scaled, len(TEXT_FEATURES), [5, 7])
    scaled.unpersist()
    # Taken from the labels, so that the table is empty where they are.
    listed = F.array(*[F.struct(F.lit(n).alias("n_features"), F.lit(TEXT_FEATURES[i]).alias("feature")) for n, some in kept.items() for i in some])
    return table(spark, folder, "labels").agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(listed), "n_rows")


def predictions_of(spark: SparkSession, folder: str, specs: Sequence[ModelSpec], **how) -> DataFrame:
    parts = [out_of_fold(spark, folder, spec, **how).predictions for spec in specs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cut_lineage(out)


@query("nested_eval")
def nested_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Two-level evaluation of a tree, ending in the ROC report."""
    return roc.roc_report(predictions_of(spark, folder, [MODELS["DT"]]))


@query("nested_eval_knn")
def nested_eval_knn(spark: SparkSession, folder: str) -> DataFrame:
    """One neighbour search serves all sizes of the grid, and all folds of a table that is too large to compare all rows."""
    return roc.roc_report(predictions_of(spark, folder, [MODELS["KNN"]]))


@query("fuzzy_selected_tree")
def fuzzy_selected_tree(spark: SparkSession, folder: str) -> DataFrame:
    """A tree on fuzzy memberships, learned per fold, after elimination of the weakest of them."""
    spec = fixed("DT", depth=3, impurity="gini")
    return roc.roc_report(predictions_of(spark, folder, [spec], n_sets=3, select=[22], search=False))


@query("nested_best_params")
def nested_best_params(spark: SparkSession, folder: str) -> DataFrame:
    return out_of_fold(spark, folder, MODELS["LOGR"]).best()


@query("logreg_coefficients")
def logreg_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    fits = out_of_fold(spark, folder, fixed("LOGR", C=1), search=False).fits
    return reports.coefficient_table(spark, fits)


@query("selection_frequency")
def selection_frequency(spark: SparkSession, folder: str) -> DataFrame:
    fits = out_of_fold(spark, folder, fixed("LOGR", C=1), search=False, select=[6]).fits
    return reports.selection_frequency(reports.selection_table(spark, fits, TEXT_FEATURES))


@query("coefficient_rank")
def coefficient_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Features of each fold by the size of their coefficient; those at or above the mean are kept."""
    fits = out_of_fold(spark, folder, fixed("LOGR", C=1), search=False).fits
    sizes = reports.coefficient_table(spark, fits).withColumn("value", F.abs("coefficient"))
    return ranking.importance_rank(sizes.select("fold_id", "model", "index", "feature", "value"), ["fold_id", "model"])


@query("tree_nodes")
def tree_nodes(spark: SparkSession, folder: str) -> DataFrame:
    fits = out_of_fold(spark, folder, fixed("DT", depth=3, impurity="gini"), search=False).fits
    return reports.node_text(reports.tree_structure(reports.tree_table(spark, fits)))


@query("expression_table")
def expression_table(spark: SparkSession, folder: str) -> DataFrame:
    return reports.expression_table(spark, out_of_fold(spark, folder, fixed("GP", **SEARCH), search=False).fits)


# What must hold of fits ---------------------------------------------------

#: Rows that each outer fold trains on: folds are dealt in turn.
SQL_TRAIN = f"""
with n as (select count(*) as n from documents join labels using (doc_id)),
folds as (select cast(f as integer) as fold_id, n - n // {OUTER} - case when f < n % {OUTER} then 1 else 0 end as n_train from n, range({OUTER}) as r(f))
"""


def document_stack(spark: SparkSession, folder: str) -> stacked.Stack:
    table, _ = stacked.stack(cut_lineage(document_rows(spark, folder)), TEXT_FEATURES, n_outer=OUTER, n_inner=INNER)
    return table


@query(
    "logistic_optimum",
    SQL_TRAIN + f"select fold_id, c::double as penalty, n_train, true as at_optimum from folds, (select unnest({[float(c) for c in MODELS['LOGR'].grid['C']]}) as c)",
)
def logistic_optimum(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the slope of the objective vanishes for every outer fold and penalty, summed up over the rows anew."""
    rows = document_stack(spark, folder)
    fits = stacked.solve(rows, [stacked.Problem(stacked.Fold(o), float(c)) for o in range(OUTER) for c in MODELS["LOGR"].grid["C"]])
    listed = [(f.problem.fold.outer, f.problem.C, f.intercept, f.weights.tolist(), f.mean.tolist(), f.deviation.tolist()) for f in fits]
    spec = spark.createDataFrame(listed, "fold_id int, penalty double, intercept double, weights array<double>, mean array<double>, deviation array<double>")
    trained = rows.rows.select("y", "x", F.posexplode("place").alias("fold_id", "inner")).where("inner >= 0")
    each = trained.join(F.broadcast(spec), "fold_id")  # a row for each fold and penalty
    each = each.withColumn("z", F.zip_with(F.zip_with("x", "mean", lambda a, m: a - m), "deviation", lambda a, s: a / s))
    margin = F.aggregate(F.zip_with("z", "weights", lambda a, w: a * w), F.lit(0.0), lambda t, v: t + v) + F.col("intercept")
    each = each.withColumn("residual", symbolic.logistic(margin) - F.col("y"))
    terms = F.concat(F.array("residual"), F.transform("z", lambda v: v * F.col("residual")))
    of_penalty = F.concat(F.array(F.lit(0.0)), F.transform("weights", lambda w: w / F.col("penalty")))
    cells = each.select("fold_id", "penalty", F.posexplode(F.arrays_zip(terms.alias("term"), of_penalty.alias("more"))).alias("at", "cell"))
    slopes = cells.groupBy("fold_id", "penalty", "at").agg(F.count(F.lit(1)).alias("n"), F.abs(F.sum("cell.term") + F.max("cell.more")).alias("slope"))
    return slopes.groupBy("fold_id", "penalty").agg(F.max("n").alias("n_train"), (F.max(F.col("slope") / F.col("n")) < 1e-6).alias("at_optimum"))


@query(
    "tree_partitions",
    SQL_TRAIN + "select fold_id, impurity, n_train, true as leaves_match, true as all_split_gain from folds, (select unnest(['gini', 'entropy']) as impurity)",
)
def tree_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each tree has a leaf more than splits, its leaves hold all training rows, and each split parts its rows, by routing the rows anew."""
    rows = document_stack(spark, folder)
    trees = stacked_trees.grow(rows, [stacked_trees.Kind(stacked.Fold(o), i) for o in range(OUTER) for i in stacked_trees.IMPURITIES], 30)
    matched = stacked_trees.leaf_matches(rows, trees).groupBy("tree").agg(F.sum("n").alias("n_train"), F.min("same").alias("same"), F.count(F.lit(1)).alias("found"))
    listed = []
    for t, tree in enumerate(trees):
        leaves = [c for n, c in enumerate(tree.counts) if tree.feature[n] < 0]
        parted = len(leaves) == len(tree.feature) - len(leaves) + 1 and all(sum(c) for c in leaves)
        listed.append((t, tree.kind.fold.outer, tree.kind.impurity, len(leaves), parted))
    spec = spark.createDataFrame(listed, "tree int, fold_id int, impurity string, leaves long, all_split_gain boolean")
    leaves_match = F.coalesce(F.col("same") & (F.col("found") == F.col("leaves")), F.lit(False))
    return F.broadcast(spec).join(matched, "tree", "left").select("fold_id", "impurity", "n_train", leaves_match.alias("leaves_match"), "all_split_gain")


@query("search_recomputed", SQL_TRAIN + "select fold_id, n_train, true as same_area from folds")
def search_recomputed(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the fitness that a search reports is the area of its expression, compiled to a column and scored anew."""
    rows, scaling = document_stack(spark, folder), {}
    found, _ = search_all(rows, [(stacked.Fold(o), Search(**SEARCH)) for o in range(OUTER)], scaling)
    parts = []
    for o, best in enumerate(found):
        _, mean, deviation = scaling[stacked.Fold(o)]
        columns = {c: (F.col("x")[i] - float(rows.centre[i] + mean[i] * rows.scale[i])) / float(deviation[i] * rows.scale[i]) for i, c in enumerate(TEXT_FEATURES)}
        train = rows.rows.where(F.col("place")[o] >= 0).select(F.lit(o).alias("fold_id"), "y", symbolic.compile_expr(best.tree, columns).alias("p"))
        parts.append(roc.auc(train, ["fold_id"]).select("fold_id", (F.col("positives") + F.col("negatives")).alias("n_train"), (F.abs(F.col("auc") - best.fitness) < 1e-9).alias("same_area")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
