"""Categories as sparse vectors, against rows counted in Python."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from foldcurve.operators import fuzzy, sparse


def test_vectors_hold_the_category_of_each_column(spark):
    data = [(1, "b", 7, 0), (2, "a", 7, 1), (3, "é", 10, 1), (4, None, 10, 0), (5, "", 7, 0)]
    df = spark.createDataFrame(data, "row_id long, `x.y` string, index int, size int")
    columns = ["x.y", "index"]
    dictionary = sparse.category_dictionary(df, columns).cache()
    numbers = {(r["column"], r.value): r["index"] for r in dictionary.collect()}
    assert numbers == {("x.y", ""): 0, ("x.y", "a"): 1, ("x.y", "b"): 2, ("x.y", "é"): 3, ("index", "10"): 4, ("index", "7"): 5}
    got = {r.row_id: (r["size"], r.features) for r in sparse.sparse_features(df, columns, dictionary, keep=["size"]).collect()}
    assert set(got) == {1, 2, 3, 5}
    for row_id, x, y, size in data:
        if x is not None:
            assert got[row_id][0] == size
            assert got[row_id][1].size == 6 and list(got[row_id][1].indices) == [numbers["x.y", x], numbers["index", str(y)]]
    new = spark.createDataFrame([(9, "new", 7, 0)], df.schema)
    assert list(sparse.sparse_features(new, columns, dictionary).first().features.indices) == [5]
    twice = df.unionByName(df)
    with pytest.raises(Exception, match="share the key"):
        sparse.sparse_features(twice, columns, dictionary).collect()


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, x string")
    dictionary = sparse.category_dictionary(df, ["x"])
    assert dictionary.count() == 0 and sparse.sparse_features(df, ["x"], dictionary).count() == 0


def test_model_on_twelve_thousand_categories(spark):
    """Half of the rows hold one category; the class is that of the second column."""
    rows = spark.range(20000).selectExpr("id as row_id", "if(id % 2 = 0, 'hot', concat('c', id)) as name", "id % 5 as place", "int(id % 5 < 2) as y")
    rows = rows.union(spark.range(20000, 24000).selectExpr("id as row_id", "concat('d', id)", "id % 5", "int(id % 5 < 2)"))
    dictionary = sparse.category_dictionary(rows, ["name", "place"]).cache()
    assert dictionary.count() == 14001 + 5
    vectors = sparse.sparse_features(rows, ["name", "place"], dictionary, keep=["y"])
    model = LogisticRegression(featuresCol="features", labelCol="y", maxIter=15, regParam=1e-4).fit(vectors)
    assert model.numFeatures == 14006
    wrong = model.transform(vectors).where(F.col("prediction") != F.col("y")).count()
    assert wrong == 0


def test_label_memberships(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "row_id long, y int")
    assert sorted(map(tuple, fuzzy.fuzzy_label(df).collect())) == [(1, 1.0, 0.0), (2, 0.0, 1.0)]
    with pytest.raises(ValueError, match="other than 0 and 1"):
        fuzzy.fuzzy_label(df.selectExpr("row_id", "y + 1 as y"))
