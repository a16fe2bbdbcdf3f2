"""Counts of characters in texts, and searches whose copies go to more tasks."""

import random
import re

from foldcurve.operators import neighbors
from foldcurve.plans import model_queries


def test_text_counts_are_those_of_their_patterns_and_copy_no_text_per_match(spark, tmp_path):
    draw = random.Random(3)
    texts = ["".join(draw.choice("aZ09 .#\n\té你\U0001f600\x00") for _ in range(draw.randrange(60))) for _ in range(80)] + ["", " ", "\n\n", "#" * 5000, "é", None]
    spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = model_queries.document_rows(spark, str(tmp_path))
    assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {r.row_id: r for r in rows.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].n_lines is got[i].capitals is got[i].digits is got[i].marks is None
            continue
        n = max(len(t), 1)
        assert got[i].n_lines == t.count("\n") + 1
        assert (got[i].digits, got[i].capitals, got[i].marks) == tuple(len(re.findall(p, t)) / n for p in ("[0-9]", "[A-Z]", "[^A-Za-z0-9 ]"))


def test_copies_of_searched_rows_go_to_more_tasks(spark, monkeypatch):
    draw = random.Random(4)
    rows = spark.createDataFrame([(i, i % 2, [draw.gauss(0, 1) for _ in range(6)]) for i in range(300)], "row_id long, y int, features array<double>")

    def found():
        return sorted((r.row_id, r.rank, r.neighbor, r.distance) for r in near.collect())

    near = neighbors.nearest_neighbors(rows, rows, 3, n_pivots=12, block=16)
    want, few = found(), near.rdd.getNumPartitions()
    monkeypatch.setattr(neighbors, "TASK_ROWS", 100)
    near = neighbors.nearest_neighbors(rows, rows, 3, n_pivots=12, block=16)
    assert found() == want
    assert near.rdd.getNumPartitions() > max(few, 8)
