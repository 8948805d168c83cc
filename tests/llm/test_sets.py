"""Sets of op5 are compared row by row, so that no batch holds thousands of long ones."""

import numpy as np

from serpflow.llm import op5_jaccard_join as op5


def test_sets_are_rows_of_numbers(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "A b c d e"), (3, "f g"), (4, None)], "doc_id long, text string")
    classes = op5.shingled(docs, 3).filter("cls is not null").select("cls").distinct()
    known = op5.WordHash()
    want = {tuple(op5.shingle_set(t, 3, known).view(np.int64).tolist()) for t in ("a b c d e", "f g")}
    assert {tuple(r["set"]) for r in op5.sets_of(docs, 3, classes).collect()} == want
