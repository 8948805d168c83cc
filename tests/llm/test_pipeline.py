"""Each stage of the pipeline against its operator's own verdicts."""

import corpus_pipeline as cp
from serpflow.llm import op5_jaccard_join
from serpflow.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents").selectExpr("*", "doc_id as Score_2")
    columns, labels = docs.columns, read(spark, SF, "labels").toPandas().set_index("doc_id")
    kept = [docs]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, kept[-1], SF).cache()
        assert out.columns == columns
        kept.append(out)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3]
    clean = {i for i in labels.index if labels.toxic[i] == 0 and labels.quality[i] == 1}
    assert len(clean & ids[2]) >= 0.97 * len(clean)
    classes = op5_jaccard_join.jaccard_classes(kept[2], k=5, num=80, den=100)
    assert ids[3] == {r["component_id"] for r in classes.collect()}
    last = cp.STAGES[-1][1](spark, kept[4], SF)
    n = kept[4].count()
    assert last.filter("piece = 0").count() == n > 0
