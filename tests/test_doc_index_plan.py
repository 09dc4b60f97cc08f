from payscope.plans.documents import doc_index
from payscope.sources.adapters import table


def test_postings_are_shuffled_once(spark):
    """Postings and their frequencies come from one exchange: texts are read and cut into words once."""
    index = doc_index(table(spark, "/root/testdata/sf0.001", "documents"), "doc_id", "text")
    assert index.where("df < 1 or tf < 1").count() == 0
    index = index.select("term", "doc_id", "tf", "df")
    index.collect()
    final = index._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final
