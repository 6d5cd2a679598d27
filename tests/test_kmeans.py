"""The k-means query runs until its centres stay."""

from kickframe.operators import cluster
from kickframe.plans import analytic_queries

SF = "/root/testdata/sf0.001"


def test_centres_have_converged(spark):
    found = analytic_queries.kmeans_lloyd(spark, SF).collect()
    want = cluster.lloyd(analytic_queries._embedded(spark, SF), "feature", analytic_queries._CENTRES)
    assert [tuple(r)[1:] for r in found] == [tuple(round(v, 5) for v in c[:4]) for c in want]
