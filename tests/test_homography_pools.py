"""Groups whose pool has many wrong points."""

import random

from pyspark.sql import functions as F

from kickframe.operators import homography


def test_groups_of_many_wrong_points_find_their_matrix_too(spark):
    rnd, rows = random.Random(5), []
    for group in range(40):
        for i in range(120):
            x, y, wrong = rnd.uniform(0, 960), rnd.uniform(0, 540), i % 5 < 3
            rows.append((group, 1000 * group + i, x, y, x + group + wrong * rnd.uniform(80, 400), 1.1 * y - wrong * rnd.uniform(60, 150)))
    found = homography.fit(spark.createDataFrame(rows, "k int, id int, x double, y double, u double, v double"), ["k"], "id")
    got = found.select("k", "inliers", F.round(F.col("h")[2], 6).alias("moved")).collect()
    assert sorted(map(tuple, got)) == [(k, 48, float(k)) for k in range(40)]
