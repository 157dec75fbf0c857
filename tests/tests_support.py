"""Series that several test modules use."""

import numpy as np
from pyspark.sql import functions as F


def series(spark, n=400, assets=2, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"a{k}", t, float(x)) for k in range(assets) for t, x in enumerate(rng.standard_normal(n) * 0.01)]
    d = spark.createDataFrame(rows, "asset string, t int, r double")
    return d.select("asset", F.date_add(F.lit("2020-01-01"), F.col("t")).alias("date"), "r", F.col("t").cast("long").alias("pos"))
