"""Cell expressions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabloom.functions.cells import round_exact


def test_round_exact_is_python_round(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.arange(2000) / 1000 + 74, rng.uniform(-100, 100, 500), [0.125, 2.5, -0.125, 74.975, 1.005]])
    got = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", round_exact(F.col("x"), 2).alias("r")).toPandas()
    assert all(r == round(v, 2) for v, r in zip(got["x"], got["r"]))
