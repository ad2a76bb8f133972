from pyspark.sql import SparkSession

from trackloom.functions.layers import apply
from trackloom.operators import learning as le


def test_errors_that_differ_by_rounding_are_ties():
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    n = len(le.CLASSES)
    errors = [[5.0] * n, [5 + 1e-14 * (n - i) for i in range(n)], [5.0, 5.0, *[4.99] * (n - 3), 4.99 - 1e-13], [9.0, 8.0] + [8.00001] * (n - 2)]
    rows = spark.createDataFrame([(1, 1, k, *e) for k, e in enumerate(errors)], "track_id long, step long, k long, " + ", ".join(f"{m} double" for m in le.CLASSES))
    found = sorted(apply(rows, le.label()).collect(), key=lambda r: r.k)
    assert [r.label for r in found] == [0, 0, 2, 1] and [r.last_label for r in found] == [None, 0, 0, 2]
    assert [r.min_err for r in found] == [min(e) for e in errors]
