from pyspark.sql import functions as F

from seamfinder.operators import spans


def test_limits_and_skipped_rows(spark):
    df = spark.range(2500).select(F.concat(F.lit("p"), "id").alias("path"), F.col("id").alias("bytes"), F.lit(1).alias("tokens"))
    paths = lambda x: {r.path for r in x.collect()}
    all_of, order = paths(df), ["bytes", "path"]
    for limits, n in (({"max_bytes": 45}, 10), ({"max_results": 1200}, 1200), ({"max_tokens": 2000}, 2000), ({"max_tokens": 0}, 0), ({"max_results": 3000}, 2500)):
        kept = paths(spans.limited(df, order, **limits))
        assert kept == {f"p{i}" for i in range(n)}
        skipped = spans.limited(df, order, **limits, skipped=True)
        assert paths(skipped) == all_of - kept and skipped.count() == 2500 - n
