from pyspark.sql import functions as F

from wearline.session import cut, measured_joins, parameter_table


def test_a_well_packed_table_is_not_broadcast_by_its_file_size(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before, limit = {n: spark.conf.get(n, None) for n in names}, spark.conf.get(names[0])
    try:
        rows = spark.range(20_000).select(F.col("id").alias("k"), *[F.lit(0.0).alias(f"v{i}") for i in range(50)])
        table = cut(rows)  # 8 MB of rows in a few kB of Parquet
        measured_joins(spark)
        measured_joins(spark)
        plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan(rows.join(table, "k"))
        few = parameter_table(spark, [(1, 2.0)], "k bigint, w double")
        assert "BroadcastHashJoin" in plan(rows.join(few, "k"))
        assert spark.conf.get(names[1]) == (before[names[1]] or limit)
        assert rows.join(table.select("k"), "k").count() == 20_000
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
