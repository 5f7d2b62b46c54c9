"""Change records for tests."""

from pyspark.sql import functions as F


def rows(spark, made):
    df = spark.createDataFrame(made, "entity string, fields map<string,string>, cleared array<string>, at long, observation string, delivery_key string, arrival long")
    return df.withColumn("order", F.struct(F.col("at").alias("observed_at"), F.lit(-1).cast("long").alias("sequence"), F.col("observation").alias("observation_id"))).drop("at", "observation")
