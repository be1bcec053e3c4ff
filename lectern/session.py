"""A session with the settings that the operators expect."""

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and skew-join splitting on. On a cluster leave shuffle_partitions to the cluster's own setting."""
    b = SparkSession.builder.appName("lectern")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"} | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        b = b.config(k, v)
    return (b.master(master) if master else b).getOrCreate()
