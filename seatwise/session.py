"""Session helpers shared by the queries, the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on. Broadcast joins are left to Spark's own size check
#: (spark.sql.autoBroadcastJoinThreshold plus the runtime sizes AQE sees).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "seatwise", master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the session is given."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed over all shuffle partitions, which AQE then leaves alone.

    For steps whose work per row is out of proportion to its bytes: sized by bytes, they would be merged into a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
