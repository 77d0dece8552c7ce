from pyspark.sql import SparkSession


def make_session(cpus: int = 8):
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("affinis")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
