"""Everything callable from ``spark.sql`` in one call."""

from pyspark.sql import SparkSession

from seqloom.functions import catalog, table_functions


def register_functions(spark: SparkSession) -> list[str]:
    from seqloom.operators.complexity import lz76

    names = catalog.register(spark)
    spark.udf.register("lz76_complexity", lz76)
    return sorted([*names, "lz76_complexity", *table_functions.register(spark)])
