from pyspark.sql import functions as F


def clashing(df, *names):
    """The table with more columns, named as what operators make inside."""
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df
