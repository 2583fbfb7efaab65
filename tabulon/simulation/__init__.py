"""Monte-Carlo models as Spark jobs: a trial is a row of ``spark.range``, an input a column, statistics are aggregates."""
