"""Analytics of vector cohorts and preparation of training corpora, as Spark jobs."""
