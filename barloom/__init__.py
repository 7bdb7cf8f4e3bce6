"""barloom: end-of-day and intraday equity market analytics as Spark jobs."""
