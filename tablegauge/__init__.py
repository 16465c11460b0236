"""Table diagnostics, cleaning, statistics, features and model evaluation as Spark jobs."""
