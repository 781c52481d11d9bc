"""Feature tables, training, evaluation and scoring with Spark ML."""
