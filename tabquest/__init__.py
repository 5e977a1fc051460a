"""Find, describe and query many tabular datasets with Spark."""
