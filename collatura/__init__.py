"""Compare two versions of a text word by word, on Spark, and decide which differences are real."""
