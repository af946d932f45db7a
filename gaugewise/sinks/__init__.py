"""Writers of results: tables by Spark, and text and pages of single stations."""
