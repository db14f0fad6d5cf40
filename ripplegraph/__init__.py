"""Change-impact analytics over code repositories, expressed as Spark DataFrames."""
