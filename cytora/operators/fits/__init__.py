"""Model fits: sums in Spark, small problems in numpy."""
