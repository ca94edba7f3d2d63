"""Compare two versions of the same data - paged text reports, keyed rows, any
two DataFrames - with Spark.

Everything is DataFrame in, DataFrame out.  Order is kept in an explicit integer
position column, and every "walk down the lines" rule is a running aggregate
(``operators.scan``) that works in bounded slices of that position, so no file,
key or user has to fit in one task.
"""
