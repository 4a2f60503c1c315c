"""Movement-tracking analytics on Spark DataFrames.

Every verb maps a :class:`~trackspark.trace.Trace` (many sessions in one
DataFrame) to another one without running a job; Spark runs the plan when the
result is read.
"""
