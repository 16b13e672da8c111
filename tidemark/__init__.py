"""Customer analytics on Spark: clean, derive, check, stream, train and score.

Every stage is a ``DataFrame -> DataFrame`` function, so batch jobs, streams and
tests share the same code and Catalyst sees the whole plan.
"""

__version__ = "0.1.0"
