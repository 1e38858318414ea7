"""postscope: activity-log analytics and post screening on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, joins, aggregates and windows.  Nothing here contacts a live
account; the package only analyses stored tables.
"""

__version__ = "0.1.0"
