"""pitsignal: point-in-time signal features from business notes, on Spark.

Every operator is a function from DataFrames to a DataFrame.  Nothing here holds
state between calls, and nothing is collected to the driver except small,
explicitly bounded control values (a row count, a conflict sample).
"""

__version__ = "0.1.0"
