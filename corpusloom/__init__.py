"""corpusloom: dataset governance, evaluation and corpus preparation on PySpark.

Every operator is a function from DataFrames to DataFrames.  Nothing here
collects rows to the driver except aggregates whose size has a stated bound.
"""

__version__ = "0.1.0"
