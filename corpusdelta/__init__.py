"""corpusdelta: comparative corpus analytics on Spark DataFrames.

Every public operator takes DataFrames (plus keyword parameters) and
returns a DataFrame; nothing is collected unless the result is provably
small (a handful of corpus totals, a d x d matrix, fitted coefficients).
"""

__version__ = "0.1.0"
