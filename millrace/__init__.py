"""Millrace: data preparation and model evaluation as Spark jobs.

Every operator takes a DataFrame and returns a DataFrame.  Label and features
stay in one table, row order is always an explicit column, and statistics reach
the rows as one-row scalar subqueries.
"""

__version__ = "0.1.0"
