"""Training-data operators. Nothing outside this folder imports it.

Every operator takes DataFrames and column names, projects the columns it needs and
ignores the rest, so extra columns whose names clash with its own do no harm.
"""
