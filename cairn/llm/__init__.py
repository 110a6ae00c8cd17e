"""Training-data operators: ten operators, their registered queries and their SQL.

Nothing outside this package imports it.
"""
