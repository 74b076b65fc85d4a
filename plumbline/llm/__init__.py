"""Training-data operators: each works on DataFrames and stands by itself.

``queries`` holds the registered queries, ``oracle`` their SQL.
"""
