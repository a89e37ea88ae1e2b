"""Training-data operators: one module an operator, each with a general function and a thin ``opN_*`` query.

Nothing outside this subpackage imports it. ``registry`` lists the queries and their oracle SQL.
"""
