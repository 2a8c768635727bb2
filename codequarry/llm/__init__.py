"""Training-data pipeline operators.

Nothing outside this package imports it.  ``registry`` lists its queries; each operator module holds
a general operator plus the thin ``opN_`` query that applies it to a whole table.
"""
