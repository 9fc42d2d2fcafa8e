"""Training-data operators. Nothing outside this package imports it.

Modules hold one operator each; ``registry`` collects their thin ``opN_`` queries and SQL.
"""
