"""Operators of a training-data pipeline: one module per operator, general in their
interface; `queries.py` applies each to its whole table. Nothing else imports this package."""
