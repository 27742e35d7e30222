"""Operators of a training-data pipeline: each module holds one operator, `queries` registers them."""
