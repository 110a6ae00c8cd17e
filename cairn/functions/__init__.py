"""Scalar functions as Columns; pandas functions only where no built-in exists."""
