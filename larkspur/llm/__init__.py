"""Operators for preparing training data. Nothing else in larkspur imports this."""
