"""Operators for building training data, their registered queries, and what they share."""
