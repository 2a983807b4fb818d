"""Relational, ranking, evidence and reporting operators (DataFrame in, DataFrame out)."""
