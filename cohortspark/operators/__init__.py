"""Relational, graph and statistics operators: DataFrame in, DataFrame out."""
