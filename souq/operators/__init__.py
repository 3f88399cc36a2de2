"""Marketplace operators: DataFrame in, DataFrame out."""
