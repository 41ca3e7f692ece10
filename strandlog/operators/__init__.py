"""Resolver, questions to state, and checks, all on DataFrames."""
