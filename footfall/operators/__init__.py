"""Analyses as functions from DataFrames to a DataFrame. None of them runs a job by itself."""
