"""Whole analyses: read parameters, run the operators, write the result tables of one task."""
