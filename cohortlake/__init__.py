"""Spark jobs for mutation cohorts: reshape, encode, mutate, featurise, summarise."""
