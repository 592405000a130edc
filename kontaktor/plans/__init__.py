"""Registered queries, whole pipelines and the command line."""
