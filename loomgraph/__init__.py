"""Spark jobs that build account-tag graphs and lay them out."""
