"""Operators for large text corpora: one module for each operator, and their registered queries."""
