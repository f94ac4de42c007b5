"""Compositions of operators: the full audit, the feedback flow and the registered check queries."""
