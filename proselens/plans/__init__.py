"""Compositions of operators: evaluation, iteration results, reports, catalogue."""
