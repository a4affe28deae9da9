"""Compositions of operators: the data binding, the ladder, reports and figures."""
