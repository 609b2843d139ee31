"""Feature families, graph, cases, evaluation, quality and gates as DataFrame functions."""
