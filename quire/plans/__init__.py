"""Query plans: the search language and its compiler to Column expressions."""
