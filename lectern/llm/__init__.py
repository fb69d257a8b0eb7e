"""Training-data operators: ten self-contained DataFrame operators and their registered queries."""
