"""Training-data operators: one module per operator, and ``entries`` with their registered queries."""
