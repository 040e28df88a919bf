"""Training-data operators: one module per operator, each usable on its own."""
