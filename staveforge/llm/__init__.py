"""Training-data operators: ten corpus-scale components behind one table-in, table-out interface."""
