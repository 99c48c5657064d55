"""Column functions, each a built-in expression, and the seams where a model can be put in."""
