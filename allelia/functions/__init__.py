"""Special functions as SQL expressions and as numpy code."""
