"""Index, intersection and codec operators."""
