"""Column functions that guarded statements and jobs share."""
