"""Table-level operators: every one takes and returns DataFrames."""
