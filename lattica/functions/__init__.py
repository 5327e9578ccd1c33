"""Linear algebra, vectors and evaluation over DataFrames."""
