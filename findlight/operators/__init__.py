"""Search, ranking, vectors and mutations over DataFrames."""
