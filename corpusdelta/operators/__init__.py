"""DataFrame-in, DataFrame-out operators of the corpus-comparison workflow."""
