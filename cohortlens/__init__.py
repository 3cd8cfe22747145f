"""cohortlens: cohort building and classifier evaluation on Spark DataFrames."""
