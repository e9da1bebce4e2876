"""annolith: curation and evaluation of annotated datasets, expressed as Spark DataFrames."""
