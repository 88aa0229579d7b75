"""tidemark: cost-sensitive cohort and longitudinal outcome analytics on Spark DataFrames."""

__version__ = "0.1.0"
