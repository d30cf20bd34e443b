"""Training-data operators: ten stages of a text-corpus pipeline, each a DataFrame job."""
