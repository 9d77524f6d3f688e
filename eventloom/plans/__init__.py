"""From the resolved model to Spark columns."""
