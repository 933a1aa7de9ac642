"""Analytics engine for semi-structured postings on Spark: every operator is a function of DataFrames or Columns."""
