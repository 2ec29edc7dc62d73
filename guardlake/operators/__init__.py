"""DataFrame-level operators: DataFrame in, DataFrame out, no actions."""
