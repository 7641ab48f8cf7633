"""Table operators: DataFrame in, DataFrame out, keys given by column name."""
