"""Operators: DataFrame -> DataFrame functions over batches of rows."""
