"""Operators: DataFrame in, DataFrame out; nothing is collected, order is only made at sinks."""
