"""A code-intelligence graph engine on PySpark."""
