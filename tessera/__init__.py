"""A SQL analytics engine on PySpark."""
