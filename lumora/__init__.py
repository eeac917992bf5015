"""Media-catalog analytics and text preparation on PySpark."""
