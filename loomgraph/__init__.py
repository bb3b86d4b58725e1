"""Graph and text analytics as Spark DataFrame transformations."""
