"""Site-check analytics as Spark DataFrame operators."""
