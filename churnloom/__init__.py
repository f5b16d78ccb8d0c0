"""churnloom: customer analytics as Spark DataFrame jobs."""

__version__ = "1.0.0"
