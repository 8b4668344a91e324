"""Film-rating analytics and table-quality operators as Spark DataFrame plans."""

__version__ = "0.1.0"
