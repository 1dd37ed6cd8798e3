"""tessera: numeric, sparse, graph and statistics operators as PySpark DataFrame plans."""

__version__ = "0.1.0"
