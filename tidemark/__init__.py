"""tidemark: behavioural analytics over change histories, expressed as Spark plans."""

__version__ = "0.1.0"
