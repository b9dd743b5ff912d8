"""darkroom: photo-archive and training-data analytics expressed as Spark plans."""

__version__ = "0.1.0"
