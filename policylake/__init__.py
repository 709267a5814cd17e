"""policylake: privacy-policy crawl analytics as PySpark DataFrame plans."""

__version__ = "0.1.0"
