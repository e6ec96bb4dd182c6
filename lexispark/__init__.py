"""lexispark: corpus statistics, language models and text analytics declared as Spark plans."""

__version__ = "0.1.0"
