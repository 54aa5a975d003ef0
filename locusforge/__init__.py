"""PySpark-native analytics for nucleotide-resolution comparison of metagenomic samples."""

__version__ = "0.1.0"
