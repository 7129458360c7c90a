"""marginalia: retrieval, transcription and corpus analytics as PySpark plans."""

__version__ = "0.1.0"
