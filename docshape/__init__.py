"""docshape: the implicit schema of mixed document collections, as DataFrame operators."""

__version__ = "0.1.0"
