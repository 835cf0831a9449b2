"""quillscope — estimate whether source files were written by a person or
generated by a model, as Spark DataFrame jobs (batch and streaming)."""

from .functions.language import detect_language
from .plans.detect import chunk_results, detect, explode_chunks, route

__all__ = ["detect", "detect_language", "chunk_results", "explode_chunks", "route"]
