from . import display
from .analysis import MAX_TOKEN, normalize_term, tokenize, tokenize_text
from .scoring import average_length, bm25, decoded_length, idf, length_norm, norm_inverse, quantized_length

__all__ = ["MAX_TOKEN", "average_length", "bm25", "decoded_length", "display", "idf", "length_norm", "norm_inverse", "normalize_term", "quantized_length", "tokenize", "tokenize_text"]
