from .store import IndexFormatError, open_index, save_index
from .text import generated_corpus, generated_word, number_rows, query_file, tsv_corpus

__all__ = ["IndexFormatError", "generated_corpus", "generated_word", "number_rows", "open_index", "query_file", "save_index", "tsv_corpus"]
