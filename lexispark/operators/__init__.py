from .search import Searcher
from .tables import Index, build_index

__all__ = ["Index", "Searcher", "build_index"]
