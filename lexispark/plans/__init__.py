from .query import And, Or, Phrase, Query, Term

__all__ = ["And", "Or", "Phrase", "Query", "Term"]
