"""The query language: a term, a conjunction or disjunction of terms, an exact phrase."""

from __future__ import annotations

from dataclasses import dataclass


def _check_terms(kind: str, terms: tuple[str, ...]) -> None:
    if not terms:
        raise ValueError(f"{kind} needs at least one term")
    for t in terms:
        if isinstance(t, (And, Or, Phrase)):
            raise ValueError(f"{kind} takes terms only, not a nested {type(t).__name__.lower()}")
        if not isinstance(t, str) or not t:
            raise ValueError(f"{kind} has an empty term")


def _flat(clauses: tuple) -> tuple:
    return tuple(c.text if isinstance(c, Term) else c for c in clauses)


@dataclass(frozen=True)
class Term:
    """Documents with the term.  Terms are taken as they are; only texts are normalised."""

    text: str

    def __post_init__(self):
        _check_terms("a term query", (self.text,))

    @property
    def terms(self) -> tuple[str, ...]:
        return (self.text,)


class _Clauses:
    terms: tuple[str, ...]

    def __init__(self, *clauses):
        terms = _flat(clauses)
        _check_terms(type(self).__name__.lower(), terms)
        object.__setattr__(self, "terms", terms)


@dataclass(frozen=True, init=False)
class And(_Clauses):
    """Documents with every term; a term given twice counts twice in the score."""

    terms: tuple[str, ...]


@dataclass(frozen=True, init=False)
class Or(_Clauses):
    """Documents with any of the terms; a term given twice counts twice in the score."""

    terms: tuple[str, ...]


@dataclass(frozen=True, init=False)
class Phrase(_Clauses):
    """Documents with the terms side by side, in this order."""

    terms: tuple[str, ...]


Query = Term | And | Or | Phrase
