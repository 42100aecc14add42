"""Search terms as Column builders (no query-string grammar).

A term knows (a) its predicate over the folded text column and (b) the phrases that count for
ranking and highlighting. Every phrase is a case-insensitive substring of at least three code
points; shorter phrases match nothing, as with a trigram index.

    phrase("needle")                  contiguous substring
    all_of(a, b, ...)                 AND
    any_of(a, b, ...)                 OR
    but_not(a, b)                     a AND NOT b
    near(a, b, distance=10)           both, start of the later within ``distance`` trigram tokens
                                      of the end of the earlier (order free)
    starts_with(a)                    phrase at the very start of the text
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound, running_sums
from .text import fold_literal, fold_text, quote_regex

MIN_PHRASE = 3


class Term:
    def predicate(self, folded: Column) -> Column:
        raise NotImplementedError

    def phrases(self) -> list[str]:
        """Phrases in query order (duplicates kept: each is a separate phrase for ranking)."""
        raise NotImplementedError

    def positive_phrases(self) -> list[str]:
        return self.phrases()

    def __and__(self, other: "Term") -> "Term":
        return AllOf((self, other))

    def __or__(self, other: "Term") -> "Term":
        return AnyOf((self, other))

    def __sub__(self, other: "Term") -> "Term":
        return ButNot(self, other)


@dataclass(frozen=True)
class Phrase(Term):
    text: str

    def predicate(self, folded: Column) -> Column:
        if len(self.text) < MIN_PHRASE:
            return F.lit(False)
        return F.contains(folded, fold_literal(self.text))

    def phrases(self) -> list[str]:
        return [self.text]


@dataclass(frozen=True)
class AllOf(Term):
    terms: tuple

    def predicate(self, folded: Column) -> Column:
        out = self.terms[0].predicate(folded)
        for t in self.terms[1:]:
            out = out & t.predicate(folded)
        return out

    def phrases(self) -> list[str]:
        return [p for t in self.terms for p in t.phrases()]

    def positive_phrases(self) -> list[str]:
        return [p for t in self.terms for p in t.positive_phrases()]


@dataclass(frozen=True)
class AnyOf(Term):
    terms: tuple

    def predicate(self, folded: Column) -> Column:
        out = self.terms[0].predicate(folded)
        for t in self.terms[1:]:
            out = out | t.predicate(folded)
        return out

    def phrases(self) -> list[str]:
        return [p for t in self.terms for p in t.phrases()]

    def positive_phrases(self) -> list[str]:
        return [p for t in self.terms for p in t.positive_phrases()]


@dataclass(frozen=True)
class ButNot(Term):
    keep: Term
    drop: Term

    def predicate(self, folded: Column) -> Column:
        return self.keep.predicate(folded) & ~self.drop.predicate(folded)

    def phrases(self) -> list[str]:
        return self.keep.phrases() + self.drop.phrases()

    def positive_phrases(self) -> list[str]:
        return self.keep.positive_phrases()


@dataclass(frozen=True)
class Near(Term):
    first: str
    second: str
    distance: int = 10

    def regex(self) -> str:
        """Lookahead regex over the folded text (Java): one scan, no position arrays.

        With start offsets pa, pb and token lengths ta = len(a) - 2, tb = len(b) - 2 the condition is
        ``-(distance + tb) <= pb - pa <= distance + ta``.
        """
        a, b = fold_text(self.first), fold_text(self.second)
        ka = self.distance + len(a) - 2
        kb = self.distance + len(b) - 2
        qa, qb = quote_regex(a), quote_regex(b)
        parts = []
        if ka >= 0:
            parts.append(f"(?={qa})(?=(?s:.){{0,{ka}}}{qb})")
        if kb >= 0:
            parts.append(f"(?={qb})(?=(?s:.){{0,{kb}}}{qa})")
        return "|".join(parts) if parts else "(?!)"

    def predicate(self, folded: Column) -> Column:
        if min(len(self.first), len(self.second)) < MIN_PHRASE:
            return F.lit(False)
        return (
            F.contains(folded, fold_literal(self.first))
            & F.contains(folded, fold_literal(self.second))
            & folded.rlike(self.regex())
        )

    def phrases(self) -> list[str]:
        return [self.first, self.second]


@dataclass(frozen=True)
class StartsWith(Term):
    text: str

    def predicate(self, folded: Column) -> Column:
        if len(self.text) < MIN_PHRASE:
            return F.lit(False)
        return F.startswith(folded, fold_literal(self.text))

    def phrases(self) -> list[str]:
        return [self.text]


def phrase(text: str) -> Term:
    return Phrase(text)


def simple_phrase(*words: str) -> Term:
    """The ``simple`` kind: all words joined by one space into one literal phrase.

    The reference escapes ``*`` inside a quoted string, where the backslash stays literal, and lets a
    ``"`` end the phrase; here both characters are searched literally.
    """
    return Phrase(" ".join(words))


def _as_term(t) -> Term:
    return Phrase(t) if isinstance(t, str) else t


def all_of(*terms) -> Term:
    return AllOf(tuple(_as_term(t) for t in terms))


def any_of(*terms) -> Term:
    return AnyOf(tuple(_as_term(t) for t in terms))


def but_not(keep, drop) -> Term:
    return ButNot(_as_term(keep), _as_term(drop))


def near(first: str, second: str, distance: int = 10) -> Term:
    return Near(first, second, distance)


def starts_with(text: str) -> Term:
    return StartsWith(text)


def can_self_overlap(p: str) -> bool:
    """True when a proper prefix of ``p`` equals a suffix (two hits can overlap)."""
    return any(p[:k] == p[-k:] for k in range(1, len(p)))


def shortest_shift(p: str) -> int:
    """The smallest distance between two hits of ``p``."""
    return next(k for k in range(1, len(p) + 1) if p[k:] == p[:len(p) - k])


def hit_positions(folded: Column, phrase_text: str) -> Column:
    """0-based start of every occurrence of a phrase, overlapping ones included, in order.

    The text is cut before every occurrence; the lengths of the pieces add up to the positions.
    """
    pieces = F.split(folded, "(?=" + quote_regex(fold_text(phrase_text)) + ")")
    none = F.array().cast("array<int>")
    head = F.when(F.startswith(folded, fold_literal(phrase_text)), F.array(F.lit(0))).otherwise(none)
    # the last piece runs to the end of the text, so the sum behind it is no start
    return bound(running_sums(F.transform(pieces, lambda x: F.length(x))), lambda starts: F.concat(
        head, F.slice(starts, 2, F.greatest(F.size(starts) - 2, F.lit(0)))))


def count_hits(folded: Column, phrase_text: str) -> Column:
    """Occurrences of a phrase, overlapping ones included (every start position counts).

    Phrases that cannot overlap themselves use a replace-and-measure count, which is much cheaper
    than a regex scan; the others count lookahead matches.
    """
    if len(phrase_text) < MIN_PHRASE:
        return F.lit(0)
    lp = fold_literal(phrase_text)
    if not can_self_overlap(fold_text(phrase_text)):
        return ((F.length(folded) - F.length(F.replace(folded, lp, F.lit("")))) / F.length(lp)).cast("int")
    return F.regexp_count(folded, F.lit("(?=" + quote_regex(fold_text(phrase_text)) + ")")).cast("int")
