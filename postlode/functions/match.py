"""The full-text query language, compiled to Column predicates over folded text.

Query -> tokens -> tree -> Column. Phrases become look-around regular expressions behind a cheap
``contains``; NEAR groups of several phrases use positions in the token array. A query that doesn't
parse raises MatchSyntaxError; ``compiled`` then retries with every word quoted.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArchiveError
from .text import GAP, WORD, fold_text, tokens
from .values import quoted


class MatchSyntaxError(ValueError):
    pass


@dataclass
class Phrase:
    """Terms in a row, each exact or a prefix; ``first``: at the start of a column."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    first: bool = False


@dataclass
class Near:
    phrases: list[Phrase]
    distance: int = 10
    columns: tuple[str, ...] | None = None


@dataclass
class Op:
    kind: str  # AND, OR, NOT
    left: object
    right: object


class Nothing:
    """An empty phrase: matches no row."""


_TOKEN = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<open>")|(?P<bare>[A-Za-z0-9_\x1a\x80-\U0010ffff]+)|(?P<sign>[(){}:,+*^-])|(?P<bad>\S))')


def _lex(query: str) -> list[tuple[str, str]]:
    out, at, n = [], 0, len(query.rstrip(" \t\r\n"))
    while at < n:
        m = _TOKEN.match(query, at)
        if m is None:
            break
        kind, at = m.lastgroup, m.end()
        if kind == "open":
            raise MatchSyntaxError("unterminated string")
        if kind == "bad":
            raise MatchSyntaxError(f'syntax error near "{m[kind]}"')
        if kind == "string":
            out.append(("str", m[kind][1:-1].replace('""', '"')))
        elif kind == "bare":
            word = m[kind]
            out.append((word, word) if word in ("AND", "OR", "NOT") else ("str", word))
        else:
            out.append((m[kind], m[kind]))
    return [*out, ("end", "")]


def words(text: str) -> list[str]:
    """Terms of a text, as the index has them."""
    out, current = [], []
    for c in fold_text(text):
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            current.append(c)
        elif current:
            out.append("".join(current))
            current = []
    return [*out, "".join(current)] if current else out


class _Parser:
    def __init__(self, query: str, columns: tuple[str, ...]):
        self.tokens, self.at, self.columns = _lex(query), 0, columns

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][0]

    def take(self, kind: str | None = None) -> str:
        k, v = self.tokens[self.at]
        if kind and k != kind:
            raise MatchSyntaxError(f'syntax error near "{v}"')
        self.at += 1
        return v

    def parse(self):
        tree = self.expression(0)
        if self.peek() != "end":
            self.take("end")
        return tree

    def expression(self, level: int):
        """Levels bind tighter: OR, AND, NOT; all from left to right."""
        if level == 3:
            return self.primary()
        left = self.expression(level + 1)
        kind = ("OR", "AND", "NOT")[level]
        while self.peek() == kind:
            self.take()
            left = Op(kind, left, self.expression(level + 1))
        return left

    def primary(self):
        if self.peek() == "(":
            self.take()
            tree = self.expression(0)
            self.take(")")
            return tree
        columns = self.column_filter()
        if columns is not None and self.peek() == "(":
            self.take()
            tree = self.expression(0)
            self.take(")")
            return _restricted(tree, columns)
        return self.implicit_and(columns)

    def column_filter(self) -> tuple[str, ...] | None:
        """A column set and its colon, if one stands here."""
        minus = self.peek() == "-"
        k = 1 if minus else 0
        if self.peek(k) == "{":
            self.at += k + 1
            names = [self.take("str")]
            while self.peek() != "}":
                names.append(self.take("str"))
            self.take("}")
        elif self.peek(k) == "str" and self.peek(k + 1) == ":":
            self.at += k
            names = [self.take("str")]
        elif minus:
            self.take()
            names = [self.take("str")]
        else:
            return None
        self.take(":")
        known = {c.lower(): c for c in self.columns}
        for n in names:
            if n.lower() not in known:
                raise MatchSyntaxError(f"no such column: {n}")
        chosen = {known[n.lower()] for n in names}
        return tuple(c for c in self.columns if (c in chosen) != minus)

    def implicit_and(self, columns):
        left = self.near_set(columns)
        while self.peek() in ("str", "^", "{", "-"):
            right = self.near_set(self.column_filter())
            # an empty phrase among terms is passed over
            if isinstance(right, Nothing):
                continue
            left = right if isinstance(left, Nothing) else Op("AND", left, right)
        return left

    def near_set(self, columns):
        first = False
        if self.peek() == "^":
            self.take()
            first = True
        if self.peek() == "str" and self.peek(1) == "(" and not first:
            name = self.take()
            if name != "NEAR":
                raise MatchSyntaxError(f'syntax error near "{name}"')
            self.take("(")
            phrases = [self.phrase()]
            while self.peek() == "str":
                phrases.append(self.phrase())
            distance = 10
            if self.peek() == ",":
                self.take()
                value = self.take("str")
                if not re.fullmatch("[0-9]+", value):
                    raise MatchSyntaxError(f'expected integer, got "{value}"')
                distance = int(value)
            self.take(")")
            phrases = [p for p in phrases if p.terms]
            return Near(phrases, distance, columns) if phrases else Nothing()
        p = self.phrase()
        p.first = first
        return Near([p], 10, columns) if p.terms else Nothing()

    def phrase(self) -> Phrase:
        p = Phrase()
        while True:
            terms = [(t, False) for t in words(self.take("str"))]
            star = self.peek() == "*"
            if star:
                self.take()
            p.terms += terms
            if star and p.terms:
                p.terms[-1] = (p.terms[-1][0], True)
            if self.peek() != "+":
                return p
            self.take()


def _restricted(tree, columns: tuple[str, ...]):
    if isinstance(tree, Near):
        tree.columns = columns if tree.columns is None else tuple(c for c in tree.columns if c in columns)
    elif isinstance(tree, Op):
        _restricted(tree.left, columns)
        _restricted(tree.right, columns)
    return tree


def parsed(query: str, columns: tuple[str, ...]):
    return _Parser(query, columns).parse()


def _pattern(p: Phrase) -> str:
    body = f"{GAP}+".join(re.escape(t) + (f"{WORD}*" if prefix else "") for t, prefix in p.terms)
    begin = f"^{GAP}*" if p.first else f"(?<!{WORD})"
    return f"{begin}{body}(?!{WORD})"


def _phrase(text: Column, p: Phrase) -> Column:
    rarest = max((t for t, _ in p.terms), key=len)
    return text.contains(rarest) & text.rlike(_pattern(p))


def _near(text: Column, n: Near) -> Column:
    """All phrases with at most ``distance`` terms from the end of each to the start of the last."""
    cheap = F.lit(True)
    for p in n.phrases:
        cheap &= text.contains(max((t for t, _ in p.terms), key=len))
    single = [p.terms[0] for p in n.phrases if len(p.terms) == 1]
    if len(n.phrases) == 2 and len(single) == 2 and single[0] != single[1] and not any(prefix for _, prefix in single):
        x, y = (re.escape(t) for t, _ in single)
        between = f"(?:{GAP}+{WORD}+){{0,{n.distance}}}{GAP}+"
        return cheap & text.rlike(f"(?<!{WORD})(?:{x}{between}{y}|{y}{between}{x})(?!{WORD})")

    # what a lambda takes as its variable is evaluated once; so the tokens and places are elements of arrays of one
    def starts(all_tokens: Column, p: Phrase) -> Column:
        def here(i: Column) -> Column:
            ok = F.lit(True)
            for k, (t, prefix) in enumerate(p.terms):
                word = F.coalesce(F.get(all_tokens, i + k), F.lit(""))
                ok &= word.startswith(t) if prefix else word == t
            return ok

        return F.filter(F.sequence(F.lit(0), F.size(all_tokens) - 1), here)

    def clump(places: Column) -> Column:
        def last_at(m: Column) -> Column:
            ok = F.lit(True)
            for k, p in enumerate(n.phrases):
                ok &= _exists_between(F.get(places, F.lit(k)), m, len(p.terms) + n.distance)
            return ok

        return F.exists(F.flatten(places), last_at)

    def in_tokens(t: Column) -> Column:
        return (F.size(t) > 0) & F.exists(F.array(F.array(*[starts(t, p) for p in n.phrases])), clump)

    # exists() passes over rows that the cheap test rules out
    return F.exists(F.when(cheap, F.array(tokens(text))).otherwise(F.array().cast("array<array<string>>")), in_tokens)


def _exists_between(places: Column, m: Column, reach: int) -> Column:
    return F.exists(places, lambda s: (s <= m) & (s >= m - F.lit(reach)))


def _column(tree, text: dict[str, Column]) -> Column:
    if isinstance(tree, Nothing):
        return F.lit(False)
    if isinstance(tree, Op):
        left, right = _column(tree.left, text), _column(tree.right, text)
        return left & right if tree.kind == "AND" else left | right if tree.kind == "OR" else left & ~right
    out = F.lit(False)
    for name in tree.columns if tree.columns is not None else text:
        c = text[name]
        out |= _phrase(c, tree.phrases[0]) if len(tree.phrases) == 1 else _near(c, tree)
    return out


def predicate(query: str, text: dict[str, Column]) -> Column:
    """The query over folded, non-null columns by name; MatchSyntaxError if it doesn't parse."""
    return _column(parsed(query, tuple(text)), text)


def interpreted(query: str, columns: tuple[str, ...]):
    """(tree, query as interpreted): a query that doesn't parse is read as quoted words."""
    if not query.strip():
        raise ArchiveError("empty_query", "The query is empty.")
    try:
        return parsed(query, columns), query
    except MatchSyntaxError:
        again = quoted(query)
        try:
            return parsed(again, columns), again
        except MatchSyntaxError as e:
            raise ArchiveError("invalid_query", f"Unusable query: {e}") from e


def compiled(query: str, text: dict[str, Column]) -> tuple[Column, str]:
    """(predicate over folded, non-null columns by name, query as interpreted)."""
    tree, used = interpreted(query, tuple(text))
    return _column(tree, text), used
