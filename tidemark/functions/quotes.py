"""Many quotes in one text: found in one pass, marked in another."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = "array<struct<piece: string, nth: int>>"


def first_places(text: str, quotes: list[str]) -> list[tuple[int, int]]:
    """(at, nth) of the quotes' first places in the text, by place and then order; an automaton of all quotes reads the text once."""
    import ahocorasick

    machine, found = ahocorasick.Automaton(), {}
    for q in filter(None, quotes):
        machine.add_word(q, q)
    if len(machine):
        machine.make_automaton()
        wanted = len(machine)
        for end, q in machine.iter(text):
            if q not in found:
                found[q] = end + 1 - len(q)
                if len(found) == wanted:
                    break
    found[""] = 0
    return sorted((found[q], nth) for nth, q in enumerate(quotes) if q is not None and q in found)


def pieces(text: str, quotes: list[str]) -> list[tuple[str, int | None]]:
    """The text cut at the quotes, the first of overlapping ones staying; what is between them has no number."""
    out, cursor = [], 0
    for at, nth in first_places(text, quotes):
        if at < cursor:
            continue
        if at > cursor:
            out.append((text[cursor:at], None))
        out.append((quotes[nth], nth))
        cursor = at + len(quotes[nth])
    if cursor < len(text):
        out.append((text[cursor:], None))
    return out


def marked_pieces_of(text: Column, quotes: Column) -> Column:
    """(piece, nth) as ``text.marked_pieces`` gives them for texts and lists that are there, in time that grows with the text and the quotes together; null for a null text or list.

    That function searches the text once for each quote and copies what it has at each; use it for a few quotes.
    """
    cut, kind = pieces, pa.list_(pa.struct([("piece", pa.string()), ("nth", pa.int32())]))

    @F.arrow_udf(PIECE)
    def marked(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows: Iterable = zip(texts, lists)
        return pa.array([None if not t.is_valid or not q.is_valid else [{"piece": p, "nth": n} for p, n in cut(t.as_py(), q.as_py())] for t, q in rows], kind)

    return marked(text, quotes)
