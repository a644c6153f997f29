"""Text functions, all built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.fixed import BADGES, CLEAR, COUNT_WORDS, OPEN, WHITE


#: White space as a character class.
_SPACE = f"[{WHITE}]+"


def trimmed(text: Column) -> Column:
    """Without white space, Unicode's too, at either end."""
    return F.btrim(text, F.lit(WHITE))


def sentences(text: Column, longer_than: int = 24) -> Column:
    """Pieces after ., ! or ? and white space, of more than so many characters; a trimmed text's pieces are trimmed."""
    return F.filter(F.split(trimmed(text), f"(?<=[.!?]){_SPACE}"), lambda s: F.length(s) > longer_than)


def word_count(text: Column) -> Column:
    """Wide white space becomes blanks first: a class of all of it takes five times as long to split by."""
    wide = "".join(c for c in WHITE if not c.isascii())
    return F.size(F.array_remove(F.split(F.translate(text, wide, " " * len(wide)), r"\s+"), ""))


def padded(n: Column, width: int = 2) -> Column:
    """Zeros up to the width; longer numbers stay whole."""
    return F.format_string(f"%0{width}d", n)


def shortened(name: Column, most: int = 22, keep: int = 20) -> Column:
    return F.when(F.length(name) > most, F.concat(F.left(name, F.lit(keep)), F.lit("…"))).otherwise(name)


def readable_size(n: Column) -> Column:
    kb, mb = F.lit(1024), F.lit(1024 * 1024)
    return F.when(n < kb, F.format_string("%d B", n)).when(n < mb, F.format_string("%d KB", F.floor(n / kb + 0.5))).otherwise(F.format_string("%s MB", (F.floor(n / mb * 10 + 0.5) / 10).cast("decimal(12,1)")))


def capitalised(label: Column) -> Column:
    return F.concat(F.left(label, F.lit(1)), F.lower(F.substring(label, 2, 1 << 30)))


def contains_any_case(field: Column, needle: str) -> Column:
    """Plain substring, so % and _ are ordinary characters."""
    return F.contains(F.lower(field), F.lit(needle.lower()))


def tone(determination: Column) -> Column:
    return F.when(determination.isin(CLEAR), "clear").when(determination.isin(OPEN), "open").otherwise("adverse")


def by_name(name: Column, ignore_case: bool = False) -> Column:
    """The name to order or compare by as people do: accents and case tell apart only what is alike without them; or not case at all."""
    return F.collate(name, "UNICODE_CI" if ignore_case else "UNICODE")


def badge(status: Column, other: str = "unsettled") -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in BADGES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.upper(status)), F.lit(other))


def count_word(n: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, COUNT_WORDS)), n.cast("int")), n.cast("string"))


def timecode(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.floor(seconds % 60))


def located(text: Column, quotes: Column) -> Column:
    """(at, nth, quote) of the quotes found, by first place and then order."""
    spots = F.transform(quotes, lambda q, i: F.struct((F.position(q, text) - 1).alias("at"), i.alias("nth"), q.alias("quote")))
    return F.array_sort(F.filter(spots, lambda s: s["at"] >= 0))


def marked_pieces(text: Column, quotes: Column) -> Column:
    """(piece, nth): the text cut at the quotes found, overlaps skipped; nth is null between quotes."""
    piece = lambda p, n: F.struct(p.alias("piece"), n.cast("int").alias("nth"))
    none = F.array().cast("array<struct<piece:string,nth:int>>")
    start = F.struct(F.lit(0).alias("cursor"), none.alias("pieces"))

    def step(s: Column, spot: Column) -> Column:
        gap = F.when(spot["at"] > s["cursor"], F.array(piece(F.substring(text, s["cursor"] + 1, spot["at"] - s["cursor"]), F.lit(None)))).otherwise(none)
        grown = F.struct((spot["at"] + F.length(spot["quote"])).alias("cursor"), F.concat(s["pieces"], gap, F.array(piece(spot["quote"], spot["nth"]))).alias("pieces"))
        return F.when(spot["at"] < s["cursor"], s).otherwise(grown)

    def rest(s: Column) -> Column:
        tail = F.when(s["cursor"] < F.length(text), F.array(piece(F.substring(text, s["cursor"] + 1, F.length(text)), F.lit(None)))).otherwise(none)
        return F.concat(s["pieces"], tail)

    return F.aggregate(located(text, quotes), start, step, rest)
