"""Personal data by patterns and a semi-Markov conditional random field.

Base patterns (email, ip, card, phone) are found exactly as stated in ``base_spans``.  The
random field adds what they miss, such as phone numbers without a plus sign or addresses
with "(at)".  It reads *islands*: runs of words that hold a digit, an at sign or a spelt
one, with a word of context on either side.  Elsewhere no candidate segment can be personal data,
so the field's best labelling there is empty and nothing is skipped.  A run is read whole, however
long it is: time and memory are linear in its words.

Within an island every segment of up to ``MOST_WORDS`` words is a candidate of every type, scored
by features of the whole span (digit count, groups, checksum, address form, the word
before); dynamic programming over segments chooses boundaries and types jointly, and a span is added
if its marginal probability is at least ``SURE`` and no base span overlaps it.

The field has a fifth kind that no pattern finds: secrets (keys and tokens of letters and digits).  They are given on their
own, as ``secrets``, not among the spans.

The field is trained without labels at hand: base spans of at most ``TRAIN_DOCS`` documents and
altered copies of them (plus sign or at sign replaced, groups respaced) are positive, as are invented keys and tokens;
other numbers (dates, versions, amounts, failed checksums) negative, by likelihood with
forward-backward sums.

Defined results: null and empty texts have no spans.  Rows with repeated or null doc_ids are
read like any other.  An empty table gives no rows.  Positions are code points.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
FIELD_KINDS = (*KINDS, SECRET)
MOST_WORDS = 6
TRAIN_DOCS = 2_000
SURE = 0.9
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]|[\(\[][aA][tT][\)\]]")
_DIGIT = re.compile(r"[0-9]")
_BARE_AT = frozenset(["@", "(at)", "[at]"])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), each kind leftmost and non-overlapping, by start and then kind."""
    found: list[tuple[int, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m.group().count(".") >= 3:
                parts, at = m.group().split("."), m.start()
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                        found.append((at, at + size, 1))
                    at += size + 1
        for m in _CARD.finditer(text):
            d = only_digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(only_digits(m.group())) <= 15:
                    found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


# --- islands and features -------------------------------------------------------------


def islands(text: str) -> Iterator[list[tuple[int, int, bool]]]:
    """Runs of (start, end, anchor) words, with the words around; anchors hold a digit or an at sign."""
    run: list[tuple[int, int, bool]] = []
    last = 0
    for m in _ANCHOR.finditer(text):
        if m.start() < last:
            continue
        a = m.start()
        while a > last and not text[a - 1].isspace():
            a -= 1
        b, n = m.end(), len(text)
        while b < n and not text[b].isspace():
            b += 1
        if text[a:b].lower() in _BARE_AT:
            # An at sign on its own belongs with the words on either side.
            while a > last and text[a - 1].isspace():
                a -= 1
            while a > last and not text[a - 1].isspace():
                a -= 1
            while b < n and text[b].isspace():
                b += 1
            while b < n and not text[b].isspace():
                b += 1
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1].isspace():
                b -= 1
        if run and not text[run[-1][1] : a].isspace():
            yield run
            run = []
        if not run:
            e = a
            while e > last and text[e - 1].isspace():
                e -= 1
            s = e
            while s > last and not text[s - 1].isspace():
                s -= 1
            if s < e:
                run.append((s, e, False))
        run.append((a, b, True))
        last = b
    if run:
        yield run


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Without punctuation around the span."""
    while a < b and text[a] in "\"'<[{,;:=":
        a += 1
    while a < b and text[b - 1] in "\"'>]},;:.!?=":
        b -= 1
    if a < b and text[a] == "(" and ")" not in text[a:b]:
        a += 1
    if a < b and text[b - 1] == ")" and "(" not in text[a:b]:
        b -= 1
    return a, b


_AT = r"\s?(?:@|\(at\)|\[at\])\s?"
_SPELT = re.compile(rf"[a-z0-9._%+-]+{_AT}[a-z0-9-]+(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?)[a-z0-9-]+)+", re.I)
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_CALL = frozenset(["tel", "tel.", "tel:", "phone", "phone:", "call", "mobile", "mobile:", "fax", "fax:", "cell", "cell:"])


def features(span: str, before: str, words: int) -> list[str]:
    d = only_digits(span)
    letters = sum(c.isalpha() for c in span)
    groups = re.findall(r"[0-9]+", span)
    n = len(d)
    out = [
        "all",
        f"digits{n if n < 20 else 20}",
        f"words{words}",
        f"letters{min(3, letters)}",
        f"start{'+' if span[:1] == '+' else '(' if span[:1] == '(' else '9' if span[:1].isdigit() else 'a'}",
        f"groups{min(6, len(groups))}",
        "shape" + "-".join(str(min(5, len(g))) for g in groups[:6]) if letters == 0 else "lettered",
    ]
    if "=" in span or '"' in span:
        out.append("assigned")
    if words == 1 and letters and n:
        # Keys: one word of letters and digits that change about often, of so many signs.
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
        out.append(f"key{min(5, len(span) // 8)}-{min(3, 10 * turns // len(span))}" if span.replace("_", "").replace("-", "").isalnum() else "unkey")
        if _HEX.fullmatch(span):
            out.append(f"hex{min(5, len(span) // 8)}")
    if letters == 0 and 14 <= n <= 19:
        out.append("luhn" if luhn(d) else "unluhn")
    if _SPELT.fullmatch(span):
        out.append("address")
    if letters == 0 and "." in span and len(groups) == 4 and n <= 12 and re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", span):
        out.append("dotted" if all(int(g) <= 255 for g in groups) else "undotted")
    if letters == 0 and re.fullmatch(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", span):
        out.append("dial")
    if before.lower() in _CALL:
        out.append("called")
    if before[-1:] in "=:" and before:
        out.append("set")
    return out


class Field:
    """The semi-Markov field: weights by (kind, feature); words outside entities score zero."""

    def __init__(self):
        self.w: dict[tuple[str, str], float] = defaultdict(float)

    def candidates(self, text: str, run: list[tuple[int, int, bool]]):
        """(first word, last word + 1, start, end, features) of every segment of anchors."""
        for i, (a, _, anchor) in enumerate(run):
            before = text[run[i - 1][0] : run[i - 1][1]] if i else ""
            for j in range(i, min(len(run), i + MOST_WORDS)):
                if not anchor or not run[j][2]:
                    break
                s, e = trimmed(text, a, run[j][1])
                if e - s >= 5:
                    yield i, j + 1, s, e, features(text[s:e], before, j - i + 1)

    def lattice(self, text: str, run, kept: bool = True):
        """Segments by their first word; features are kept for learning only."""
        by_start = defaultdict(list)
        for i, j, s, e, f in self.candidates(text, run):
            for kind in FIELD_KINDS:
                by_start[i].append((j, s, e, kind, f if kept else None, sum(self.w.get((kind, x), 0.0) for x in f)))
        return by_start

    @staticmethod
    def sums(n: int, by_start) -> tuple[list[float], list[float]]:
        """Log sums over all labellings of the words before, and from, each place."""
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -1e300 and b > -1e300 else max(a, b)
        fore, back = [-1e301] * (n + 1), [-1e301] * (n + 1)
        fore[0] = back[n] = 0.0
        for i in range(n):
            fore[i + 1] = add(fore[i + 1], fore[i])
            for j, *_, x in by_start[i]:
                fore[j] = add(fore[j], fore[i] + x)
        for i in reversed(range(n)):
            back[i] = add(back[i], back[i + 1])
            for j, *_, x in by_start[i]:
                back[i] = add(back[i], x + back[j])
        return fore, back

    def decode(self, text: str, run) -> list[tuple[int, int, str, float]]:
        """The best labelling's entities, with their marginal probabilities."""
        n, by_start = len(run), self.lattice(text, run, False)
        best, how = [0.0] + [-1e301] * n, [None] * (n + 1)
        for i in range(n):
            if best[i] > best[i + 1]:
                best[i + 1], how[i + 1] = best[i], (i, None)
            for seg in by_start[i]:
                if best[i] + seg[5] > best[seg[0]]:
                    best[seg[0]], how[seg[0]] = best[i] + seg[5], (i, seg)
        chosen, at = [], n
        while at > 0:
            at, seg = how[at]
            if seg:
                chosen.append((at, seg))
        if not chosen:
            return []
        fore, back = self.sums(n, by_start)
        return [(s, e, kind, math.exp(min(0.0, fore[i] + x + back[j] - fore[n]))) for i, (j, s, e, kind, _, x) in reversed(chosen)]

    def learn(self, examples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-3, seed: int = 1) -> None:
        """Likelihood by stochastic gradients (Adagrad); examples are texts with their true spans."""
        rng, squares, data = random.Random(seed), defaultdict(lambda: 0.1), []
        for text, spans in examples:
            truth = {(a, b): k for a, b, k in spans}
            for run in islands(text):
                data.append((text, run, truth))
        for _ in range(epochs):
            rng.shuffle(data)
            for text, run, truth in data:
                by_start, n = self.lattice(text, run), len(run)
                fore, back = self.sums(n, by_start)
                grad: dict[tuple[str, str], float] = defaultdict(float)
                for i, segs in list(by_start.items()):
                    for j, s, e, kind, f, x in segs:
                        g = (truth.get((s, e)) == kind) - math.exp(min(0.0, fore[i] + x + back[j] - fore[n]))
                        if abs(g) > 1e-4:
                            for y in f:
                                grad[kind, y] += g
                for k, g in grad.items():
                    g -= decay * self.w[k]
                    squares[k] += g * g
                    self.w[k] += rate * g / math.sqrt(squares[k])


# --- training examples ----------------------------------------------------------------


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, good: bool) -> str:
    d = _digits(rng, 15)
    for last in "0123456789":
        if luhn(d + last) == good:
            return d + last
    raise AssertionError


def altered(kind: str, span: str, rng: random.Random) -> str:
    """The span as the patterns would miss it, or as it is."""
    if kind == "phone":
        d = only_digits(span)
        local = d[-10:]
        return rng.choice([span, f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"{d[:-10] or 1} {local[:3]} {local[3:6]} {local[6:]}"])
    if kind == "email":
        user, _, host = span.partition("@")
        return rng.choice([span, f"{user} (at) {host}", f"{user}[at]{host}", f"{user} @ {host}", f"{user}(at){host}"])
    if kind == "card":
        d = only_digits(span)
        return rng.choice([span, ". ".join(d[i : i + 4] for i in range(0, len(d), 4)), ".".join(d[i : i + 4] for i in range(0, len(d), 4)), "  ".join(d[i : i + 4] for i in range(0, len(d), 4))])
    return span


def ordinary(rng: random.Random) -> str:
    """A number, date, version or amount that is no personal data."""
    pick = rng.choice([0, 1, 2, 3, 5, 8, 9, 10, 11, 12, 13])
    if pick == 0:
        return f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
    if pick == 1:
        return ".".join(str(rng.randrange(20)) for _ in range(rng.choice([2, 3])))
    if pick == 2:
        return f"{rng.randrange(1000)},{_digits(rng, 3)}.{_digits(rng, 2)}"
    if pick == 3:
        return _card(rng, False)
    if pick == 5:
        return f"{rng.randrange(256, 999)}.{rng.randrange(999)}.{rng.randrange(999)}.{rng.randrange(999)}"
    if pick == 8:
        return _digits(rng, rng.randrange(1, 14))
    if pick == 9:
        return f"{rng.randrange(24):02d}:{rng.randrange(60):02d}"
    if pick == 10:
        return " ".join(_digits(rng, rng.randrange(1, 6)) for _ in range(rng.randrange(2, 5)))
    if pick == 11:
        return f"{_digits(rng, 3)}-{_digits(rng, rng.choice([2, 3]))}-{_digits(rng, rng.choice([1, 2, 3]))}"
    if pick == 12:
        return f"@{''.join(rng.choice('abcdefghij') for _ in range(6))}{rng.randrange(99)}"
    return f"{''.join(rng.choice('abcdefghij') for _ in range(4))}{_digits(rng, rng.randrange(1, 5))}"


def secret(rng: random.Random) -> tuple[str, str, str]:
    """(before, key, after) as keys are written."""
    of = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    base36 = "abcdefghijklmnopqrstuvwxyz0123456789"
    key = rng.choice([lambda: of("0123456789abcdef", rng.choice([24, 32, 40, 64])), lambda: of("0123456789ABCDEF", rng.choice([32, 40])), lambda: "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + of(base36, 36), lambda: "sk-" + of(base36, 40)])()
    if not _DIGIT.search(key):
        key += "7"
    before, after = rng.choice([('token = "', '"'), ("key: ", ""), ('secret = "', '"'), ("api_key = '", "'"), ("with ", ""), ('TOKEN = "', '"')])
    return before, key, after


def examples(contexts: list[tuple[str, str, str, str]], seed: int = 2, invented: int = 400) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Training texts from (before, span, after, kind) of base spans, and ordinary numbers in the same surroundings."""
    rng = random.Random(seed)
    around = [(a, c) for a, _, c, _ in contexts] or [("see ", " for more")]
    rows = [(a, s, c, k) for a, s, c, k in contexts]
    for _ in range(invented):
        a, c = rng.choice(around)
        letters = "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
        user = rng.choice([f"{letters}.{rng.randrange(99)}", f"{letters[:3]}.{letters[3:]}", letters])
        host = rng.choice([f"{letters[:4]}{rng.randrange(9)}.example.org", f"{letters[2:]}.org", "example.com"])
        rows.append((a, f"{user}@{host}", c, "email"))
        a, c = rng.choice(around)
        rows.append((a, f"+{rng.randrange(1, 99)} {_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 4)}", c, "phone"))
        a, c = rng.choice(around)
        rows.append((a, ".".join(str(rng.randrange(256)) for _ in range(4)), c, "ip"))
        a, c = rng.choice(around)
        rows.append((a, _card(rng, True), c, "card"))
        a, c = rng.choice(around)
        before, key, after = secret(rng)
        rows.append((a + before, key, after + c, SECRET))
    out = []
    for a, s, c, k in rows:
        s = altered(k, s, rng)
        out.append((a + s + c, [(len(a), len(a) + len(s), k)]))
        if k != "ip" or rng.random() < 0.5:
            a, c = rng.choice(around)
            out.append((a + ordinary(rng) + c, []))
    return out


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> Field:
    """The field for these docs: base spans of the documents with the smallest hashed ids give surroundings."""
    ship(docs.sparkSession)
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                t = t or ""
                spans = base_spans(t)
                for a, b, kind in spans[:3]:
                    left, right = re.findall(r"\S+\s+$", t[max(0, a - 40) : a]), re.findall(r"^\s+\S+", t[b : b + 40])
                    if b - a <= 80 and left and right and not _ANCHOR.search(left[0] + right[0]):
                        out.append((left[0], t[a:b], right[0], kind))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["l", "s", "r", "kind"])

    # Of rows that share an id, one: the sample is bounded whatever the ids are.
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    known = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    found = known.select("text").mapInArrow(contexts, "l string, s string, r string, kind string").toArrow()
    rows = sorted(zip(*(found[c].to_pylist() for c in ("l", "s", "r", "kind"))))
    field = Field()
    field.learn(examples(random.Random(4).sample(rows, min(len(rows), 600))))
    return field


def find(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans; all spans, base ones and what the field adds; and secrets."""
    base = base_spans(text)
    # Base spans by start, and how far those up to each reach: one that meets a span starts before its end and reaches past its start.
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    added: list[tuple[int, int, str]] = []
    for run in islands(text):
        for s, e, kind, p in field.decode(text, run):
            before = bisect.bisect_left(starts, e)
            if p >= SURE and not (before and reach[before - 1] > s):
                added.append((s, e, kind))
    spans = base + [x for x in added if x[2] != SECRET]
    return base, sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])), [x for x in added if x[2] == SECRET]


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id with base, spans and secrets, all arrays of (kind, start, end), for every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dict((field or fit(docs)).w))
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<kind: string, start: int, end: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field()
        f.w.update(shared.value)
        arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [find(t.as_py() or "", f) for t in part.column(1)]
                cols = [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in x[i]] for x in found], arrow) for i in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "base", "spans", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {span}, spans {span}, secrets {span}")


def joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str, column: str = "base"):  # of base spans, or of another column's
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("bigint")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
