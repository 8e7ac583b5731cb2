"""Personal data: patterns for the base kinds, then bootstrapped contextual extraction.

Matches of the base kinds are seeds. A seed occurrence induces lexical patterns: the
word or two words before it, or the words on both sides, each once for any identifier
and once for identifiers of the seed's class. Spark then scores the bipartite graph of
patterns and instances in turns: a pattern by the share of its distinct instances that
are believed, an instance by the patterns that extract it. Patterns above a confidence
admit further instances, which take part in the next turn. What high-confidence patterns
extract beside the seeds is added as kind ``id``.

An instance may be any token with a digit or of a handle's form, or several tokens of
digits and separators in a row, so a context learned from one kind finds identifiers of
another form. The texts are read once, in Arrow batches; the graph holds only instances and
their contexts. No table of it goes to the driver.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, trimmed

KINDS = ("email", "ip", "card", "phone")
#: Turns of the bootstrap; a pattern needs this many believed instances, this share of
#: believed ones among all it extracts, and an instance this much belief.
TURNS, SUPPORT, CONFIDENCE, BELIEF = 3, 3.0, 0.6, 0.6

#: Characters that an instance has at least.
LEAST = 3
_SOME = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"[+(]*[0-9][0-9().,/:+-]*")
_HANDLE = re.compile(r"@[A-Za-z0-9_][A-Za-z0-9_.-]*")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a run of digits is taken whole, so a match can only start at its first digit
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?()[]{}<>\"'`|*#$%&="
_FIRM = _EDGE.replace("(", "").replace(")", "")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, place of the kind, end)`` of the base kinds, by start, then kind."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:  # the characters before an @ and the domain after it decide on their own
        a = at
        while a > last and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def form(text: str) -> str:
    """The class of an identifier: mail, number, handle, or mixed letters and digits."""
    if "@" in text[1:]:
        return "mail"
    if text.startswith("@"):
        return "handle"
    return "mixed" if any(c.isalpha() for c in text) else "number"


def _word(text: str) -> str:
    """A word of a context: without its edges, in lower case; what holds digits is left open, a long one named by its hash."""
    text = text.strip(_EDGE).lower()
    if _SOME.search(text):
        return "#"
    return text if len(text) <= 64 else hashlib.md5(text.encode()).hexdigest()


class _Contexts:
    """The words of a text, and the patterns around parts of it."""

    def __init__(self, text: str):
        self.text, self.tokens = text, [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [a for a, _ in self.tokens]
        self.words: dict[int, str] = {}

    def word(self, i: int) -> str:
        if not 0 <= i < len(self.tokens):
            return ""
        if i not in self.words:
            a, b = self.tokens[i]
            self.words[i] = _word(self.text[a:b])
        return self.words[i]

    def around(self, a: int, b: int, since: int = 0) -> list[str]:
        """The patterns of ``text[a:b]``; none where no word is before it. Of the word that it is part of, what follows ``since`` counts."""
        first, last = bisect.bisect_right(self.starts, a) - 1, bisect.bisect_left(self.starts, b) - 1
        stuck = _word(self.text[max(self.starts[first], since) : a])
        before = [self.word(i) for i in (first - 2, first - 1)] if not stuck else [self.word(first - 1), stuck]
        if not before[-1]:
            return []
        out, after = [f"{before[-1]} _"], self.word(last + 1)
        if before[0]:
            out.append(f"{' '.join(before)} _")
        if after:
            out.append(f"{before[-1]} _ {after}")
        own = form(self.text[a:b])
        return [x for p in out for x in (p, f"{p} | {own}")]


def _name(text: str) -> str:
    """What stands for an instance in the graph."""
    text = " ".join(text.lower().split())
    return text if len(text) <= 64 else hashlib.md5(text.encode()).hexdigest()


def occurrences(text: str) -> list[tuple[int, int, int, str, list[str]]]:
    """``(start, end, kind, instance, patterns)`` of base spans and, with kind -1, of other identifiers."""
    if not _SOME.search(text):
        return []
    spans, out, read, end = base_spans(text), [], _Contexts(text), 0
    for a, k, b in spans:
        out.append((a, b, k, _name(text[a:b]), read.around(a, b, min(end, a))))
        end = max(end, b)
    at, end = 0, 0
    row: list[tuple[int, int]] = []  # numbers with one blank between

    def close():
        if row:
            a, b = row[0][0], row[-1][1]
            if b - a >= LEAST:
                out.append((a, b, -1, _name(text[a:b]), read.around(a, b)))
            row.clear()

    for a, b in read.tokens:
        token = text[a:b].strip(_FIRM)
        if not (number := _NUMBER.fullmatch(token) and token.count("(") == token.count(")")):
            token = token.strip(_EDGE)
        a = text.index(token, a)
        b = a + len(token)
        while at < len(spans) and spans[at][0] < b:
            end, at = max(end, spans[at][2]), at + 1
        if end > a or not token:  # it overlaps a base span
            close()
        elif number:
            if row and text[row[-1][1] : a] != " ":
                close()
            row.append((a, b))
        else:
            close()
            if len(token) >= LEAST and (_HANDLE.fullmatch(token) or any("0" <= c <= "9" for c in token)):
                out.append((a, b, -1, _name(token), read.around(a, b)))
    close()
    return out


_FOUND = "doc_id long, row long, found array<struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>>"


def _read(batches):
    found = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
    names = ("start", "end", "kind", "instance", "patterns")
    for b in batches:
        rows = [[dict(zip(names, o)) for o in occurrences(t or "")] for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), b.column("row"), pa.array(rows, found)], ["doc_id", "row", "found"])


def bootstrap(found: DataFrame, turns: int = TURNS) -> DataFrame:
    """``pattern, kind, confidence``: the accepted patterns over ``found(instance, kind, pattern)``.

    Pairs are counted once however often they occur, so a group of copies weighs as
    one document. Aggregations are by pattern, instance and kind with partial sums.
    """
    pairs = stored(found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    size = stored(pairs.groupBy("pattern").agg(F.count("*").alias("n")))
    belief = stored(pairs.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("belief")).distinct())
    seeds, accepted = belief, None
    for _ in range(turns):
        scored = pairs.drop("kind").join(belief, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("f"))
        scored = scored.join(size, "pattern").withColumn("confidence", F.col("f") / F.col("n"))
        accepted = stored(scored.where((F.col("f") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "kind", "confidence"))
        # an instance is wrong only if all its patterns are
        miss = F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))
        drawn = pairs.where("kind < 0").drop("kind").join(accepted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(miss)).alias("belief"))
        belief = stored(seeds.unionByName(drawn.where(F.col("belief") >= BELIEF)))
    return accepted


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs(doc_id, text)``; ``spans`` has ``start, rank, kind, end``.

    Base kinds have ranks 0 to 3; ``id``, what the patterns found beside them, has 4.
    Positions count code points, ends are exclusive, spans go by start, then rank.
    Null text is empty and has none. Repeated rows stay, each with its spans; other
    columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("row"))
    found = stored(rows.mapInArrow(trimmed(_read), _FOUND))
    each = found.select("row", F.inline("found"))
    accepted = bootstrap(each.select("instance", "kind", F.explode("patterns").alias("pattern")))
    open_ = each.where("kind < 0").select("row", "start", "end", F.explode("patterns").alias("pattern")).distinct()
    new = open_.join(accepted, "pattern").groupBy("row", "start", "end").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("belief"))
    new = new.where(F.col("belief") >= BELIEF).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(4).alias("rank"), F.lit("id").alias("kind"), "end")).alias("new"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(F.filter("found", lambda x: x["kind"] >= 0), lambda x: F.struct(x["start"], x["kind"].alias("rank"), F.element_at(kinds, x["kind"] + 1).alias("kind"), x["end"]))
    both = found.join(stored(new), "row", "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return both.select("doc_id", F.array_sort(F.concat(base, F.coalesce("new", none))).alias("spans"))
