"""Secret scan with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that
any match must contain (on lower-cased text), of which every clause keeps its rarest.
The index holds the postings of those trigrams, one per distinct text, found in one
pass over a text; a rule's candidates are the texts in the intersection of the postings
of one of its clauses, and only they are matched with the expression. A rule without
mandatory trigrams is matched with every text. An index that is kept serves any number
of scans.

All of it is DataFrame expressions; the driver only parses the expressions.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex`` whose ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The base rules, in order, then the added ones.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # a maximal run, so the same as a run of any length that has 32
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._!$*+=-]+@"),
)

#: Strings that one part of an expression may expand to before it counts as anything.
EXPAND = 64
#: Trigrams that a clause keeps, and letters from common to rare; other characters are rarer.
GRAMS, LETTERS = 2, " etaoinshrdlcumwfgypbvkjxqz"
RUN = 256


def _clauses(strings: frozenset[str]) -> frozenset[frozenset[str]] | None:
    """Trigram sets, one of which any of ``strings`` brings; None if nothing is mandatory."""
    if any(len(s) < 3 for s in strings):
        return None
    found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset(x for x in found if not any(y < x for y in found))


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    found = {x | y for x, y in itertools.product(a, b)}
    return frozenset(x for x in found if not any(y < x for y in found))


def _walk(parsed) -> tuple[frozenset[str] | None, frozenset | None]:
    """The strings an expression stands for, if they are few, and the clauses that any match meets."""
    run, need = frozenset([""]), None
    for op, arg in parsed:
        if op is C.LITERAL:
            few, own = frozenset([chr(arg).lower()]), None
        elif op is C.IN and all(k in (C.LITERAL, C.RANGE) for k, _ in arg):
            chars = {c for k, v in arg for c in ([v] if k is C.LITERAL else range(v[0], v[1] + 1))}
            few, own = (frozenset(chr(c).lower() for c in chars) if len(chars) <= 8 else None), None
        elif op is C.SUBPATTERN:
            few, own = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            few = frozenset().union(*[f for f, _ in parts if f is not None]) if all(f is not None for f, _ in parts) else None
            each = [o if f is None else _clauses(f) for f, o in parts]
            own = None if any(x is None for x in each) else frozenset().union(*each)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            f, o = _walk(inner)
            if f is not None and high <= 2 and len(f) <= 8:
                few, own = frozenset("".join(x) for n in range(low, high + 1) for x in itertools.product(f, repeat=n)), None
            else:
                few, own = None, (None if low == 0 else o if f is None else _clauses(f))
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            few, own = None, None
        if few is not None and len(run) * len(few) <= EXPAND:
            run = frozenset(a + b for a in run for b in few)
        else:
            need = _both(_both(need, _clauses(run)), own if few is None else None)
            run = few if few is not None else frozenset([""])
            if few is None:
                return _rest(parsed, op, arg, need)
    return run, need


def _rest(parsed, op, arg, need):
    """The rest of a sequence after a part that may be anything: only clauses are left."""
    at = next(i for i, x in enumerate(parsed) if x[0] is op and x[1] is arg)
    few, own = _walk(parsed[at + 1 :])
    return None, _both(need, own if few is None else _both(own, _clauses(few)))


def trigram_query(regex: str) -> list[list[str]] | None:
    """The rule's Boolean query as an OR of ANDs of trigrams; None: every text has to be scanned."""
    few, need = _walk(_parser.parse(regex))
    need = need if few is None else _both(need, _clauses(few))
    return None if need is None else sorted(sorted(c) for c in need)


def rarest(query: list[list[str]], most: int = GRAMS) -> list[list[str]]:
    """The query with the ``most`` rarest trigrams of each clause: fewer conditions, so no match is lost."""
    rank = lambda g: sum(LETTERS.find(c) if c in LETTERS else len(LETTERS) for c in g)
    return sorted({tuple(sorted(sorted(c, key=lambda g: (-rank(g), g))[:most])) for c in query})


def any_of(grams: list[str]) -> str:
    """An expression that stands before each place where one of ``grams`` starts, with the gram as its group 2."""
    tree: dict = {}
    for g in grams:
        at = tree
        for c in g:
            at = at.setdefault(c, {})

    def branch(at: dict) -> str:
        parts = [re.escape(c) + branch(rest) for c, rest in sorted(at.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""

    heads = "".join(re.escape(c) for c in sorted(tree))
    return f"(?s)(?=([{heads}]))(?=({branch(tree)}))"


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: ``(gram, text_key)`` for every distinct text of ``docs(text_key, text)`` and each of ``grams`` it has."""
    has = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_of(grams)), F.lit(2)))
    return docs.select("text_key", F.explode(has).alias("gram")).distinct()


def grams_of(rules: tuple[Rule, ...]) -> tuple[list[str], dict[str, list[list[str]]]]:
    """The trigrams that an index for ``rules`` needs, and the rules' queries; rules without one are left out."""
    queries = {r.kind: rarest(q) for r in rules if (q := trigram_query(r.regex)) is not None}
    return sorted({g for q in queries.values() for c in q for g in c}), queries


def candidates(spark: SparkSession, index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """``text_key, kinds``: texts that meet a clause of a rule, by intersecting its postings."""
    rows = [(kind, i, len(c), g) for kind, q in queries.items() for i, c in enumerate(q) for g in c]
    clauses = F.broadcast(spark.createDataFrame(rows, "kind string, clause int, grams int, gram string"))  # of the rules
    met = index.join(clauses, "gram").groupBy("text_key", "kind", "clause", "grams").agg(F.count("*").alias("n")).where("n = grams")
    return met.groupBy("text_key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """``array<struct<start, rank, kind, end>>`` of the rule's matches, leftmost first.

    Splitting at the matches gives the text between them; the running length of both is the position.
    """
    rx = F.lit(rule.regex)
    parts = F.arrays_zip(F.split(text, rule.regex, -1), F.regexp_extract_all(text, rx, F.lit(0)), F.regexp_extract_all(text, rx, F.lit(rule.group)))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def step(acc, x):
        a = acc["at"] + F.length(x["0"])
        b = a + F.coalesce(F.length(x["1"]), F.lit(0))
        span = F.struct(a.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), b.alias("end"))
        keep = x["1"].isNotNull() & (F.length(x["2"]) >= rule.least)
        return F.struct(b.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    # by runs of RUN matches, as an array that grows is copied at every step
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), lambda i: F.slice(parts, i * RUN + 1, RUN))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,rank:int,kind:string,end:int>>>").alias("out"))

    def run(acc, some):
        got = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(got["at"].alias("at"), F.when(F.size(got["out"]) > 0, F.concat(acc["out"], F.array(got["out"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(runs, start, run, lambda acc: F.flatten(acc["out"]))


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED, index: DataFrame | None = None) -> DataFrame:
    """``doc_id, text, spans`` with ``spans`` by start, then rule, for every row of ``docs(doc_id, text)``.

    ``spans`` has ``start, rank, kind, end`` in code points, the end exclusive, and
    ``rank`` the rule's place. Null text is empty and has none. Repeated rows stay;
    equal texts are looked up once; other columns are ignored; no rows give no rows.
    ``index`` may be one made before, by ``postings`` of at least the ``grams_of`` the rules.
    """
    rules = (*base, *added)
    grams, queries = grams_of(rules)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    index = stored(postings(keyed, grams)) if index is None else index
    found = small(stored(candidates(docs.sparkSession, index, queries)))
    both = keyed.join(found, "text_key", "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    each = []
    for i, r in enumerate(rules):
        there = F.array_contains("kinds", r.kind) if r.kind in queries else F.rlike("text", F.lit(r.regex))
        each.append(F.when(there, _spans(F.col("text"), r, i)).otherwise(none))
    return both.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("spans"))


def digest(scanned: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """One row a document: counts of the base kinds, their digest, and all spans as text."""
    show = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    count = lambda i: F.size(F.filter("spans", lambda x: x["rank"] == i)).cast("long")
    ours = F.filter("spans", lambda x: x["rank"] < len(base))
    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(base)],
        F.sha2(F.array_join(F.transform(ours, show), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", show), ",").alias("spans"),
    )


def scan_sql(base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> str:
    """``digest(scan(documents))`` as SQL: every rule over every text, positions from the lengths between its matches.

    That dialect has no lookbehind, so a rule that starts with one takes the character before it into a group.
    """
    behind, parts = r"(?<![A-Za-z0-9_-])", []
    for rank, r in enumerate((*base, *added)):
        rx, head = r.regex.replace("'", "''"), "''"
        group = r.group
        if rx.startswith(behind):
            rx, group = "(^|[^A-Za-z0-9_-])(" + rx[len(behind) :] + ")", 2
            head = "heads[i]"
        parts.append(
            f"""SELECT rid, CAST(coalesce(list_sum([length(x) FOR x IN between_[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN whole[1:i - 1]]), 0) AS BIGINT) + length({head}) AS a,
  length(whole[i]) - length({head}) AS n, {rank} AS rank, '{r.kind}' AS kind
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT rid, string_split_regex(t, '{rx}') AS between_, regexp_extract_all(t, '{rx}') AS whole,
    regexp_extract_all(t, '{rx}', {group}) AS part, regexp_extract_all(t, '{rx}', 1) AS heads FROM d) m) q WHERE length(part[i]) >= {r.least}"""
            if "(" in rx
            else f"""SELECT rid, CAST(coalesce(list_sum([length(x) FOR x IN between_[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN whole[1:i - 1]]), 0) AS BIGINT) AS a, length(whole[i]) AS n, {rank} AS rank, '{r.kind}' AS kind
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT rid, string_split_regex(t, '{rx}') AS between_, regexp_extract_all(t, '{rx}') AS whole FROM d) m) q WHERE length(whole[i]) >= {r.least}"""
        )
    show = "kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(a + n AS VARCHAR)"
    counts = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in enumerate(base))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT rid, {counts}, string_agg({show}, ',' ORDER BY a, rank) FILTER (rank < {len(base)}) AS ours, string_agg({show}, ',' ORDER BY a, rank) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(g.n_{r.kind}, 0) AS n_{r.kind}" for r in base)}, sha256(coalesce(g.ours, '')) AS base_sha256, coalesce(g.spans, '') AS spans FROM d LEFT JOIN g ON d.rid = g.rid"""
