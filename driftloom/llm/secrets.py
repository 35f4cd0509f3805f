"""Secret scans with a trigram inverted index.

From each rule's regular expression follows a Boolean query of the trigrams that any match must hold. Every batch of
documents gets an index segment: its texts are cut into trigrams, and those in use have sorted postings of the documents that
hold them. Intersecting and uniting postings leaves candidates, which the expression itself verifies. Rules without a
mandatory trigram scan all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser as parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.shared import documents

MASK = "[SECRET]"
MOST_STRINGS = 64
#: Characters of a segment that are cut into trigrams at once.
STRETCH = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has at least ``least`` characters; others are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: Fixed patterns of the base kinds, then of the kinds that the method adds.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    # Runs of 16 or more are exactly the matches of [0-9a-f]+ that are long enough.
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    # Begins a run and keeps what it has matched, so that long runs stay linear.
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
)
RULES = BASE_RULES + ADDED_RULES

Query = object  # True, a trigram, or ("and" | "or", (Query, ...))


def _both(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _strings(items) -> set[str] | None:
    """All strings that a piece of an expression can match, in lower case; None if these are too many."""
    found = {""}
    for op, arg in items:
        if op is C.LITERAL:
            more: set[str] | None = {chr(arg).lower()}
        elif op is C.SUBPATTERN:
            more = _strings(arg[3])
        elif op is C.BRANCH:
            parts = [_strings(b) for b in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            more = {chr(a).lower() for _, a in arg}
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[1] <= 4:
            once = _strings(arg[2])
            more = None if once is None else {"".join(t) for n in range(arg[0], arg[1] + 1) for t in product(once, repeat=n)}
        elif op is C.AT:
            more = {""}
        else:
            more = None
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def _needs(strings: set[str]) -> Query:
    return _either([_both([s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def _query(items) -> Query:
    parts: list[Query] = []
    held = {""}
    for item in items:
        more = _strings([item])
        if more is not None and len(held) * len(more) <= MOST_STRINGS:
            held = {a + b for a in held for b in more}
            continue
        parts.append(_needs(held))
        held = {""} if more is None else more
        op, arg = item
        if more is None and op is C.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif more is None and op is C.BRANCH:
            parts.append(_either([_query(b) for b in arg[1]]))
        elif more is None and op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            parts.append(_query(arg[2]))
    return _both([*parts, _needs(held)])


def trigram_query(pattern: str) -> Query:
    """Boolean query over lower-case trigrams that the lower-case form of every match satisfies; True if there is none."""
    return _query(parser.parse(pattern))


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Segment:
    """Inverted index of a batch of texts over the trigrams in use: sorted document numbers for each."""

    def __init__(self, texts: list[str], used: list[str]):
        self.n = len(texts)
        codes = _codes(_points("".join(used)))[::3] if used else np.empty(0, dtype=np.int64)
        order = np.argsort(codes, kind="stable")
        known, number = codes[order], np.arange(len(used))[order]
        hashed = np.zeros(1 << 16, dtype=bool)
        hashed[_small(known)] = True
        whole, begins = "".join(texts), np.cumsum([0, *map(len, texts)])
        pairs = []
        for a in range(0, max(0, len(whole) - 2), STRETCH):
            found = _codes(_points(whole[a : a + STRETCH + 2]))
            # A small table drops most places before the exact search.
            at = np.flatnonzero(hashed[_small(found)])
            near = np.searchsorted(known, found[at]).clip(max=len(known) - 1)
            same = known[near] == found[at] if len(known) else np.zeros(0, dtype=bool)
            place, gram = a + at[same], number[near[same]]
            doc = np.searchsorted(begins, place, side="right") - 1
            # A trigram over the end of a text is none of its own.
            own = place + 3 <= begins[doc + 1]
            pairs.append(np.unique(gram[own] * np.int64(self.n) + doc[own]))
        both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, dtype=np.int64)
        ends = np.searchsorted(both, np.arange(len(used) + 1) * np.int64(max(1, self.n)))
        self.postings = {g: both[ends[k] : ends[k + 1]] - k * self.n for k, g in enumerate(used)}

    def matching(self, query: Query) -> np.ndarray:
        """Sorted numbers of the documents that satisfy a query."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query]
        lists = [self.matching(q) for q in query[1]]
        if query[0] == "or":
            return reduce(np.union1d, lists)
        # Shortest postings first.
        return reduce(lambda x, y: np.intersect1d(x, y, assume_unique=True), sorted(lists, key=len))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _codes(points: np.ndarray) -> np.ndarray:
    """A number for each trigram of a run of code points."""
    return points[:-2] | points[1:-1] << 21 | points[2:] << 42 if len(points) > 2 else np.empty(0, dtype=np.int64)


def _small(codes: np.ndarray) -> np.ndarray:
    return (codes ^ codes >> 15 ^ codes >> 29) & 0xFFFF


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.used = sorted(set().union(*(trigrams(q) for _, _, q in self.rules)))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its matches as (start, number of the rule, end), sorted."""
        segment = Segment([t.lower() for t in texts], self.used)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in segment.matching(query).tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in found]


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of touching or overlapping spans replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at and (start > at or not out):
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(
    df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", base: int = len(BASE_RULES), carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: id, ``carry`` columns, spans (array of kind, begin, end), redacted text.

    Positions are code points, ends exclusive; spans are sorted by begin, then by the order of the rules. Null texts give no
    spans and stay null; empty ones stay empty. Null ids and repeated rows are rows like any other; columns that are not
    carried are left out. Nothing is shuffled: every task indexes and scans its own rows.
    """
    kinds = [r.kind for r in rules]
    names = [f"c{k}" for k in range(len(carry))]
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)))
    scanner = Scanner(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), 1000):
                pdf = whole.iloc[k : k + 1000].reset_index(drop=True)
                texts = [t or "" for t in pdf["text"]]
                found = scanner.spans(texts)
                spans = [[{"kind": kinds[n], "begin": a, "end": b} for a, n, b in x] for x in found]
                text = [None if t is None else masked(t, x) for t, x in zip(pdf["text"], found, strict=True)]
                yield pdf.assign(text=text, spans=spans)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    out = kept.mapInPandas(run, f"{shape}, spans array<struct<kind:string,begin:int,end:int>>")
    return out.select(F.col("id").alias(id_col), *(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)), F.col("text").alias(text_col), "spans")


def span_digest(found: DataFrame, kinds: list[str], id_col: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    line = lambda x: F.concat_ws(":", x["kind"], x["begin"], x["end"])
    own = lambda x: x["kind"].isin(kinds)
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter(spans, of(k))).cast("long").alias(f"n_{k}") for k in kinds]
    base = F.array_join(F.transform(F.filter(spans, own), line), ",")
    return found.select(id_col, *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(spans, line), ",").alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan_secrets(documents(spark, sf_dir)), [r.kind for r in BASE_RULES])
