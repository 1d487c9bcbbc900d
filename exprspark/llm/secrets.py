"""Secret scan with a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query. The index holds, for every
trigram the rules ask for, a posting per text; a rule's candidates are the texts whose postings satisfy
one of its conjunctions, and only those are scanned with it. Rules without mandatory trigrams (such as
bare hex runs) scan every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.llm import common

#: Alternatives kept while strings are enumerated; beyond that a part counts as unknown, which only weakens the filter.
ALTERNATIVES = 64
#: Trigrams of a conjunction that are looked up in the index.
CLAUSE = 4
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds come first; the others are added by the method.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs of 24 or more: those of [0-9a-f]+ that are long enough
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("forge", r"(?:ghp|gho|ghu|ghs|ghr|github_pat|glpat)[_-][A-Za-z0-9_]{20,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{16,}=*"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+"),
)

#: A query is a set of conjunctions (sets of trigrams), one of which must hold; `ANY` always holds.
Query = frozenset
ANY: Query = frozenset([frozenset()])


def _and(left: Query, right: Query) -> Query:
    if len(left) * len(right) > ALTERNATIVES:
        return min(left, right, key=lambda q: -min(map(len, q)))
    return frozenset(a | b for a in left for b in right)


def _or(parts: list[Query]) -> Query:
    every = frozenset().union(*parts)
    return ANY if frozenset() in every or len(every) > ALTERNATIVES else every


def _of(texts: frozenset[str]) -> Query:
    """Some of these strings occurs: the trigrams of each."""
    return _or([frozenset([frozenset(t[i : i + 3] for i in range(len(t) - 2))]) for t in texts])


def _part(code, value) -> tuple[frozenset[str] | None, Query]:
    """(all strings a part matches, lower-cased, where they are few; else None, and what every match fulfils)."""
    if code is op.LITERAL:
        return frozenset([chr(value).lower()]), ANY
    if code is op.IN and all(c in (op.LITERAL, op.RANGE) for c, _ in value):
        ranges = [(v, v) if c is op.LITERAL else v for c, v in value]
        few = sum(high - low + 1 for low, high in ranges) <= 4
        return frozenset(chr(x).lower() for low, high in ranges for x in range(low, high + 1)) if few else None, ANY
    if code is op.SUBPATTERN:
        return _sequence(value[-1])
    if code is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(t is not None for t, _ in parts):
            return frozenset().union(*(t for t, _ in parts)), ANY
        return None, _or([q if t is None else _of(t) for t, q in parts])
    if code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, part = value
        texts, asks = _sequence(part)
        if high == 1 and texts is not None:
            return texts | ({""} if low == 0 else set()), ANY
        return None, ANY if low == 0 else asks if texts is None else _of(texts)
    return (frozenset([""]), ANY) if code in (op.AT, op.ASSERT, op.ASSERT_NOT) else (None, ANY)


def _sequence(items) -> tuple[frozenset[str] | None, Query]:
    """The same for parts in a row: runs of enumerated parts are multiplied out, and a run that ends asks for its trigrams."""
    run, query, whole = frozenset([""]), ANY, True
    for code, value in items:
        texts, asks = _part(code, value)
        if texts is not None and len(run) * len(texts) <= ALTERNATIVES:
            run = frozenset(a + b for a in run for b in texts)
            continue
        query, whole = _and(_and(query, _of(run)), asks), False
        run = texts if texts is not None else frozenset([""])
    return (run, ANY) if whole else (None, _and(query, _of(run)))


def trigram_query(pattern: str) -> Query:
    """Conjunctions of lower-case trigrams, one of which occurs in every text the pattern matches; `ANY` if none is mandatory."""
    texts, query = _sequence(parser.parse(pattern))
    query = query if texts is None else _of(texts)
    # a conjunction that contains another one adds nothing
    return frozenset(q for q in query if not any(other < q for other in query))


def asked(rules: tuple[Rule, ...]) -> list[tuple[int, int, str]]:
    """(rule, clause, trigram) of the indexed rules. A clause keeps `CLAUSE` of its trigrams, those with signs first, which are
    rarer; leaving out the others only weakens the filter."""
    queries = [(n, trigram_query(rule.pattern)) for n, rule in enumerate(rules)]
    return [(n, c, t) for n, q in queries if q != ANY for c, clause in enumerate(sorted(map(sorted, q))) for t in sorted(clause, key=lambda t: (t.isalpha(), t))[:CLAUSE]]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index, restricted to the trigrams that are asked for: (trigram, text_key), once per distinct text key."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[t for t in trigrams if t in low] for low in ((text or "").lower() for text in batch.column("text").to_pylist())]
            rows = pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(held, pa.list_(pa.string()))], names=["text_key", "held"])
            yield rows.filter(pa.array([bool(h) for h in held], pa.bool_()))

    found = docs.select(common.text_key().alias("text_key"), "text").mapInArrow(find, "text_key bigint, held array<string>")
    return found.distinct().select("text_key", F.explode("held").alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text_key, rules): for each text key the numbers of the indexed rules whose trigram query its postings fulfil."""
    wanted = asked(rules)
    clauses = docs.sparkSession.createDataFrame(wanted or [(-1, 0, "")], "rule int, clause int, trigram string")  # bounded by the rules
    needed = clauses.groupBy("rule", "clause").agg(F.count(F.lit(1)).alias("needed"))
    hits = postings(docs, sorted({t for _, _, t in wanted})).join(F.broadcast(clauses), "trigram").groupBy("text_key", "rule", "clause").agg(F.count(F.lit(1)).alias("n"))
    met = hits.join(F.broadcast(needed), ["rule", "clause"]).where("n = needed")
    return met.groupBy("text_key").agg(F.collect_set("rule").alias("rules"))  # at most one entry per rule


def matches(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, ordered by start, then by the order of the rules. Null and
    empty texts have none. Postings are kept by a hash of the text, so rows that repeat a text share them and a
    null doc_id changes nothing; a collision of hashes would only add a text to scan.
    """
    full = [n for n, rule in enumerate(rules) if trigram_query(rule.pattern) == ANY]
    found = candidates(docs, rules)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", common.text_key().alias("text_key")).join(found, "text_key", "left").select("doc_id", "text", "rules")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(rule.pattern) for rule in rules]
        for batch in batches:
            out = []
            for doc_id, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "rules"))):
                spans = [(start, n, end) for n in sorted({*full, *(own or ())}) for start, end in matches(rules[n], compiled[n], text or "")]
                spans.sort()
                base = [s for s in spans if rules[s[1]].kind in BASE]
                out.append((doc_id, *(sum(rules[s[1]].kind == kind for s in base) for kind in BASE),
                            hashlib.sha256(_joined(base, rules).encode()).hexdigest(), _joined(spans, rules)))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(verify, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def _joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[n].kind}:{start}:{end}" for start, n, end in spans)
