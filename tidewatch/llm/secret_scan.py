"""Secrets by rules: Boolean trigram queries from each regular expression, postings, verified candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory, without

#: Bytes of text in one segment of the index.
SEGMENT_BYTES = 1 << 22
#: Literal strings that an expression may stand for before they are turned into a query.
MOST_STRINGS = 64
#: Characters of a class that count as alternatives; a larger class is a gap.
MOST_OF_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """What matches ``pattern`` (letters in either case if ``any_case``; ASCII rules of case) with a group of
    ``least`` characters or more. Matches are leftmost and don't overlap; those too short are dropped after."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The base rules, as fixed. A run of 16 or more is what `[0-9a-f]+` finds and 16 characters keep: runs are maximal.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Published token formats.
ADDED = (
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY( BLOCK)?-----"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"(sk|rk)_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{16,}", True),
)

# A query is True (no demand), a trigram (three bytes), or ("all" | "any", queries).


def _both(a, b):
    if a is True or a == b:
        return b
    return a if b is True else ("all", (a, b))


def _of_strings(strings: set[bytes]):
    """The query that a text holds one of the strings. A string that holds another adds nothing."""
    if min(map(len, strings)) < 3:
        return True
    least = sorted(s for s in strings if not any(t != s and t in s for t in strings))
    each = [("all", tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)}))) for s in least]
    return each[0] if len(each) == 1 else ("any", tuple(each))


def _class_bytes(items) -> set[bytes] | None:
    """The lowered characters of a class, if they are few."""
    out = set()
    for op, arg in items:
        if op is rc.LITERAL:
            span = (arg, arg)
        elif op is rc.RANGE:
            span = arg
        else:
            return None
        if span[1] - span[0] > 2 * MOST_OF_CLASS:
            return None
        out |= {chr(c).encode("utf-8", "surrogatepass").lower() for c in range(span[0], span[1] + 1)}
    return out if len(out) <= MOST_OF_CLASS else None


def _walk(parsed) -> tuple[set[bytes] | None, object]:
    """(strings, query) of a parsed expression: all lowered strings that it matches, if they are few, and else
    a query that every lowered text with a match fulfils."""
    strings, query, whole = {b""}, True, True

    def gap():
        nonlocal strings, query, whole
        query, strings, whole = _both(query, _of_strings(strings)), {b""}, False

    for op, arg in parsed:
        options, inner = None, True
        if op in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):
            continue
        if op is rc.LITERAL:
            options = {chr(arg).encode("utf-8", "surrogatepass").lower()}
        elif op is rc.IN:
            options = _class_bytes(arg)
        elif op is rc.SUBPATTERN:
            options, inner = _walk(arg[3])
        elif op is rc.ATOMIC_GROUP:
            options, inner = _walk(arg)
        elif op is rc.BRANCH:
            found = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in found):
                options = set().union(*(s for s, _ in found))
            else:
                each = [q if s is None else _of_strings(s) for s, q in found]
                inner = True if True in each else ("any", tuple(each))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            least, most, body = arg
            options, inner = _walk(body)
            if options is not None and most <= 3 and len(options) ** most <= MOST_STRINGS:
                powers = [{b""}]
                for _ in range(most):
                    powers.append({a + b for a in powers[-1] for b in options})
                options = set().union(*powers[least:])
            elif least == 0:
                options, inner = None, True
            elif options is not None:
                options, inner = None, _of_strings(options)
        if options is not None and len(options) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in options}
            continue
        gap()
        if options is not None and len(options) <= MOST_STRINGS:
            strings = options
        else:
            query = _both(query, inner if options is None else _of_strings(options))
    if whole:
        return strings, True
    return None, _both(query, _of_strings(strings))


def trigram_query(rule: Rule):
    """What every text with a match fulfils, on lowered bytes; True if the rule has no mandatory trigrams."""
    strings, query = _walk(rp.parse(rule.pattern))
    return query if strings is None else _of_strings(strings)


def trigrams_of(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set() if query is True else set().union(*map(trigrams_of, query[1]))


def code_of(trigram: bytes) -> int:
    return int.from_bytes(trigram, "big")


class Segment:
    """The postings of some texts: for each trigram that the rules ask for, the texts that hold it, in order."""

    def __init__(self, texts: list[bytes], asked: np.ndarray):
        """``asked``: for each of the 2**24 trigrams, whether any rule names it."""
        self.size = len(texts)
        ends = np.cumsum([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts).lower(), np.uint8)
        found = []
        for s in range(0, max(0, len(data) - 2), SEGMENT_BYTES):
            x = data[s : s + SEGMENT_BYTES + 2].astype(np.uint32)
            codes = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
            at = np.flatnonzero(asked[codes])
            text = np.searchsorted(ends, at + s, "right")
            inside = at + s + 3 <= ends[text]
            found.append(np.unique((codes[at[inside]].astype(np.int64) << 32) | text[inside]))
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        codes, first = np.unique(pairs >> 32, return_index=True)
        self.postings = dict(zip(codes.tolist(), np.split(pairs & 0xFFFFFFFF, first[1:]), strict=True)) if len(codes) else {}

    def matching(self, query) -> np.ndarray:
        """The texts that fulfil the query: postings intersected, the shortest first, or united."""
        if query is True:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings.get(code_of(query), np.empty(0, np.int64))
        lists = sorted((self.matching(q) for q in query[1]), key=len)
        out = lists[0]
        for other in lists[1:]:
            if query[0] == "any":
                out = np.union1d(out, other)
            elif len(out):
                out = np.intersect1d(out, other, assume_unique=True)
        return out


def segments(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Runs of texts of about SEGMENT_BYTES; a longer text is a run by itself."""
    run, weight = [], 0
    for t in texts:
        t = t or b""
        if run and weight + len(t) > SEGMENT_BYTES:
            yield run
            run, weight = [], 0
        run.append(t)
        weight += len(t)
    if run:
        yield run


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with _secrets: the matches (kind, start, end; code points, end exclusive)
    of all rules in the whole text, by start, then in the order of the rules, then by end.

    From each rule's expression follows a Boolean query of trigrams that every text with a match fulfils. A task
    cuts its texts into segments, indexes of each segment the trigrams that the rules ask for, intersects and
    unites postings, and runs an expression only on the texts that its query leaves; a rule without mandatory
    trigrams (`hex`) runs on all. The index is made where the texts are read and needs no shuffle: its segments
    are independent, so that a lost executor costs the rereading of its own input only.

    Null and empty texts have no secrets. A very long text is a segment by itself; its trigrams are found in
    slices and its whole text is matched at once. Matches of different rules may overlap and are all kept;
    matches of one rule don't. Rules of equal kind count as several. Repeated rows are each scanned; an empty
    table gives no rows; an input column called _secrets gives way.
    """
    docs = without(docs, ["_secrets"])
    at = docs.columns.index(text_col)
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches):
        queries = [trigram_query(r) for r in rules]
        asked = np.zeros(1 << 24, bool)
        asked[[code_of(t) for q in queries for t in trigrams_of(q)]] = True
        patterns = [r.compiled() for r in rules]
        for batch in batches:
            out = []
            for texts in segments(batch.column(at).cast(pa.binary()).to_pylist()):
                index = Segment(texts, asked)
                plain: dict[int, str] = {}
                found: list[list] = [[] for _ in texts]
                for n, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
                    for i in index.matching(query).tolist():
                        if i not in plain:
                            plain[i] = texts[i].decode("utf-8", "surrogatepass")
                        found[i] += [(m.start(), n, m.end()) for m in pattern.finditer(plain[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                out += [[{"kind": rules[n].kind, "start": s, "end": e} for s, n, e in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, "_secrets"])
        release_memory()

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField("_secrets", T.ArrayType(kind))]))


def spelt(secrets) -> F.Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
