"""Secret scans: all rules in one pass over the bytes, by one deterministic automaton.

Each rule's regular expression becomes a nondeterministic automaton over bytes,
and by subset construction a deterministic one. A rule's search is the ordered
list of the states of its open candidates, earliest start first: of two in one
state the later goes, and a candidate that is a match ends those after it. The
searches of all rules together are the states of the combined automaton, which
is minimised and laid down as arrays: a class for each byte, and the next state
for each state and class. One pass gives the ends of all rules' matches; a
match's start is found by walking its rule's reversed automaton back from the
end, no further than the match before. Matches are leftmost, longest, and do
not overlap within a rule; those shorter than the rule's least length are
dropped after they have taken their place.

A rule must be one whose matches, once complete, only grow until they end (as
prefix and run do), and must have two bytes at least; others are refused.

BASE holds the three kinds that are always reported; MORE adds token formats
of services, signed tokens, private key headers and passwords in urls.

Offsets are code points of the text, ends exclusive. Defined cases: a null or
empty text has no span; whole texts are scanned, of any length; bytes beyond
ASCII belong to no rule here and end a match; repeated rows and null doc_ids
are scanned each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from re import _parser as tree  # the standard library's own parser of patterns

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of the whole match, or of a group of it."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


def either(word: str) -> str:
    """A pattern of the word's letters in upper or lower case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
BASE = (
    Rule("assign", "(" + _KEYS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{4,}", 32),  # runs of [0-9a-f]+; those under 4 fail as well, and need not be reported
)
MORE = (
    Rule("code_host", "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("url_login", "://[A-Za-z0-9._-]+:[A-Za-z0-9._!$%-]+@"),
)
RULES = BASE + MORE


class _Pattern:
    """A rule's nondeterministic automaton over bytes: `moves` by state: (set of bytes, next), `free`: moves without a byte."""

    def __init__(self, pattern: str):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []
        self.first, self.last = self._new(), self._new()
        self._build(tree.parse(pattern), self.first, self.last)

    def _new(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _build(self, items, a: int, b: int) -> None:
        for op, arg in items:
            nxt = self._new()
            self._one(str(op), arg, a, nxt)
            a = nxt
        self.free[a].append(b)

    def _one(self, op: str, arg, a: int, b: int) -> None:
        if op == "LITERAL" and arg < 128:
            self.moves[a].append((frozenset([arg]), b))
        elif op == "IN":
            found = set()
            for o, x in arg:
                if str(o) not in ("LITERAL", "RANGE") or (x if str(o) == "LITERAL" else x[1]) > 127:
                    raise ValueError("only classes of single characters and ranges are supported")
                found.update([x] if str(o) == "LITERAL" else range(x[0], x[1] + 1))
            self.moves[a].append((frozenset(found), b))
        elif op == "BRANCH":
            for part in arg[1]:
                self._build(part, a, b)
        elif op == "SUBPATTERN" and not arg[1] and not arg[2]:
            self._build(arg[3], a, b)
        elif op == "MAX_REPEAT":
            low, high, part = arg
            for _ in range(low):
                nxt = self._new()
                self._build(part, a, nxt)
                a = nxt
            if high == tree.MAXREPEAT:
                loop = self._new()
                self.free[a].append(loop)
                self._build(part, loop, loop)
                a = loop
            else:
                for _ in range(high - low):
                    nxt = self._new()
                    self._build(part, a, nxt)
                    self.free[a].append(b)
                    a = nxt
            self.free[a].append(b)
        else:
            raise ValueError(f"{op} is not supported in a rule")

    def turned(self) -> _Pattern:
        """The automaton of the reversed strings."""
        out = object.__new__(_Pattern)
        out.moves, out.free = [[] for _ in self.moves], [[] for _ in self.free]
        out.first, out.last = self.last, self.first
        for a, (moves, free) in enumerate(zip(self.moves, self.free, strict=True)):
            for some, b in moves:
                out.moves[b].append((some, a))
            for b in free:
                out.free[b].append(a)
        return out

    def subsets(self) -> tuple[list[list[int]], list[bool]]:
        """Subset construction: the next state by state and byte (-1: none), and which states are matches; state 0 is first."""

        def closed(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for x in self.free[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(seen)

        start = closed([self.first])
        numbers, queue, step = {start: 0}, [start], []
        for state in queue:
            row = [-1] * 256
            used = sorted({c for a in state for some, _ in self.moves[a] for c in some})
            for c in used:
                to = closed({b for a in state for some, b in self.moves[a] if c in some})
                if to not in numbers:
                    numbers[to] = len(numbers)
                    queue.append(to)
                row[c] = numbers[to]
            step.append(row)
        return step, [self.last in s for s in queue]


@dataclass
class Scanner:
    """The combined automaton as arrays, and each rule's reversed one."""

    rules: tuple[Rule, ...]
    classes: bytes = b""
    step: list[int] = field(default_factory=list)  # states are multiples of the number of classes; matching states come last
    matching: int = 0
    ended: dict[int, tuple[int, ...]] = field(default_factory=dict)
    back: list[tuple[list[list[int]], list[bool]]] = field(default_factory=list)

    def ends(self, data: bytes) -> list[list[int]]:
        """The ends of each rule's matches, by one pass."""
        out: list[list[int]] = [[] for _ in self.rules]
        step, matching, s = self.step, self.matching, 0
        for i, c in enumerate(data.translate(self.classes)):
            s = step[s + c]
            if s >= matching:
                for r in self.ended[s]:
                    if out[r] and out[r][-1] == i:
                        out[r][-1] = i + 1
                    else:
                        out[r].append(i + 1)
        return out

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """Spans as (start, number of the rule, end) in bytes, in that order."""
        found = []
        for r, ends in enumerate(self.ends(data)):
            rule, before, (step, match) = self.rules[r], 0, self.back[r]
            for end in ends:
                at, s, start = end, 0, end
                while at > before and (s := step[s][data[at - 1]]) >= 0:
                    at -= 1
                    if match[s]:
                        start = at
                before = end
                if rule.group == 0:
                    long = end - start
                else:
                    a, b = re.fullmatch(rule.pattern.encode(), data[start:end]).span(rule.group)
                    long = b - a
                if long >= rule.least:
                    found.append((start, r, end))
        return sorted(found)


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The scanner of the rules."""
    forward = [_Pattern(r.pattern).subsets() for r in rules]
    for rule, (step, match) in zip(rules, forward, strict=True):
        if match[0] or any(match[t] for t in step[0] if t >= 0):
            raise ValueError(f"{rule.kind}: a match must have two bytes at least")
        if any(match[s] and t >= 0 and not match[t] for s in range(len(step)) for t in step[s]):
            raise ValueError(f"{rule.kind}: a match may not pass through an incomplete one as it grows")

    def follow(r: int, open_: tuple[int, ...], c: int) -> tuple[int, ...]:
        step, match = forward[r]
        going = [t for s in open_ if (t := step[s][c]) >= 0]
        if step[0][c] >= 0 and not (going and match[going[0]]):
            going.append(step[0][c])
        out: list[int] = []
        for t in dict.fromkeys(going):
            if match[t] and out:
                raise ValueError(f"{rules[r].kind}: a later match may not end before an earlier one is decided")
            out.append(t)
            if match[t]:
                break
        return tuple(out)

    columns = [tuple(row[c] for step, _ in forward for row in step) for c in range(256)]
    kinds = {col: i for i, col in enumerate(dict.fromkeys(columns))}
    sample = {i: columns.index(col) for col, i in kinds.items()}
    start = tuple(() for _ in rules)
    numbers, queue, rows = {start: 0}, [start], []
    for state in queue:
        row = []
        for i in range(len(kinds)):
            to = tuple(follow(r, open_, sample[i]) for r, open_ in enumerate(state))
            if to not in numbers:
                numbers[to] = len(numbers)
                queue.append(to)
            row.append(numbers[to])
        rows.append(row)
    marks = [tuple(r for r, open_ in enumerate(s) if open_ and forward[r][1][open_[0]]) for s in queue]
    table, marks = minimised(np.array(rows), marks)
    order = sorted(range(len(table)), key=lambda i: (bool(marks[i]), i != 0, i))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = len(kinds)
    return Scanner(
        rules, bytes(kinds[col] for col in columns), (place[table[order]] * n).ravel().tolist(), sum(not m for m in marks) * n,
        {int(place[i]) * n: m for i, m in enumerate(marks) if m}, [_Pattern(r.pattern).turned().subsets() for r in rules],
    )


def minimised(table: np.ndarray, marks: list[tuple[int, ...]]) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Merge states that no continuation tells apart: blocks by mark, split by the blocks of their successors until none splits.

    The first state's block comes first.
    """
    known = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    block = np.array([known[m] for m in marks])
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, first = np.unique(block, return_index=True)
    order = np.argsort(first)  # by first appearance
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    kept = first[order]
    return place[block[table[kept]]], [marks[i] for i in kept]


def spans_of(text: str | None, scanner: Scanner) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text in code points, by start, then as the rules are listed."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = scanner.scan(data)
    if not found:
        return []
    if len(data) != len(text):
        point = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        at = lambda i: int(point[i - 1]) if i else 0
        found = [(at(a), r, at(b)) for a, r, b in found]
    return [(scanner.rules[r].kind, a, b) for a, r, b in found]


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end, secret) of every document, also of those without any."""
    sent = docs.sparkSession.sparkContext.broadcast(compiled(tuple(rules)))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))

    def run(batches):
        for batch in batches:
            found = []
            for value in batch.column("text"):
                text = value.as_py()
                found.append([{"kind": k, "start": a, "end": b, "secret": text[a:b]} for k, a, b in spans_of(text, sent.value)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return documents(docs).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, secret: string>>")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs, all columns, with each run of overlapping spans replaced by the mark; a null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(compiled(tuple(rules)))

    def run(batches):
        for batch in batches:
            texts = []
            for value in batch.column("text"):
                text, out, at = value.as_py(), [], 0
                for _, a, b in spans_of(text, sent.value):
                    if a >= at:
                        out += [text[at:a], mark]
                    at = max(at, b)
                texts.append(text if text is None else "".join(out) + text[at:])
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.column("text").type))

    return docs.mapInArrow(run, docs.schema)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 of the base spans and all spans, joined as kind:start:end."""
    kinds = [r.kind for r in base]

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    known = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return scan(docs, rules).select("doc_id", *map(count, kinds), F.sha2(_joined(known), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def digest_sql(rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE) -> str:
    """DuckDB SQL for digest: spans are the lengths of what lies between a rule's matches, summed."""
    quoted = lambda s: s.replace("'", "''")
    each = []
    for i, r in enumerate(rules):
        p = quoted(r.pattern)
        each.append(f"""select r, {i} k, '{r.kind}' kind, {r.least} least, string_split_regex(t, '{p}') gaps, regexp_extract_all(t, '{p}', 0) hits,
    regexp_extract_all(t, '{p}', {r.group}) parts from d where regexp_matches(t, '{p}')""")
    kinds = ", ".join(f"'{r.kind}'" for r in base)
    name = "kind || ':' || a || ':' || b"
    return f"""with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
  m as ({" union all ".join(each)}),
  u as (select r, k, kind, least, unnest(range(1, len(hits) + 1)) i, unnest(gaps[:len(hits)]) gap, unnest(hits) hit, unnest(parts) part from m),
  p as (select r, k, kind, least, part, sum(length(gap) + length(hit)) over (partition by r, k order by i) b, length(hit) n from u),
  s as (select r, k, kind, b - n a, b from p where length(part) >= least),
  g as (select r, {", ".join(f"count(*) filter (where kind = '{x.kind}') n_{x.kind}" for x in base)},
    string_agg({name}, ',' order by a, k) filter (where kind in ({kinds})) known, string_agg({name}, ',' order by a, k) everything from s group by r)
select doc_id, {", ".join(f"coalesce(n_{x.kind}, 0)::bigint as n_{x.kind}" for x in base)}, sha256(coalesce(known, '')) as base_sha256, coalesce(everything, '') as spans
from d left join g using (r)"""
