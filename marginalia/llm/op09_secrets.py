"""Secret scans: all rules compiled into one deterministic automaton.

A small regex compiler (literals, classes, groups, alternation, ? * + {m} {m,}) makes non-deterministic automata over bytes. Subset
construction and Moore minimisation turn all rules together into one table of transitions over byte classes. That table is built for
the reversed rules and read from the end of a text to its beginning: one pass over the bytes says at which bytes a match of which
rule begins. Only at those bytes a second, forward automaton of the one rule finds the longest end. Matches of a rule are taken
leftmost first and never overlap.

A rule whose short matches are dropped states how long they must be; `detect` may hold the length already where a dropped match can't
hide a longer one (it is confined to a run of the rule's own characters that the longer one would have to share). Only the hexadecimal
rule needs that, as the others begin with rare text; counts of several rules would multiply the automaton's states.

Defined results: null and empty texts have no spans; texts are scanned whole; offsets are code points; repeated rows give repeated rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm import text as T
from marginalia.session import ship


@dataclass(frozen=True)
class Rule:
    kind: str
    #: all of a match
    pattern: str
    #: what begins where a match that may count begins; pattern if empty
    detect: str = ""
    #: least length of a match (without its head) that counts
    least: int = 0
    #: the beginning of a match that doesn't count for its length; the rest must have `least` characters
    head: str = ""
    #: ASCII letters of the pattern's literals in either case
    any_case: bool = False


VALUE = "[A-Za-z0-9+/_.=-]"
KEYWORD = """(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?"""
#: The kinds of the base, then those that the method adds; spans are sorted by start, then in this order.
RULES = (
    Rule("assign", KEYWORD + VALUE + "+", head=KEYWORD, least=6, any_case=True),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]+", detect="[0-9a-f]{24,}", least=24),
    Rule("private_key", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", least=30),
    Rule("url_login", "[a-z]+://[A-Za-z0-9._-]+:[^\\x00-\\x20@/:]+@[A-Za-z0-9.-]+", least=12),
)


# ---- compiling -------------------------------------------------------------------------------------------------------------------


@dataclass
class Nfa:
    """States are numbers; steps[s] holds (bytes as a 256-bit number, next), empty[s] the states reached without a byte."""

    steps: list[list[tuple[int, int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.steps.append([])
        self.empty.append([])
        return len(self.steps) - 1


class Parser:
    """Regex text to a tree: ("set", bits), ("cat", items), ("alt", items), ("rep", item, least, most or None)."""

    def __init__(self, pattern: str, any_case: bool):
        self.p, self.i, self.any_case = pattern, 0, any_case

    def parse(self):
        tree = self.alt()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} of {self.p!r}")
        return tree

    def more(self, stop: str) -> bool:
        return self.i < len(self.p) and self.p[self.i] not in stop

    def alt(self):
        items = [self.cat()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            items.append(self.cat())
        return ("alt", items) if len(items) > 1 else items[0]

    def cat(self):
        items = []
        while self.more("|)"):
            items.append(self.repeat(self.atom()))
        return ("cat", items)

    def repeat(self, item):
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            if c == "{":
                end = self.p.index("}", self.i)
                least, comma, most = self.p[self.i + 1 : end].partition(",")
                self.i = end + 1
                item = ("rep", item, int(least), int(most) if most else None if comma else int(least))
            else:
                self.i += 1
                item = ("rep", item, int(c == "+"), 1 if c == "?" else None)
        return item

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        if ord(c) > 127:
            raise ValueError("rules are of ASCII characters")
        return ord(c)

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            tree = self.alt()
            self.i += 1
            return tree
        if c == "[":
            self.i += 1
            invert = self.p[self.i] == "^"
            self.i += invert
            bits = 0
            while self.p[self.i] != "]":
                low = self.byte()
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    high = self.byte()
                else:
                    high = low
                bits |= ((1 << (high - low + 1)) - 1) << low
            self.i += 1
            return ("set", ((1 << 128) - 1) & ~bits if invert else bits)
        b = self.byte()
        return ("set", 1 << b | (1 << (b ^ 32) if self.any_case and chr(b).isalpha() else 0))


def _add(nfa: Nfa, tree, begin: int, back: bool) -> int:
    """Append the tree after state begin; back reads it from its end. Gives the end state."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.steps[begin].append((tree[1], end))
        return end
    if kind == "cat":
        for item in reversed(tree[1]) if back else tree[1]:
            begin = _add(nfa, item, begin, back)
        return begin
    if kind == "alt":
        end = nfa.state()
        for item in tree[1]:
            own = nfa.state()
            nfa.empty[begin].append(own)
            nfa.empty[_add(nfa, item, own, back)].append(end)
        return end
    _, item, least, most = tree
    for _ in range(least):
        begin = _add(nfa, item, begin, back)
    if most is None:
        loop = nfa.state()
        nfa.empty[begin].append(loop)
        nfa.empty[_add(nfa, item, loop, back)].append(loop)
        return loop
    end = nfa.state()
    nfa.empty[begin].append(end)
    for _ in range(most - least):
        begin = _add(nfa, item, begin, back)
        nfa.empty[begin].append(end)
    return end


@dataclass(frozen=True)
class Dfa:
    """table[state * classes + class] is the next state times classes; accepting states come first, accepts has their rules as bits."""

    classes: bytes
    width: int
    table: np.ndarray
    start: int
    accepts: tuple[int, ...]

    @property
    def states(self) -> int:
        return len(self.table) // self.width


def compile_rules(patterns: list[tuple[str, bool]], back: bool, anywhere: bool) -> Dfa:
    """Subset construction over byte classes, then minimisation. State -1 is the dead state."""
    nfa = Nfa()
    root = nfa.state()
    ends = {}
    for k, (pattern, any_case) in enumerate(patterns):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        ends[_add(nfa, Parser(pattern, any_case).parse(), begin, back)] = k
    sets = sorted({bits for row in nfa.steps for bits, _ in row})
    signature = [tuple(bits >> b & 1 for bits in sets) for b in range(256)]
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes = bytes(kinds[s] for s in signature)
    member = {bits: [c for s, c in kinds.items() if s[i]] for i, bits in enumerate(sets)}
    width = len(kinds)
    closure: list[frozenset[int]] = []
    for s in range(len(nfa.steps)):
        seen, todo = {s}, [s]
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        closure.append(frozenset(x for x in seen if nfa.steps[x] or x in ends))
    first = closure[root]
    number, queue, rows = {first: 0}, [first], []
    for states in queue:
        reach: list[set[int]] = [set(first) if anywhere else set() for _ in range(width)]
        for s in states:
            for bits, to in nfa.steps[s]:
                for c in member[bits]:
                    reach[c] |= closure[to]
        row = []
        for x in map(frozenset, reach):
            if not x:
                row.append(-1)
                continue
            if x not in number:
                number[x] = len(queue)
                queue.append(x)
            row.append(number[x])
        rows.append(row)
    accept = np.array([sum(1 << k for k in {ends[s] for s in states if s in ends}) for states in queue], np.int64)
    # Moore: split blocks by the blocks that their transitions reach, until none splits
    step = np.array(rows, np.int64)
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        key = np.column_stack([block, np.where(step >= 0, block[step], -1)])
        new = np.unique(key, axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    one = np.unique(block, return_index=True)[1]
    order = np.argsort(accept[one] == 0, kind="stable")  # accepting ones first
    place = np.empty(len(one), np.int64)
    place[order] = np.arange(len(one))
    final = step[one[order]]
    table = np.where(final >= 0, place[block[final]] * width, -1).ravel()
    return Dfa(classes, width, table, int(place[block[0]]) * width, tuple(int(x) for x in accept[one[order]] if x))


class Scanner:
    """All rules: one backward automaton for where matches begin, one forward automaton for each rule."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.begin = compile_rules([(r.detect or r.pattern, r.any_case) for r in rules], back=True, anywhere=True)
        self.ends = [compile_rules([(r.pattern, r.any_case)], back=False, anywhere=False) for r in rules]
        self.heads = [compile_rules([(r.head, r.any_case)], back=False, anywhere=False) if r.head else None for r in rules]
        self.tables = None

    def begins(self, data: bytes) -> list[tuple[int, int]]:
        """(byte offset, rules as bits) of every byte where a match begins, from the last to the first; one pass."""
        dfa = self.begin
        if self.tables is None:
            self.tables = dfa.table.tolist()
        table, s, limit = self.tables, dfa.start, len(dfa.accepts) * dfa.width
        hits = []
        for i, c in enumerate(data[::-1].translate(dfa.classes)):
            s = table[s + c]
            if s < limit:
                hits.append((i, s))
        last = len(data) - 1
        return [(last - i, dfa.accepts[s // dfa.width]) for i, s in hits]

    @staticmethod
    def longest(dfa: Dfa, data: bytes, at: int) -> int:
        """The end of the longest match that begins at this byte, or -1."""
        table, width, classes, accepting = dfa.table, dfa.width, dfa.classes, len(dfa.accepts) * dfa.width
        s, end = dfa.start, -1
        for i in range(at, len(data)):
            s = table[s + classes[data[i]]]
            if s < 0:
                break
            if s < accepting:
                end = i + 1
        return end

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, sorted by start and rule."""
        free = [0] * len(self.rules)
        out = []
        for at, bits in reversed(self.begins(data)):
            for k, rule in enumerate(self.rules):
                if not bits >> k & 1 or at < free[k]:
                    continue
                end = self.longest(self.ends[k], data, at)
                if end < 0:
                    continue
                free[k] = end
                body = self.longest(self.heads[k], data, at) if rule.head else at
                if end - body >= rule.least:
                    out.append((at, end, k))
        return out


_cached: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    if rules not in _cached:
        _cached[rules] = Scanner(rules)
    return _cached[rules]


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or data.isascii():
        return spans
    upto = np.concatenate([[0], np.cumsum(T.START[np.frombuffer(data, np.uint8)])])
    return [(int(upto[a]), int(upto[b]), k) for a, b, k in spans]


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> in code points, by start and then in the order of the rules. A map without a shuffle."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in code_points(t, scan.scan(t))] if t else [] for t in T.blobs(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(T.tidy(rows), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def mask(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The rows of documents with every span replaced by a mark and n_chars counted anew; overlapping spans count as one.

    Texts without spans, null ones too, pass unchanged.
    """
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    new = mark.encode()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in batches:
            texts, changed = T.blobs(batch.column(at)), {}
            for i, t in enumerate(texts):
                if t and (spans := scan.scan(t)):
                    parts, done = [], 0
                    for a, b, _ in spans:
                        if a >= done:
                            parts += [t[done:a], new]
                        done = max(done, b)
                    texts[i] = changed[i] = b"".join([*parts, t[done:]])
            columns = list(batch.columns)
            if changed:
                columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
                if count >= 0:
                    sizes = batch.column(count).to_pylist()
                    for i, t in changed.items():
                        sizes[i] = len(t.decode())
                    columns[count] = pa.array(sizes, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(T.tidy(rows), docs.schema)


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from the spans."""
    from pyspark.sql import functions as F

    as_text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
