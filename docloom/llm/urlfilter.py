"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All rules are packed, one bit for each symbol they consume, into the 64-bit words of one Shift-And automaton.
Every URL of a batch advances by one symbol at a time, so that a step simulates all rules on all URLs at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER, BOUNDARY, FIRST = 0, 1, 2
BATCH = 16384


@dataclass(frozen=True)
class Rule:
    """A rule such as `example.com/de/`: a host glob, then from the first slash a path glob.

    It fits its host and all subdomains, if the path starts with the rule's. In a glob `*` stands for any run of
    symbols (in a host: of the host) and `?` for one symbol.
    """

    pattern: str
    verdict: str

    def __post_init__(self) -> None:
        if "/" not in self.pattern or self.verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {self.pattern!r}, {self.verdict!r}")


class Automaton:
    """Rules compiled to masks; `match` tells for each URL the first fitting rule in order of precedence."""

    def __init__(self, rules: Sequence[Rule]):
        #: The longest rule wins, of equally long ones the one that comes first.
        self.rules = sorted(rules, key=lambda r: -len(r.pattern))
        consumed: list[tuple[str, int]] = []  # kind, code point
        loops: list[str] = []  # what a state may stay on: nothing, the host's symbols or all
        first, self.last = [], []
        for rule in self.rules:
            host, _, path = rule.pattern.partition("/")
            first.append(len(consumed))
            self._part("." + host, "host", consumed, loops)
            consumed.append(("boundary", 0))
            loops.append("")
            self._part("/" + path, "all", consumed, loops)
            loops[-1] = "all"
            self.last.append(len(consumed) - 1)
        alphabet = sorted({c for kind, c in consumed if kind == "literal"})
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[alphabet] = np.arange(FIRST, FIRST + len(alphabet))
        self.words = -(-max(len(consumed), 1) // 64)
        self.steps = np.zeros((FIRST + len(alphabet), self.words), np.uint64)
        self.stays = np.zeros((2, self.words), np.uint64)  # on a symbol of host or path; on the boundary
        self.start = np.zeros(self.words, np.uint64)
        of = {c: FIRST + i for i, c in enumerate(alphabet)}
        for i, ((kind, c), loop) in enumerate(zip(consumed, loops, strict=True)):
            word, bit = i // 64, np.uint64(1 << i % 64)
            if kind == "boundary":
                self.steps[BOUNDARY, word] |= bit
            elif kind == "any":
                self.steps[[OTHER, *range(FIRST, len(self.steps))], word] |= bit
            else:
                self.steps[of[c], word] |= bit
            if loop:
                self.stays[0, word] |= bit
            if loop == "all":
                self.stays[1, word] |= bit
        for i in first:
            self.start[i // 64] |= np.uint64(1 << i % 64)

    @staticmethod
    def _part(glob: str, loop: str, consumed: list, loops: list) -> None:
        for c in glob:
            if c == "*":
                loops[-1] = loop
            else:
                consumed.append(("any", 0) if c == "?" else ("literal", ord(c)))
                loops.append("")

    def match(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """For each URL the number of its rule in self.rules, or -1."""
        found = np.full(len(hosts), -1, np.int64)
        if not self.rules or not len(hosts):
            return found
        subjects = [f".{h}\0{p}" for h, p in zip(hosts, paths, strict=True)]
        size = np.fromiter(map(len, subjects), np.int64, len(subjects))
        begin = np.cumsum(size) - size
        symbols = self.classes[np.frombuffer("".join(subjects).encode("utf-32-le"), np.uint32)]
        symbols[begin + 1 + np.fromiter(map(len, hosts), np.int64, len(hosts))] = BOUNDARY
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], begin[order]
        live = np.searchsorted(-size, -np.arange(size[0]), "left")  # URLs longer than each position
        state = np.zeros((self.words, len(order)), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for t, n in enumerate(live):
            c = symbols[begin[:n] + t]
            at_boundary = (c == BOUNDARY).astype(np.int64)
            carry = np.zeros(n, np.uint64)
            for w in range(self.words):
                old = state[w, :n]
                into, carry = carry, old >> top
                state[w, :n] = (((old << one) | into | self.start[w]) & self.steps[c, w]) | (old & self.stays[at_boundary, w])
        for k in reversed(range(len(self.rules))):
            hit = (state[self.last[k] // 64] >> np.uint64(self.last[k] % 64)) & one
            found[order[hit == one]] = k
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; path: then up to `?`, `#` or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def url_filter(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row (id, host, path, rule, verdict) for each row of pages; rule is null where none fits, and then verdict is default.

    A null URL and one without `://` have empty host and path and so fit no rule. Repeated rows are judged each for itself;
    a null id stays null; other columns of pages, whatever their names, are neither read nor returned; an empty table gives none.
    The rules are a parameter of the program, not data; nothing is shuffled.
    """
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    automaton = Automaton(rules)
    names = [r.pattern for r in automaton.rules] + [None]
    verdicts = [r.verdict for r in automaton.rules] + [default]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                found = automaton.match(batch.column("host").to_pylist(), batch.column("path").to_pylist())
                columns = [*batch.columns, pa.array([names[k] for k in found], pa.string()), pa.array([verdicts[k] for k in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "rule", "verdict"])

    kind = dict(parts.dtypes)[id_col]
    return parts.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
