"""URL filtering with a bit-parallel wildcard automaton.

All glob rules are laid side by side in one row of bits, 64 to a word. Bit i of a rule stands for
"its first i tokens have matched"; one step takes a byte of every URL and moves all states of all
rules at once (Shift-And), while wildcards keep their state in place. Tokens of a rule:
`*` any bytes, `~` any bytes but `/` (to stay in the host), `?` one byte, else the byte itself.

The rule set is broadcast: two tables of 256 bits for each state, so 100,000 rules of 40 bytes take
about 260 MB; MAX_STATES refuses more. A pass over URLs is as many as PASS_STATES allows, whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, text_bytes

MAX_STATES = 1 << 22
#: Words of 64 states that a pass over some URLs holds: 16 MB, and some copies of it.
PASS_STATES = 1 << 21


@dataclass(frozen=True)
class Rule:
    """A glob over host + path, its verdict, and its rank: of several that match, the highest wins, then the first."""

    glob: str
    verdict: str
    rank: int = 0
    name: str | None = None


def site_rule(text: str, verdict: str) -> list[Rule]:
    """A rule like `example.org/es/`: the host and all its subdomains, and paths that start so. Longer rules rank higher."""
    rank = 1 + len(text)
    return [Rule(f"{text}*", verdict, rank, text), Rule(f"~.{text}*", verdict, rank, text)]


class Automaton:
    def __init__(self, rules: list[Rule]):
        self.rules = sorted(rules, key=lambda r: -r.rank)
        tokens, n = [], 0
        for r in self.rules:
            steps, loops, k = [], [], 0
            for b in r.glob.encode():
                if b in b"*~":
                    loops.append((k, b))
                else:
                    steps.append(b)
                    k += 1
            tokens.append((n, steps, loops))
            n += k + 1
        if n > MAX_STATES:
            raise ValueError(f"{n} states; split the rules into sets of {MAX_STATES}")
        self.words = max(1, -(-n // 64))
        step, stay = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        begin, self.finals = np.zeros(self.words * 64, bool), np.zeros(len(rules), np.int64)
        sink = np.zeros(self.words * 64, bool)
        for k, (at, steps, loops) in enumerate(tokens):
            begin[at] = True
            for i, b in enumerate(steps):
                step[:, at + i + 1] |= True if b == ord("?") else np.arange(256) == b
            for i, b in loops:
                stay[:, at + i] |= True if b == ord("*") else np.arange(256) != ord("/")
            self.finals[k] = at + len(steps)
            sink[at + len(steps)] = (len(steps), ord("*")) in loops
        pack = lambda x: np.ascontiguousarray(np.packbits(x, axis=-1, bitorder="little")).view("<u8")
        final = np.zeros(self.words * 64, bool)
        final[self.finals] = True
        self.step, self.stay, self.begin, self.sink, self.final = pack(step), pack(stay), pack(begin), pack(sink), pack(final)

    def first_match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each string the index in self.rules of the first rule that matches all of it, or -1; in passes of at most PASS_STATES words of states."""
        step = max(1, PASS_STATES // self.words)
        found = [self._pass(data, offsets[k : k + step + 1]) for k in range(0, len(offsets) - 1, step)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _pass(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, lengths = len(offsets) - 1, np.diff(offsets)
        state = np.repeat(self.begin[None, :], n, axis=0)
        live, at = np.flatnonzero(lengths > 0), 0
        while len(live):
            s, c = state[live], data[offsets[live] + at]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            s = (moved & self.step[c]) | (s & self.stay[c])
            state[live] = s
            at += 1
            # strings that ended, and those whose states can no longer change
            live = live[(lengths[live] > at) & (s & ~self.sink).any(axis=1)]
        # rules lie in the order of their rank, so the lowest final bit is the first rule that matches
        state &= self.final
        word = (state != 0).argmax(axis=1)
        bits = state[np.arange(n), word]
        lowest = np.log2((bits & (~bits + np.uint64(1))).astype(np.float64), where=bits != 0, out=np.zeros(n)).astype(np.int64)
        return np.where(bits != 0, np.searchsorted(self.finals, word * 64 + lowest), -1)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (its name; null if none) and verdict to each row; existing columns of these names are replaced.

    A null or malformed URL has an empty host and path and is matched as the empty string. Of rules of one rank that match the first
    in `rules` counts. Very long URLs are matched whole; repeated ones alike; an empty table stays empty, and without rules all get `default`."""
    small_batches(pages.sparkSession, 4000)
    auto = Automaton(rules)
    shared = pages.sparkSession.sparkContext.broadcast(auto)
    kept = pages.drop("host", "path", "rule", "verdict")
    df = kept.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url))).withColumn("__at", F.concat("host", "path"))
    out = T.StructType([*kept.schema.fields, *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])

    def run(batches):
        a = shared.value
        names = np.array([r.name for r in a.rules] + [None], object)
        verdicts = np.array([r.verdict for r in a.rules] + [default], object)
        for b in batches:
            found = a.first_match(*text_bytes(b.column("__at")))
            cols = [b.column(c) for c in out.names[:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names[found], pa.string()), pa.array(verdicts[found], pa.string())], names=out.names)

    return df.mapInArrow(run, out)
