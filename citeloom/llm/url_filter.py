"""URL filters by a bit-parallel wildcard automaton.

Every rule is a glob over the canonical form of a URL: ``.`` + host + ``#`` + path.
Neither host nor path can hold ``#``, so a rule's host ends where the URL's host ends.
All globs are packed side by side into one multiword Shift-And mask, so one pass
over the characters of a URL runs every pattern at once. The pass is vectorised
over a block of URLs: the state is a (urls x words) matrix of 64-bit masks.

Defined results: a null URL or one without ``://`` has an empty host and an empty
path; no rule fits it, so it gets the default verdict. Repeated URLs get equal rows.
Of several fitting rules the longest wins; of equally long ones, the first listed. URLs of any length are read whole; an
empty table has an empty result; other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ONE = np.uint64(1)
#: URLs that are advanced together; bounds the state matrix.
BLOCK = 4096
#: Stands between host and path; in neither of them (see url_parts).
END = "#"


@dataclass(frozen=True)
class Rule:
    """A host with its path prefix; it fits the host and all of its subdomains."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{escape(self.host)}{END}{escape(self.path)}*"


def escape(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


class Automaton:
    """Glob patterns (``*`` any run, ``?`` any byte, ``\\`` quotes) over byte strings.

    Pattern p has a state bit for each of its symbols plus a start bit. A ``*`` does
    not take a bit: it makes the bit before it stay set on every byte (a self-loop).
    """

    def __init__(self, patterns: Sequence[str]):
        bits: list[tuple[int, ...] | None] = []  # bytes that enter the state; () for any; None for a start bit
        loops, final = [], []
        for pattern in patterns:
            bits.append(None)
            chars = iter(pattern.encode())
            for c in chars:
                if c == ord("*"):
                    loops.append(len(bits) - 1)
                elif c == ord("?"):
                    bits.append(())
                else:
                    bits.append((next(chars, c) if c == ord("\\") else c,))
            final.append(len(bits) - 1)
        self.n = len(patterns)
        self.words = max(1, -(-len(bits) // 64))
        self.enter = np.zeros((257, self.words), np.uint64)  # row 256: past the end of a URL
        self.loop = np.zeros(self.words, np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final = [(f // 64, np.uint64(f % 64)) for f in final]
        for i, symbol in enumerate(bits):
            word, bit = i // 64, ONE << np.uint64(i % 64)
            if symbol is None:
                self.start[word] |= bit
            else:
                for c in symbol or range(256):
                    self.enter[c, word] |= bit
        for i in loops:
            self.loop[i // 64] |= ONE << np.uint64(i % 64)

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """A (urls x patterns) matrix of whole matches."""
        out = np.zeros((len(urls), self.n), bool)
        order = np.argsort([-len(u) for u in urls], kind="stable")
        for at in range(0, len(order), BLOCK):
            block = order[at : at + BLOCK]
            out[block] = self._run([urls[i] for i in block])
        return out

    def _run(self, urls: Sequence[bytes]) -> np.ndarray:
        """urls: the longest first, so that those still running are a prefix."""
        sizes = np.array([len(u) for u in urls])
        data = np.frombuffer(b"".join(urls), np.uint8)
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        state = np.tile(self.start, (len(urls), 1))
        for k in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -k, "left"))
            s = state[:live]
            shifted = s << ONE
            shifted[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = (shifted & self.enter[data[begins[:live] + k]]) | (s & self.loop)
        return np.stack([(state[:, w] >> b) & ONE for w, b in self.final], axis=1).astype(bool) if self.n else np.zeros((len(urls), 0), bool)


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path of a URL; only A-Z of the host are lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(df: DataFrame, rules: Sequence[Rule], key: str, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL: key, host, path, rule (name or null), verdict (allow or block)."""
    automaton = Automaton([r.glob for r in rules])
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    names = np.array([r.name for r in rules] + [None], object)
    verdicts = np.array(["allow" if r.allow else "block" for r in rules] + [default], object)
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            canonical = [f".{h}{END}{p}".encode() for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            hit = automaton.match(canonical)
            best = np.full(len(canonical), len(rules))
            for i in reversed(order):
                best[hit[:, i]] = i
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())], names=schema.names)

    host, path = url_parts(F.col(url))
    return df.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")).mapInArrow(judge, schema).withColumnRenamed("key", key)
