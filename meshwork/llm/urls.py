"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed into one multiword Shift-And state: every literal or ``?`` of
every rule owns a bit, ``*`` (any run without a slash) and ``**`` (any run) are
self-loops of the bit before them.  One pass over a canonical URL moves all rules
at once; a batch of URLs is moved together, one character position at a time.

Canonical URL: a dot, the host in lower case, then the path up to ``?`` or ``#``.
Defined results: a null URL, or one without ``://``, has an empty host and path and
fits no rule, so the default verdict is ``allow``; empty tables give empty results;
repeated rows are judged each; an input column named like an output is replaced.

Rules may come as a table of ``verdict, rule``; it is sent to all tasks, and so held to
``MOST_RULES`` rows (more raise an error).  URLs of any length are read ``TILE`` bytes at a
time, and as many together as keep the state within ``STATE_WORDS`` words: memory does not
grow with the longest URL, nor with the number of rules times that of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, without

#: Words that mark an unwanted host where no rule fits, as a label or a part of one between hyphens.
BLOCKED_WORDS = (
    "adult", "ads-track", "casino", "cheap-pills", "free-bets", "spam",
)
MOST_RULES = 100_000
#: Bytes of a URL read at a time, and words of state held together.
TILE, STATE_WORDS = 1024, 1 << 21


class GlobAutomaton:
    """Simulates all globs at once; ``matches`` gives a bool matrix (texts x globs)."""

    def __init__(self, globs: Sequence[str]) -> None:
        parsed = [self._parse(g.encode()) for g in globs]
        bits = sum(len(symbols) + 1 for symbols, _ in parsed)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final = np.zeros(len(globs), np.int64)
        any_byte = np.arange(256)
        no_slash = any_byte[any_byte != ord("/")]
        bit = 0
        for k, (symbols, loops) in enumerate(parsed):
            self._set(self.start, bit)
            for i in range(len(symbols) + 1):
                if i:
                    accepted = no_slash if symbols[i - 1] is None else [symbols[i - 1]]
                    self._set(self.step, bit + i, accepted)
                if loops[i]:
                    self._set(self.loop, bit + i, any_byte if loops[i] == 2 else no_slash)
            self.final[k] = bit + len(symbols)
            bit += len(symbols) + 1

    @staticmethod
    def _set(table: np.ndarray, bit: int, rows=None) -> None:
        value = np.uint64(1) << np.uint64(bit % 64)
        if rows is None:
            table[bit // 64] |= value
        else:
            table[rows, bit // 64] |= value

    @staticmethod
    def _parse(glob: bytes) -> tuple[list[int | None], list[int]]:
        """Symbols (None: any byte but a slash) and the loop after each, the first before all."""
        symbols: list[int | None] = []
        loops = [0]
        i = 0
        while i < len(glob):
            if glob[i : i + 1] == b"*":
                double = glob[i : i + 2] == b"**"
                loops[-1] = max(loops[-1], 1 + double)
                i += 1 + double
            else:
                symbols.append(None if glob[i : i + 1] == b"?" else glob[i])
                loops.append(0)
                i += 1
        return symbols, loops

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        per = max(1, STATE_WORDS // self.words)
        parts = [self._matches([t.encode() for t in texts[at : at + per]]) for at in range(0, len(texts), per)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.final)), bool)

    def _matches(self, raw: list[bytes]) -> np.ndarray:
        sizes = np.array([len(r) for r in raw], np.int64)
        order = np.argsort(-sizes, kind="stable")  # the texts that still go on are always the first ones
        going = sizes[order]
        state = np.tile(self.start, (len(raw), 1))
        for left in range(0, int(sizes.max(initial=0)), TILE):
            reach = order[: int(np.searchsorted(-going, -left, side="left"))]
            tile = np.zeros((len(reach), int(min(TILE, going[0] - left))), np.uint8)
            for row, k in enumerate(reach):
                part = raw[k][left : left + TILE]
                tile[row, : len(part)] = np.frombuffer(part, np.uint8)
            for at in range(tile.shape[1]):
                live = int(np.searchsorted(-going, -(left + at), side="left"))
                now, seen = state[:live], tile[:live, at]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:live] = (moved & self.step[seen]) | (now & self.loop[seen])
        hit = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty((len(raw), len(self.final)), bool)
        out[order] = hit.astype(bool)
        return out


def rule_globs(rule: str) -> str:
    """``host/path`` fits the host and its subdomains, and paths that start with it."""
    host, slash, path = rule.partition("/")
    return f"*.{host}{slash}{path}**"


def word_globs(word: str) -> list[str]:
    """Hosts of which a label, or a part of one between hyphens, is the word."""
    return [f"*{before}{word}{after}" for before in ".-" for after in ("", ".**", "-**", "/**")]


def read_rules(rules: DataFrame | Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules ``(verdict, host/path)``, once each; the longest first, ties in their order as text."""
    if isinstance(rules, DataFrame):
        rows = rules.select("verdict", "rule").filter("verdict IS NOT NULL AND rule IS NOT NULL").distinct().limit(MOST_RULES + 1).collect()
        rules = [(r["verdict"], r["rule"]) for r in rows]
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted(set(rules), key=lambda r: (-len(r[1]), r[1], r[0]))


def host_and_path(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    host = rest[:end].encode().lower().decode()  # bytes lower A-Z alone
    return host, tail[:stop]


def filter_urls(
    pages: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str]],
    url_col: str = "url",
    blocked_words: Sequence[str] = BLOCKED_WORDS,
) -> DataFrame:
    """Add ``host, path, rule, verdict``; ``rules`` are (verdict, ``host/path``), the longest that fits wins.

    Rules of one host and path and unlike verdicts go by the first of these as text (allow).
    """
    ranked = read_rules(rules)
    globs = [rule_globs(r) for _, r in ranked] + [g for w in blocked_words for g in word_globs(w)]
    n = len(ranked)

    @F.pandas_udf("struct<host:string,path:string,rule:string,verdict:string>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = GlobAutomaton(globs)
        names = np.array([r for _, r in ranked] + [None], object)
        verdicts = np.array([v for v, _ in ranked] + [None], object)
        for urls in batches:
            split = [host_and_path(u) for u in urls]
            hit = automaton.matches([f".{h}{p}" for h, p in split])
            first = np.where(hit[:, :n].any(axis=1), hit[:, :n].argmax(axis=1), n) if n else np.zeros(len(split), int)
            plain = np.where(hit[:, n:].any(axis=1), "block", "allow")
            yield pd.DataFrame({
                "host": [h for h, _ in split], "path": [p for _, p in split],
                "rule": names[first], "verdict": np.where(first < n, verdicts[first], plain),
            })

    kept = without(pages, "host", "path", "rule", "verdict", "url_judged").columns
    named = small_batches(pages).withColumn("url_judged", judge(F.col(url_col)))
    return named.select(*[named[f"`{c}`"] for c in kept], "url_judged.*")
