"""URL rules and wildcard patterns, all run at once over each URL as one bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edlens.llm import shared as S

#: Bytes of URLs, padded to the longest of a block, that are run together.
AT_ONCE = 1 << 22


@dataclass(frozen=True)
class Rule:
    """A host, with all of its subdomains, and the start of a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Rules of the query, and the patterns that judge what no rule fits.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
BLOCKED = ("**casino**", "**free-bets**", "**cheap-pills**", "**ads-track**")

STAR, ANY_RUN, ONE = "*", "**", "?"


def items(glob: str) -> list[bytes | str]:
    """A glob as literal bytes and wildcards: ``**`` any run, ``*`` a run without '/', ``?`` one byte but '/'."""
    out: list[bytes | str] = []
    i = 0
    while i < len(glob):
        if glob.startswith(ANY_RUN, i):
            out.append(ANY_RUN)
            i += 2
        elif glob[i] in (STAR, ONE):
            out.append(glob[i])
            i += 1
        else:
            out += [bytes([b]) for b in glob[i].encode()]
            i += 1
    return out


def literal(text: str) -> list[bytes | str]:
    return [bytes([b]) for b in text.encode()]


class Automaton:
    """Shift-And over several words: bit i of a pattern says that its first i characters have matched."""

    def __init__(self, patterns: Sequence[list[bytes | str]]):
        bits = sum(1 + sum(x not in (STAR, ANY_RUN) for x in p) for p in patterns)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []
        slash = ord("/")
        bit = 0
        for pattern in patterns:
            self._set(self.start, bit)
            for x in pattern:
                if x in (STAR, ANY_RUN):
                    for c in range(256):
                        if x == ANY_RUN or c != slash:
                            self._set(self.stay[c], bit)
                    continue
                bit += 1
                for c in [x[0]] if isinstance(x, bytes) else [c for c in range(256) if c != slash]:
                    self._set(self.step[c], bit)
            self.ends.append((bit // 64, np.uint64(1 << bit % 64)))
            bit += 1

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << bit % 64)

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Whether each text (row) is matched as a whole by each pattern (column)."""
        out = np.zeros((len(texts), len(self.ends)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        i = 0
        while i < len(order):
            longest = max(1, len(texts[order[i]]))
            part = order[i : i + max(1, AT_ONCE // longest)]
            out[part] = self._run([texts[k] for k in part], longest)
            i += len(part)
        return out

    def _run(self, texts: list[bytes], longest: int) -> np.ndarray:
        chars = np.frombuffer(b"".join(t.ljust(longest, b"\0") for t in texts), np.uint8).reshape(len(texts), longest)
        sizes = np.array([len(t) for t in texts])
        live = np.searchsorted(-sizes, -np.arange(longest), "left")  # rows longer than each place
        state = np.tile(self.start, (len(texts), 1))
        for place in range(int(sizes[0])):
            n = live[place]
            now, c = state[:n], chars[:n, place]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[c]) | (now & self.stay[c])
        return np.stack([(state[:, w] & m) != 0 for w, m in self.ends], 1)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules: Sequence[Rule] = RULES, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict`` of every row.

    Rules and patterns form one automaton over the canonical URL (host in lower case, then path). A rule
    becomes ``host/path**`` and ``*.host/path**``, a star that stops at '/' keeping it within the host; the
    longest rule that fits gives the verdict, equal ones the first in order. Where none fits, ``block`` if a
    pattern of ``blocked`` fits and ``allow`` if not.

    Null url or one without '://': empty host and path, no rule, ``allow``. Repeated rows, null ids and empty
    or very long urls: a row each. Other columns are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    ranked = sorted(rules, key=lambda r: -len(r.name))
    tail: list[bytes | str] = [ANY_RUN]
    automaton = Automaton([p for r in ranked for p in (literal(r.name) + tail, [STAR] + literal("." + r.name) + tail)] + [items(g) for g in blocked])
    names = np.array([r.name for r in ranked] + [None], object)
    verdicts = np.array([r.verdict for r in ranked] + [None], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = S.utf8(batch.column(3))
            raw = data.tobytes()
            hit = automaton.match([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
            k = len(ranked)
            fits = np.append(hit[:, 0 : 2 * k : 2] | hit[:, 1 : 2 * k : 2], np.ones((len(hit), 1), bool), 1)
            first = fits.argmax(1)
            own = np.where(hit[:, 2 * k :].any(1), "block", "allow")
            verdict = np.where(first < k, verdicts[first], own)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(names[first].tolist(), pa.string()), pa.array(verdict.tolist(), pa.string())],
                                             names=["id", "host", "path", "rule", "verdict"])

    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    parts = pages.select(F.col(id_col).alias("id"), host_of(address).alias("host"), path_of(address).alias("path"))
    return parts.withColumn("address", F.concat("host", "path")).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
