"""Token counts of whole texts, with huge documents encoded in overlapping chunks that are spliced."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edlens.llm import shared as S

#: Bytes from which a document is huge, of a chunk, and of the first overlap of two chunks.
HUGE, CHUNK, OVERLAP = 1 << 16, 1 << 15, 256
#: Units whose counts a Python worker remembers; beyond it the memory starts anew, results stay the same.
REMEMBERED = 400_000
UNIT = re.compile(" *[^ ]+| +")
BLANK = "▁"

COUNTERS: dict = {}


class Counter:
    """Token counts under one sentencepiece model.

    The model writes a space as U+2581. If no piece holds one after another character, no merge
    crosses the place before a space: such a place is a stable boundary, and counts add up over it.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.stable = not any(re.search(f"[^{BLANK}]{BLANK}", x) for x in names) and self.plain()
        self.known: dict[str, int] = {}

    def plain(self) -> bool:
        """The model keeps characters and runs of spaces as they are."""
        probe = "A  b\tＣ é\n c"
        return self.model.decode(self.model.encode(probe)) == probe

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the library gives them for the whole text."""
        if not self.stable:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        units: list[list[str]] = []
        for text in texts:
            text = text.replace(BLANK, " ")
            if "  " in text or text[:1] == " " or text[-1:] == " ":
                found = UNIT.findall(text)
                units.append(found[:1] + [x[1:] for x in found[1:]])
            else:
                units.append(text.split(" ") if text else [])
        known = self.known
        fresh = list(set().union(*units) - known.keys())
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list(set().union(*units))
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            known.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
        if "" in known:  # a single space at the end of a text
            known[""] = len(self.model.encode("a ", num_threads=1)) - len(self.model.encode("a", num_threads=1))
        return [sum(map(known.__getitem__, x)) for x in units]

    def spans(self, raw: bytes, a: int, b: int, spliced: bool = False) -> np.ndarray:
        """First bytes, within the whole text, of the tokens of raw[a:b].

        The model puts a space in front; at a splice it stands for the one that is there.
        """
        skip = (1 if raw[a] == 32 else len(BLANK.encode())) if spliced else 0
        out = a + skip + np.array([p.begin for p in self.model.encode(raw[a + skip : b].decode(), return_type="proto").pieces], np.int64)
        out[:1] = a
        return out

    def count_huge(self, raw: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a huge text: chunks that overlap, cut at a boundary both of them have.

        A common boundary counts if it is stable: the byte starts a space, the one before does not, and
        the right chunk has had a stable boundary before it or starts there. Where the overlap
        has none it is doubled, in the end up to the whole text.
        """
        total, start, end = 0, 0, self.edge(raw, min(chunk, len(raw)))
        left = self.spans(raw, start, end)
        while end < len(raw):
            width = overlap
            while True:
                begin = self.edge(raw, max(start, end - width))
                if begin <= start:
                    end = self.edge(raw, min(len(raw), start + 2 * (end - start)))
                    left = self.spans(raw, start, end, start > 0)
                    break
                stop = self.edge(raw, min(len(raw), begin + max(chunk, 2 * width)))
                right = self.spans(raw, begin, stop)
                common = [p for p in np.intersect1d(left[left > begin], right).tolist() if p < end and self.boundary(raw, p)]
                if common:
                    cut = common[len(common) // 2]
                    total += int((left[left >= start] < cut).sum())
                    start, end, left = cut, stop, right[right >= cut]
                    break
                width *= 2
        return total + len(left)

    @staticmethod
    def edge(raw: bytes, at: int) -> int:
        """The first place from ``at`` on where a character starts."""
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    @staticmethod
    def boundary(raw: bytes, p: int) -> bool:
        mark = BLANK.encode()
        return (raw[p] == 32 or raw[p : p + 3] == mark) and raw[p - 1] != 32 and raw[p - 3 : p] != mark


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every whole text.

    Counts equal those of the sentencepiece library over the whole text, without begin or end tokens. Texts from
    64 KB on are encoded in overlapping chunks with offsets and spliced where both chunks have the same stable
    boundary; overlaps widen where they share none. Shorter texts are counted by their units between
    stable boundaries, each distinct unit encoded once per task's batch; for a model without stable boundaries
    the library encodes them whole.

    Null or empty text: no bytes, no tokens. Repeated rows and null ids: a row each. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in COUNTERS:
            COUNTERS[model] = Counter(model)
        counter = COUNTERS[model]
        for batch in batches:
            sizes, tokens = [], []
            for i, j, data, at in S.blocks(batch.column(1)):
                raw = data.tobytes()
                rows = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                sizes += map(len, rows)
                huge = [len(x) >= HUGE and counter.stable for x in rows]
                short = iter(counter.count([x.decode() for x, h in zip(rows, huge) if not h]))
                tokens += [counter.count_huge(x) if h else next(short) for x, h in zip(rows, huge)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                                             names=["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("id"), S.text_of(text).alias("text")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
