"""Byte-level BPE: encoding by merge ranks with the tokenizers library, and decoding."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edlens.llm import shared as S

#: Matches whose ids a Python worker remembers; beyond it the memory starts anew, results stay the same.
REMEMBERED = 300_000

CODECS: dict = {}


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for a file of ranks and a pattern whose matches are encoded one by one."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        char = byte_table()
        name = {t: "".join(map(char.__getitem__, t)) for t in ranks}
        merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        tokenizer = Tokenizer(models.BPE(vocab={name[t]: i for t, i in ranks.items()}, merges=merges, ignore_merges=True))
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.encode_batch = tokenizer.encode_batch_fast
        self.find = regex.compile(pattern).findall
        byte = {c: b for b, c in char.items()}
        self.table = {i: bytes(map(byte.__getitem__, name[t])) for t, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        parts = [self.find(x) for x in texts]
        known = self.known
        fresh = list(set().union(*parts) - known.keys())
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list(set().union(*parts))
        for i in range(0, len(fresh), 20_000):
            some = fresh[i : i + 20_000]
            known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, self.encode_batch(some, add_special_tokens=False)))
        return [b"".join(map(known.__getitem__, x)) for x in parts]

    def tokens(self, ids: bytes) -> list[bytes]:
        return list(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.tokens(ids))

    def starts(self, ids: bytes) -> np.ndarray:
        """The code point at which each token starts; tokens within a split character share its place."""
        tokens = self.tokens(ids)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        heads = np.cumsum((raw & 0xC0) != 0x80)
        at = np.cumsum([0, *map(len, tokens)])[:-1]
        return heads[at] - 1 if len(at) else at


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in CODECS:
        CODECS[path, pattern] = Codec(path, pattern)
    return CODECS[path, pattern]


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """``id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every whole text, and ``ids``, ``starts`` if ``full``.

    Each match of ``pattern`` is encoded by itself with the library's byte-level BPE, every pair of ranked
    tokens that makes a ranked token being a merge. The ids are then decoded through the reversed byte table;
    bytes of a character split between tokens meet again, as decoding joins bytes and not characters. ``starts``
    are code points.

    Null or empty text: no tokens and the digests of nothing. Repeated rows and null ids: a row each. Other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(ranks, pattern)
        for batch in batches:
            n, digests, back, ids, starts = [], [], [], [], []
            for _, _, data, at in S.blocks(batch.column(1)):
                raw = data.tobytes()
                for got in both.encode([raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]):
                    n.append(len(got) // 4)
                    digests.append(hashlib.sha256(got).hexdigest())
                    back.append(hashlib.sha256(both.decode(got)).hexdigest())
                    if full:
                        ids.append(np.frombuffer(got, "<u4").tolist())
                        starts.append(both.starts(got).tolist())
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                out += [pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32()))]
                names += ["ids", "starts"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    shape = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, starts array<int>" * full
    return docs.select(F.col(id_col).alias("id"), S.text_of(text).alias("text")).mapInArrow(run, shape)
