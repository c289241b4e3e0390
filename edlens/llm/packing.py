"""Packing of tokenised documents into sequences of a fixed length: best fit, then swap-based local search."""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edlens.llm import shared as S

#: Words whose tokens a Python worker remembers, half of them new and half older; results do not depend on it.
REMEMBERED = 800_000
#: Bytes of text tokenised at once.
AT_ONCE = 1 << 19
#: Pieces packed in one task, and the fill (in eighths) under which a sequence is opened again in the next round.
GROUP, OPEN_EIGHTHS = 8192, 7

TOKENIZERS: dict = {}


class WordIds:
    """Little-endian 32-bit token ids of words, for a tokenizer in which white space ends every token.

    If the tokenizer's file says that it takes small letters and parts letters from signs (``APART``), a word's signs
    at the end are taken off, ASCII capitals made small, and words of letters encoded many at once, cut after the ids that
    end a word. Other words, and those with the string of an added token, are encoded by themselves. When full, the words of the older half that are not
    asked for again are forgotten.
    """

    #: Fixed value: the end of a pattern that parts letters, digits and signs.
    APART = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: ASCII signs but the apostrophe, which may belong to letters after it.
    SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
    JOINED = 500

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        tokenizer = Tokenizer.from_file(path)
        self.batch = tokenizer.encode_batch_fast
        rules = json.loads(tokenizer.to_str())
        suffix = rules["model"].get("end_of_word_suffix")
        splits = [x["pattern"].get("Regex", "") for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        small = any(x["type"] == "Lowercase" for x in (rules["normalizer"] or {}).get("normalizers", []))
        self.added = [x["content"].lower().encode() for x in rules["added_tokens"]]
        self.apart = bool(suffix) and small and len(splits) == 1 and splits[0].endswith(self.APART) and not any(x.isalpha() for x in self.added)
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def __getitem__(self, word: bytes) -> bytes:
        return self.known[word]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.batch(texts, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        """Makes the ids of all the words known."""
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        fresh = self.unknown(words)
        if not self.apart:
            return self.learn_alone(fresh)
        letters = list(filter(bytes.islower, filter(bytes.isalpha, fresh)))
        others = list(fresh.difference(letters))
        self.learn_joined(letters)
        if not others:
            return
        added = set(filter(self.holds_added, others)) if self.holds_added(b" ".join(others)) else ()
        cores, signs = self.part(others, added)
        wanted = self.unknown({*cores, *signs})
        letters = [w for w in wanted if w.isalpha() or ((t := w.decode()).isalpha() and t.islower())]
        self.learn_alone(wanted.difference(letters))
        self.learn_joined(letters)
        ids = self.known.__getitem__
        self.known.update(zip(others, map(bytes.__add__, map(ids, cores), map(ids, signs))))

    def unknown(self, words: set[bytes]) -> set[bytes]:
        """The words neither known nor remembered; the remembered ones become known."""
        missing = words.difference(self.known)  # as a plain dict, looked up by the hashes that the set holds
        new = missing.difference(self.older)
        again = missing.difference(new)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        return new

    def holds_added(self, text: bytes) -> bool:
        low = text.lower()
        return any(x in low for x in self.added)

    def part(self, words: list[bytes], whole: Collection[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Each word in ASCII small letters and its signs at the end, if the tokenizer surely parts them; not those in ``whole``."""
        cores = [w.rstrip(self.SIGNS) for w in words]
        signs = [w[len(x) :] if len(x) < len(w) else b"" for w, x in zip(words, cores)]
        small = b"\n".join(cores).lower().split(b"\n")
        for i in [i for i, x in enumerate(cores) if words[i] in whole or not (x.isascii() and x[-1:].isalnum())]:
            w, core = words[i], cores[i]
            ends = w not in whole and len(core) < len(w) and not core.isascii() and (last := core.decode()[-1]).isalpha() and last.islower()
            small[i], signs[i] = (core, signs[i]) if ends else (w, b"")
        return small, signs

    def learn_joined(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 20 * self.JOINED):
            groups = [words[k : k + self.JOINED] for k in range(i, min(i + 20 * self.JOINED, len(words)), self.JOINED)]
            for group, ids in zip(groups, self.encode([b" ".join(g).decode() for g in groups])):
                edges = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                if len(edges) != len(group):  # each word has one end at least
                    self.learn_alone(group)
                    continue
                raw = ids.tobytes()
                self.known.update(zip(group, [raw[x:y] for x, y in zip([0, *edges], edges)]))

    def learn_alone(self, words: Iterable[bytes]) -> None:
        words = list(words)
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            self.known.update(zip(part, [ids.tobytes() for ids in self.encode([w.decode() for w in part])]))


def token_bytes(column: pa.Array, path: str) -> Iterator[bytes]:
    """The token ids of each text. ASCII white space bounds tokens here, so words are encoded once each."""
    if path not in TOKENIZERS:
        TOKENIZERS[path] = WordIds(path)
    tokenizer = TOKENIZERS[path]
    for i, j, data, at in S.blocks(column, AT_ONCE):
        raw = data.tobytes()
        texts = [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        tokenizer.learn(set().union(*texts))
        ids = tokenizer.known.__getitem__
        for words in texts:
            yield b"".join(map(ids, words))


def pieces(docs: DataFrame, id_col: str, text: str, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """``row``, ``id``, ``piece``, ``start``, ``length``, ``crc`` (and ``ids``) of each document's pieces."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, tokens in enumerate(token_bytes(batch.column(1), path)):
                tokens += end
                for k, a in enumerate(range(0, len(tokens), 4 * capacity)):
                    part = tokens[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["id", "piece", "start", "length", "crc"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    shape = f"id {kind}, piece int, start long, length long, crc long" + ", ids binary" * with_ids
    cut_up = docs.select(F.col(id_col).alias("id"), S.text_of(text).alias("text")).mapInArrow(cut, shape)
    return S.written(cut_up.withColumn("row", F.monotonically_increasing_id()), "pieces")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # a bit for each amount of room that a bin has
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        at = some >> n
        if at:
            left = n + (at & -at).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
            bins[b].append(i)
        else:
            b, left = len(bins), capacity
            bins.append([i])
        room[left - n].append(b)
        some |= 1 << (left - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, patience: int = 3) -> list[list[int]]:
    """Exchanges between underfull bins that raise the sum of squared fills, until no more bins empty.

    The emptiest bin gives: it moves an item, swaps two of its items for one, or one for a smaller one, into
    a bin that is no emptier; every exchange raises that bin's fill, so the search ends. It stops when
    ``patience`` bins in turn could not be emptied.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    order = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
    failed = 0
    for place, giver in enumerate(order):
        if failed >= patience:
            break
        takers = [b for b in order[place + 1 :] if fill[b] < capacity]
        gained = True
        while gained and bins[giver]:
            gained = False
            for b in takers:
                while fill[b] < capacity and bins[giver] and exchange(bins, fill, lengths, giver, b, capacity):
                    gained = True
        failed = failed + 1 if bins[giver] else 0
    return [b for b in bins if b]


def exchange(bins: list[list[int]], fill: list[int], lengths: list[int], giver: int, taker: int, capacity: int) -> bool:
    """The exchange of two bins that adds most to the taker; whether there was one."""
    free = capacity - fill[taker]
    if fill[taker] < fill[giver]:
        return False
    mine = sorted(bins[giver], key=lambda i: lengths[i])
    sizes = [lengths[i] for i in mine]
    best, give, back = 0, (), None
    k = bisect.bisect_right(sizes, free)
    if k:
        best, give = sizes[k - 1], (mine[k - 1],)
    if best < free:
        for y in bins[taker]:
            n = lengths[y]
            k = bisect.bisect_right(sizes, n + free)
            if k and sizes[k - 1] - n > best:
                best, give, back = sizes[k - 1] - n, (mine[k - 1],), y
            low, high = 0, len(sizes) - 1
            while low < high:
                two = sizes[low] + sizes[high]
                if two > n + free:
                    high -= 1
                    continue
                if two - n > best:
                    best, give, back = two - n, (mine[low], mine[high]), y
                low += 1
            if best == free:
                break
    if not best:
        return False
    for i in give:
        bins[giver].remove(i)
        bins[taker].append(i)
    if back is not None:
        bins[taker].remove(back)
        bins[giver].append(back)
    fill[giver] -= best
    fill[taker] += best
    return True


def pack_group(capacity: int, number: int, last: bool):
    """Packs one group of pieces; sequences with much room come back as open, unless it is the last round."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        lengths = table["length"].to_pylist()
        seat = np.zeros((3, len(lengths)), np.int64)
        group = table["grp"][0].as_py()
        for b, items in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in sorted(items):
                seat[0, i], seat[1, i] = (number << 56) | (group << 24) | b, at
                at += lengths[i]
            seat[2, items] = not last and 8 * at < OPEN_EIGHTHS * capacity
        return pa.table({"row": table["row"], "length": table["length"], "sequence_id": seat[0], "offset": seat[1], "open": pa.array(seat[2].astype(bool))})

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``crc``, ``sequence_id``, ``offset`` (and ``ids``) of every piece.

    A document is its tokens and ``end_id``; only longer ones are cut, every ``capacity`` tokens. Pieces are
    dealt into groups of about 8192, packed each in a task; sequences that stay under seven eighths full are
    opened again and their pieces packed together in the next round, until one group is left, so the whole
    table ends with a few underfull sequences. Nothing but counts reaches the driver.

    Null text: empty, one piece with the end token. Repeated rows: packed each. Null ids: kept. Ties in
    length: the order of the written pieces. Other columns are ignored. An empty table gives no rows.
    ``tokenizer`` must end tokens at ASCII white space (split and lower-cased there).
    """
    cut = pieces(docs, id_col, text, tokenizer, capacity, end_id, with_ids)
    seats = cut.where(F.col("length") == capacity).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < capacity).select("row", "length")
    number, before = 1, None
    while True:
        n = rest.count()
        groups = -(-n // GROUP)
        last = groups <= 1 or n == before
        before = n
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(max(1, groups))))
        done = S.written(dealt.groupBy("grp").applyInArrow(pack_group(capacity, number, last), "row long, length long, sequence_id long, offset long, open boolean"), "packed")
        seats = seats.union(done.where("not open").select("row", "sequence_id", "offset"))
        if last:
            break
        rest = done.where("open").select("row", "length")
        number += 1
    return cut.join(seats, "row").drop("row")
