"""Repeated passages of words, found by recompression and removed from all places but the first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edlens.llm import shared as S

#: Rounds of run and pair naming. Two leave symbols whose context is 5 to 10 words, the best fit to 20-word windows.
ROUNDS = 2
#: Place of windows in one number: the first word, and 16 bits of their number.
COUNT = 16
#: What is mixed into word hashes for the second half of a window's hash.
SECOND = np.uint64(0xD1B54A32D192ED03)


class Level:
    """Symbols of one round: name, and the words [low, high) that alone decide that it is formed."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, wall: np.ndarray):
        self.name, self.low, self.high, self.wall = name, low, high, wall


def name_runs(level: Level) -> Level:
    """Each maximal run of one symbol becomes one symbol named by symbol and length."""
    name, wall = level.name, level.wall
    new = np.append(True, (name[1:] != name[:-1]) | wall[1:] | wall[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(name) - 1)
    n = (last - at + 1).astype(np.uint64)
    named = np.where(n > 1, S.mix(name[at] + n * S.BASE), name[at])
    return Level(named, level.low[np.maximum(at - 1, 0)], level.high[np.minimum(last + 1, len(name) - 1)], wall[at])


def name_pairs(level: Level, salt: int) -> Level:
    """Symbols are left or right ones by a bit of their name; each left-right pair gets a name of its own."""
    name, wall = level.name, level.wall
    right = (S.mix(name ^ np.uint64(salt)) >> np.uint64(63)).astype(bool)
    join = np.append(~right[:-1] & right[1:] & ~wall[:-1] & ~wall[1:], False)
    after = np.append(False, join[:-1])
    named = name.copy()
    two = np.flatnonzero(join)
    named[two] = S.mix(name[two] ^ S.mix(name[two + 1] + S.BASE))
    last = len(name) - 1
    low = np.where(right, level.low[np.maximum(np.arange(last + 1) - 1, 0)], level.low)
    high = np.where(right, level.high, level.high[np.minimum(np.arange(last + 1) + 1, last)])
    stay = ~after
    return Level(named[stay], low[stay], high[stay], wall[stay])


def anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of each row their common symbol: row, key, first window, number of windows.

    A window takes, of the symbols whose deciding words lie within it, one of the highest round, and of
    those the one with the least key (name and deciding words, hashed). The choice depends on the words of the
    window only, so equal windows take equal symbols at equal places, wherever they stand.
    """
    rows = len(first) - 1
    n = len(h) + rows + 1
    wall = np.zeros(n, bool)
    wall[first + np.arange(rows + 1)] = True
    stream = np.empty(n, np.uint64)
    stream[~wall] = h
    stream[wall] = np.arange(rows + 1, dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(stream * S.powers(n), out=total[1:])
    back = S.powers(n, np.uint64(pow(int(S.BASE), -1, 1 << 64)))
    place = np.arange(n)
    levels = [Level(stream, place, place + 1, wall)]
    for i in range(ROUNDS):
        levels.append(name_pairs(name_runs(levels[-1]), i + 1))
    walls = np.cumsum(wall)
    todo = np.flatnonzero(walls[window - 1 :] == np.append(0, walls)[: n - window + 1]) if n >= window else np.empty(0, np.int64)
    starts, keys = [], []
    for number in range(ROUNDS, -1, -1):
        x = levels[number]
        free = ~x.wall
        name, low, high = x.name[free], x.low[free], x.high[free]
        key = S.mix(S.mix((total[high] - total[low]) * back[low]) ^ (name + np.uint64(number)))
        begin = np.searchsorted(low, todo)
        count = np.searchsorted(high, todo + window, "right") - begin
        some = count > 0
        s, begin, count = todo[some], begin[some], count[some]
        todo = todo[~some]
        if len(s):
            best = begin.copy()
            for k in range(1, int(count.max())):
                other = np.where(k < count, begin + k, best)
                best = np.where(key[other] < key[best], other, best)
            starts.append(s)
            keys.append(key[best])
    if not starts:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    s, key = np.concatenate(starts), np.concatenate(keys)
    order = np.argsort(s)
    s, key = s[order], key[order]
    at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (s[1:] != s[:-1] + 1)))
    n = np.diff(np.append(at, len(s)))
    most = (1 << COUNT) - 1
    if n.max() > most:  # a long run of one symbol
        cuts = -(-n // most)
        at, n = np.repeat(at, cuts), np.repeat(n, cuts)
        step = (np.arange(len(at)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * most
        at, n = at + step, np.minimum(n - step, most)
    row = walls[s[at]] - 1
    return row, key[at], s[at] - first[row] - row - 1, n


def source(docs: DataFrame, id_col: str, text: str, carry: list[str]) -> DataFrame:
    """``id``, ``doc`` (a hash of id and text), ``row`` (text and carried columns): the same shuffle serves both joins."""
    doc = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), S.text_of(text))
    return docs.select(F.col(id_col).alias("id"), doc.alias("doc"), F.struct(F.col(text).cast("string").alias(S.free(carry, "words")[0]), *carry).alias("row"))


def equal_to_last(*columns: pa.Array) -> np.ndarray:
    """Whether each row but the first equals the one before it in all columns; nulls are equal."""
    same = np.ones(len(columns[0]) - 1, bool)
    for c in columns:
        one, two = c.slice(0, len(c) - 1), c.slice(1)
        equal = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(pc.is_null(one), pc.is_null(two)))
        same &= equal.to_numpy(zero_copy_only=False).astype(bool)
    return same


def repeats(rows: DataFrame, keys: list[str], first_by: list[str] | None = None) -> DataFrame:
    """The other columns of the rows whose ``keys`` occur again; without the first of each key in the order of
    ``first_by``, if given.

    Rows of a key stream past in order, whatever their number; one row is held.
    """
    out = [f for f in rows.schema.fields if f.name not in keys]
    names = [f.name for f in out]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far: it may have a partner in the next batch
        before = False
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            same = np.append(before, equal_to_last(*(batch.column(k) for k in keys)))
            if first_by:  # a repeated row stands where the first stands
                at = np.flatnonzero(np.append(True, ~(same[1:] & equal_to_last(*(batch.column(c) for c in names)))))
                same = np.repeat(same[at], np.diff(np.append(at, batch.num_rows)))
            keep = same[:-1] if first_by else same[:-1] | same[1:]
            yield batch.slice(0, len(keep)).select(names).filter(pa.array(keep))
            held, before = batch.slice(batch.num_rows - 1, 1), bool(same[-1])
        if held is not None and before:
            yield held.select(names)

    order = [*keys, *(F.col(c).asc_nulls_first() for c in first_by or ())]
    return rows.repartition(S.wide(rows), *keys).sortWithinPartitions(*order).mapInArrow(scan, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out))


def attach(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Texts with their ``places``: both sides are dealt by ``doc`` alone, ids that differ under one hash stay apart."""
    ids = "id" in found.columns
    found = found.select(F.col("doc").alias("__doc"), *([F.col("id").alias("__id")] if ids else []), "places")
    on = texts["doc"] == found["__doc"]
    if ids:  # not as a join key, so that one shuffle of texts serves both joins
        on = on & F.coalesce(texts["id"] == found["__id"], texts["id"].isNull() & found["__id"].isNull())
    return texts.join(found, on, how).select("id", "doc", "row", "places")


def first_in_row(row: np.ndarray, key: np.ndarray, two: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Indices of the first of equal keys within each row."""
    order = np.lexsort((start, two, key, row))
    row, key, two = row[order], key[order], two[order]
    return order[np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (two[1:] != two[:-1]))[: len(order)]]


def repeated_windows(texts: DataFrame, window: int) -> DataFrame:
    """``id``, ``doc``, ``places``: the first words of windows that also start in an earlier document.

    Symbols named in rounds (runs, then pairs) by hashing are the same everywhere without a common
    dictionary. Those that occur again point to the candidate windows, which are then compared by 128 bits of hash of all
    their words; the first place stays. Of equal windows within a document only the first is compared with others.
    Sorted rows stream through both comparisons. Where two documents share the hash ``doc``, each is asked for the
    candidates of both, which changes no result.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(1).to_numpy()
            for i, j, data, at in S.blocks(batch.column(2).field(0)):
                starts, ends, first = S.word_bounds(data, at)
                row, key, begin, n = anchors(S.word_hashes(data, starts, ends), first, window)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(docs[i:j][row]), pa.array((begin << COUNT) | n)], names=["key", "doc", "place"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, places = batch.column(1).to_numpy(), batch.column(3)
            flat, offsets = places.flatten().to_numpy(), np.append(0, np.cumsum(places.value_lengths().to_numpy()))
            for i, j, data, at in S.blocks(batch.column(2).field(0)):
                starts, ends, first = S.word_bounds(data, at)
                h = S.word_hashes(data, starts, ends)
                one, two = S.window_hashes(h, window), S.window_hashes(S.mix(h ^ SECOND), window)
                mine = flat[offsets[i] : offsets[j]]
                row = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
                begin, n = mine >> COUNT, mine & ((1 << COUNT) - 1)
                row = np.repeat(row, n)
                start = np.repeat(begin - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
                own = start <= np.diff(first)[row] - window  # others belong to a document of the same hash
                row, start = row[own], start[own]
                key, other = one[first[:-1][row] + start], two[first[:-1][row] + start]
                some = first_in_row(row, key, other, start)
                row, key, other, start = row[some], key[some], other[some], start[some]
                ids = batch.column(0).slice(i, j - i).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(other.view(np.int64)), ids, pa.array(docs[i:j][row]), pa.array(start)], names=["key", "other", "id", "doc", "place"])

    named = texts.mapInArrow(name, "key long, doc long, place long")
    shared = S.written(repeats(named, ["key"]).groupBy("doc").agg(F.collect_list("place").alias("places")), "shared-symbols")
    windows = attach(texts, shared, "inner").mapInArrow(candidates, f"key long, other long, id {kind}, doc long, place long")
    return repeats(windows, ["key", "other"], ["id", "doc", "place"]).groupBy("id", "doc").agg(F.collect_list("place").alias("places"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (the carried columns), ``n_words``, ``n_removed``, ``kept_sha256``, ``kept_text``.

    A word goes when a window of ``window`` words that covers it also starts earlier: in a document of a
    smaller id, or earlier in its own. ``kept_text`` holds the words left, joined by one space, and is null where
    nothing goes. Overlapping copies within a document count as they stand.

    Null or empty text: no words, empty kept text. Null ids come before all others. Rows of one id and one text
    are one document and fare alike; other texts of the same id are ordered by a 64-bit hash. Further columns matter only
    if named in ``carry`` (by default the id alone) and stay within ``row``, so names cannot clash.
    """
    carry = [id_col] if carry is None else carry
    texts = source(docs, id_col, text, carry)
    joined = attach(texts, repeated_windows(texts, window), "left")
    kind = docs.select(F.struct(*carry).alias("row")).schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, places = batch.column(2).flatten(), batch.column(3)
            words, removed, digests, kept = [], [], [], []
            for i, _, data, at in S.blocks(fields[0]):
                starts, ends, first = S.word_bounds(data, at)
                grams = S.window_hashes(S.word_hashes(data, starts, ends), window)
                raw = data.tobytes()
                for k in range(len(at) - 1):
                    out = all_words = raw[at[k] : at[k + 1]].split()
                    mine = grams[first[k] : max(first[k], first[k + 1] - window + 1)]
                    known, once = np.unique(mine, return_index=True)
                    gone = np.ones(len(mine), bool)
                    gone[once] = False
                    if places[i + k].is_valid:
                        gone[places[i + k].values.to_numpy()] = True
                    if gone.any():
                        edge = np.zeros(len(all_words) + 1, np.int64)
                        edge[: len(gone)] += gone
                        edge[window : window + len(gone)] -= gone
                        out = [w for w, x in zip(all_words, (np.cumsum(edge) > 0).tolist()) if not x]
                    joined_words = b" ".join(out)
                    words.append(len(all_words))
                    removed.append(len(all_words) - len(out))
                    digests.append(hashlib.sha256(joined_words).hexdigest())
                    kept.append(joined_words.decode() if removed[-1] else None)
            row = pa.StructArray.from_arrays(fields[1:], names=carry)
            yield pa.RecordBatch.from_arrays([row, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                                             names=["row", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return joined.mapInArrow(cut, f"row {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
