"""Near-duplicate documents: an exact Jaccard self-join of word n-grams in size-banded tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edlens.llm import shared as S
from edlens.llm.components import components

#: Cells of the document-frequency table that orders shingles, one byte each: a fixed 16 MB in each task.
LOAD_BITS = 24
#: Pieces in which a task hands in its counts.
CHUNKS = 64
#: Bits of a bitmap for each shingle of the longest set in its band.
BITS_PER_SHINGLE = 4
#: Members compared with one leader inside one task; larger sets of them are salted.
MEMBERS_PER_TASK = 256
#: Members from which a tile brings bitmaps, and the partners each of them names before all others are tried.
LARGE_TILE, NEAREST = 32, 2
#: Pairs from which texts are picked by a table of bits before they are sent anywhere, and the bits of that table (2 MB).
MANY_PAIRS, PICK_BITS = 4096, 24
#: Members, on average, of a block of a tile; a task holds two blocks at a time.
BLOCK = 1024


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct ``words``-word shingles, A-Z in lower case.

    A shorter text is one shingle, a text without words (or null) an empty set.
    """
    for _, _, data, at in S.blocks(column):
        starts, ends, first = S.word_bounds(data, at)
        h = S.word_hashes(S.LOWER[data], starts, ends)
        grams = S.window_hashes(h, words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                yield S.window_hashes(h[a:b], b - a)
            else:
                yield np.empty(0, np.uint64)


def cell(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << LOAD_BITS) - 1)).astype(np.int64)


def load_code(count: np.ndarray) -> np.ndarray:
    """Counts on a scale of one byte: exact below 16, then eight steps to a doubling."""
    exact = np.maximum(count, 1)
    return np.where(count < 16, count, np.minimum(16 + 8 * np.log2(exact / 16), 255)).astype(np.uint8)


def cell_loads(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """Shingles of all documents per hash cell, as codes: a table of fixed size, summed in Spark.

    A task counts up to 255 in a cell and hands in the counts compressed; sums stream through sorted partitions.
    """
    size = 1 << LOAD_BITS
    part = size // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint8)
        for batch in batches:
            for grams in shingle_sets(batch.column(0), words):
                at = cell(grams)
                total[at] += total[at] < 255
        if total.any():
            packer = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "loads": pa.array([packer.compress(x.tobytes()) for x in total.reshape(CHUNKS, -1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(part, np.int64)
        packer, unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        out = lambda: pa.RecordBatch.from_pydict({"chunk": pa.array([now], pa.int32()), "loads": pa.array([packer.compress(load_code(total).tobytes())], pa.binary())})
        for batch in batches:
            for chunk, loads in zip(batch.column(0).to_pylist(), batch.column(1)):
                if chunk != now and now is not None:
                    yield out()
                    total[:] = 0
                now = chunk
                total += np.frombuffer(unpacker.decompress(loads.as_buffer()), np.uint8)
        if now is not None:
            yield out()

    counts = docs.select(S.text_of(text).alias("text")).mapInArrow(count, "chunk int, loads binary")
    sums = counts.repartition(S.wide(docs), "chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, loads binary").collect()  # one row per chunk
    out = np.zeros((CHUNKS, part), np.uint8)
    unpacker = zstandard.ZstdDecompressor()
    for row in sums:
        out[row["chunk"]] = np.frombuffer(unpacker.decompress(bytes(row["loads"])), np.uint8)
    return out.reshape(-1)


def bitmap_width(n: int) -> int:
    """Bits for a set of n: the power of two of its band, so that at most a quarter are set."""
    return max(64, 1 << int(n * BITS_PER_SHINGLE - 1).bit_length()) if n else 64


def bitmap(grams: np.ndarray) -> bytes:
    width = bitmap_width(len(grams))
    bits = np.zeros(width, np.uint8)
    bits[((grams >> np.uint64(LOAD_BITS)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """No fewer than the common shingles: each bit set on one side only costs that side one."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(nx - int(np.bitwise_count(a & ~b).sum()), ny - int(np.bitwise_count(b & ~a).sum()))


def signatures(docs: DataFrame, id_col: str, text: str, words: int, percent: int) -> DataFrame:
    """One row per document: ``id``, ``mark`` (text hash), ``n``, ``set`` (two hashes), ``prefix``, ``bits``.

    Two sets that reach the threshold share a shingle among the first n - ceil(t n) + 1 of both in any
    common order; the order is by the load of a shingle's cell, so frequent passages come last.
    """
    loads = docs.sparkSession.sparkContext.broadcast(cell_loads(docs, text, words))
    id_type = docs.schema[id_col].dataType

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loads.value
        for batch in batches:
            sizes, s1, s2, prefix, bits = [], [], [], [], []
            for grams in shingle_sets(batch.column(2), words):
                n = len(grams)
                digest = xxhash.xxh3_128_intdigest(grams.tobytes())
                sizes.append(n)
                s1.append((digest >> 64) - (1 << 63))
                s2.append((digest & (2**64 - 1)) - (1 << 63))
                keep = n + (-percent * n // 100) + 1 if n else 0
                prefix.append(grams[np.lexsort((grams, table[cell(grams)]))[:keep]].view(np.int64))
                bits.append(bitmap(grams))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate(prefix) if prefix else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists, pa.array(bits, pa.binary())], names=["id", "mark", "n", "s1", "s2", "prefix", "bits"])

    body = S.text_of(text)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("mark"), body.alias("text")).mapInArrow(
        sign, f"id {id_type.simpleString()}, mark long, n long, s1 long, s2 long, prefix array<long>, bits binary")


def tiles(prefixes: DataFrame, percent: int) -> DataFrame:
    """``key``, ``n``, ``cls``, ``lead``, ``room`` of the classes that share a prefix shingle, in size bands.

    Rows of a key come sorted by size; the first opens a band and leads it, the first that is too large to
    reach the threshold with it opens the next. Keys of one class are left out. ``room``: were this the first common
    shingle of a class and its leader, what stands behind its place ``at`` in either could still reach the
    threshold; true in some key of every similar pair. Rows stream through: a task holds a batch of them, the leader, its size and place.
    """

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, size, place = None, 0, 0, 0
        waiting = [np.empty(0, np.int64)] * 4  # a first row of a key that may be its only one
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, cls, at = (np.concatenate([w, batch.column(i).to_numpy()]) for i, w in enumerate(waiting))
            new = np.append(last is None or key[0] != last, key[1:] != key[:-1])
            end = len(key) - int(new[-1])
            waiting = [x[end:] for x in (key, n, cls, at)]
            last = int(key[end - 1]) if end else last
            many = ~(new & np.append(new[1:], True))
            key, n, cls, at, new = key[many], n[many], cls[many], at[many], new[many]
            leads, sizes, places = (np.empty(len(cls), np.int64) for _ in range(3))
            for i, (first, m, c, k) in enumerate(zip(new.tolist(), n.tolist(), cls.tolist(), at.tolist())):
                if first or percent * m > 100 * size:
                    now, size, place = c, m, k
                leads[i], sizes[i], places[i] = now, size, place
            if len(key):
                room = (100 + percent) * np.minimum(n - at, sizes - places) >= percent * (n + sizes)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(cls), pa.array(leads), pa.array(room)], names=["key", "n", "cls", "lead", "room"])

    rows = prefixes.select("key", "n", "cls", "at").repartition(S.wide(prefixes), "key").sortWithinPartitions("key", "n", "cls")
    return rows.mapInArrow(band, "key long, n long, cls long, lead long, room boolean")


def seated(rows: DataFrame, percent: int) -> DataFrame:
    """``key``, ``n``, ``cls``, ``root`` of large tiles with the ``block`` of each member.

    Each root with a quarter of a block or more is apart from the others, sizes fall in bands of which only neighbours
    can reach the threshold, and a hash of the class cuts a band into blocks of about BLOCK members.
    """
    apart = rows.groupBy("key", "root").agg(F.count("*").alias("c")).where(F.col("c") * 4 >= BLOCK).select("key", "root", F.lit(True).alias("apart"))
    band = F.floor(F.log("n") / float(np.log(max(100 / percent, 1.01))))
    rows = rows.join(apart, ["key", "root"], "left").withColumn("cell", F.xxhash64(F.when(F.col("apart"), F.col("root")), F.col("apart").isNotNull(), band))
    cells = rows.groupBy("key", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    return rows.join(cells, ["key", "cell"]).select("key", "n", "cls", "root", F.xxhash64("cell", F.pmod(F.xxhash64("cls"), F.col("blocks"))).alias("block"))


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """``key``, ``n``, ``cls``, ``root``, ``one``, ``two``, ``block`` of the members of each two blocks (or one with
    itself) of a large tile whose sizes and roots can still meet."""
    rows = S.written(seated(rows, percent), "blocks")
    blocks = rows.groupBy("key", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    x = blocks.select("key", F.col("block").alias("one"), F.struct("n0", "n1", "r0", "r1").alias("x"))
    y = blocks.select("key", F.col("block").alias("two"), F.struct("n0", "n1", "r0", "r1").alias("y"))
    sizes = (100 * F.col("x.n1") >= percent * F.col("y.n0")) & (100 * F.col("y.n1") >= percent * F.col("x.n0"))
    pairs = x.join(y, "key").where((F.col("one") <= F.col("two")) & sizes & (F.least("x.r0", "y.r0") < F.greatest("x.r1", "y.r1")))
    asked = pairs.select("key", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    return rows.join(asked, ["key", "block"]).select("key", "n", "cls", "root", "one", "two", "block")


def crossing(tile_rows: DataFrame, classes: DataFrame, percent: int, nearest: int | None = None) -> DataFrame:
    """Pairs ``a``, ``b`` of classes in a tile that are still in different components and of fitting size.

    Members of a large tile carry their bitmaps, and only pairs with room for the threshold come out (``seen``); with
    ``nearest``, large tiles alone are asked, and each member names just that many of the closest ones before it.
    Tiles of more than BLOCK members meet in pairs of blocks, so a task holds two blocks at most.
    """
    split = tile_rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low <> high")
    split = S.written(split.select("key", (F.col("m") > LARGE_TILE).alias("large"), (F.col("m") > BLOCK).alias("cut")), "split")
    rows = tile_rows.join(split.where("not cut"), "key").withColumns({c: F.lit(0).cast("long") for c in ("one", "two", "block")})
    fields = ["key", "one", "two", "n", "cls", "root", "block"]
    large = rows.where("large").select(fields)
    if split.where("cut").take(1):
        large = large.union(meetings(tile_rows.join(split.where("cut"), "key"), percent).select(fields))
    large = large.join(classes.select("cls", "bits"), "cls").select(*fields, "bits")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if row[:3] != key:
                    yield from meet(key, tile)
                    key, tile = row[:3], []
                tile.append(row[3:])
        yield from meet(key, tile)

    def meet(key: tuple | None, tile: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not tile:
            return
        n, cls, root, block = (np.array([r[i] for r in tile], np.int64) for i in range(4))
        widths = np.array([len(r[4]) for r in tile])
        packed = {w: np.frombuffer(b"".join(r[4] for r in tile if len(r[4]) == w), np.uint64).reshape(-1, w // 8) for w in set(widths.tolist())}
        place = np.array([0] * len(tile))
        for w in packed:
            place[widths == w] = np.arange(int((widths == w).sum()))
        first = np.searchsorted(100 * n, percent * n)  # smallest partner by size
        both = key[1] != key[2]
        others = {x: np.flatnonzero(block != x if both else block == x) for x in key[1:]}
        out, held = [], 0
        for i in range(len(tile)):
            j = others[tile[i][3]]
            j = j[np.searchsorted(j, first[i]) : np.searchsorted(j, i)]
            j = j[root[j] != root[i]]
            bound = np.zeros(len(j), np.int64)
            if len(j):
                mine = packed[widths[i]][place[i]]
                for w in (widths[i], widths[i] // 2):
                    some = widths[j] == w
                    if w != widths[i]:
                        mine = mine[: len(mine) // 2] | mine[len(mine) // 2 :]
                    if some.any():
                        theirs = packed[w][place[j[some]]]
                        bound[some] = np.minimum(n[i] - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), n[j[some]] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))
                room = (100 + percent) * bound >= percent * (n[i] + n[j])
                j, bound = j[room], bound[room]
                if nearest is not None and len(j) > nearest:
                    close = np.argsort(n[j] - 2 * bound, kind="stable")[:nearest]
                    j, bound = j[close], bound[close]
            if len(j):
                out.append((np.minimum(cls[j], cls[i]), np.maximum(cls[j], cls[i]), np.full(len(j), cls[i]), n[j] - 2 * bound))
                held += len(j)
            if held > 50_000 or (held and i == len(tile) - 1):
                a, b, late, gap = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_pydict({"key": np.full(held, key[0]), "a": a, "b": b, "late": late, "gap": gap})
                out, held = [], 0

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4  # the last tile so far: it may go on in the next batch
        for batch in batches:
            rows = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            end = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            held = [x[end:] for x in rows]
            yield from steps(*(x[:end] for x in rows))
        yield from steps(*held)

    def steps(key: np.ndarray, n: np.ndarray, cls: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Each row with the row one, two, ... places on, as far as a tile reaches."""
        i, step = np.arange(len(key)), 0
        while len(i):
            step += 1
            i = i[i + step < len(key)]
            i = i[key[i + step] == key[i]]
            x = i[(root[i] != root[i + step]) & (100 * n[i] >= percent * n[i + step])]
            one, two = cls[x], cls[x + step]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    pairs = large.repartition(S.wide(tile_rows), "key", "one", "two").sortWithinPartitions("key", "one", "two", "n", "cls").mapInArrow(pair, "key long, a long, b long, late long, gap long")
    if nearest is not None:  # of all blocks that a member met
        pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("key", "late").orderBy("gap", "a", "b"))).where(F.col("rank") <= nearest)
    pairs = pairs.select("a", "b", F.lit(True).alias("seen"))
    if nearest is None:
        small = rows.where("not large").select("key", "n", "cls", "root").repartition(S.wide(tile_rows), "key").sortWithinPartitions("key", "n", "cls")
        pairs = pairs.union(small.mapInArrow(beside, "a long, b long").withColumn("seen", F.lit(False)))
    return pairs.groupBy("a", "b").agg(F.max("seen").alias("seen"))


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps leave room for the threshold."""

    def room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(i).to_pylist() for i in range(6))
            bound = np.array([overlap_bound(p, m, q, n) for p, m, q, n in zip(x, na, y, nb)], np.int64)
            size = np.array(na, np.int64) + np.array(nb, np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * bound >= percent * size))

    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(room, "a long, b long")


def class_texts(members: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``cls`` and the text of its first document (repeated if that row is): a written table."""
    heads = members.select("cls", F.col("id").alias("head"), F.col("mark").alias("head_mark"))
    body = S.text_of(text)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("mark"), body.alias("text"))
    return S.written(source.join(heads, source["id"].eqNullSafe(heads["head"]) & (source["mark"] == heads["head_mark"])).select("cls", "text"), "texts")


def picked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose class may be in ``wanted``: by a bit for each of 2^PICK_BITS cells, so a few others stay."""
    part = 1 << 15  # bits of one of Spark's bitmaps
    at = F.col("cls").bitwiseAND((1 << PICK_BITS) - 1)
    found = wanted.select(F.shiftright(at, 15).alias("part"), (at % part).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    table = np.zeros(((1 << PICK_BITS) // part, part // 8), np.uint8)
    for row in found:
        table[row["part"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    bits = texts.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy() & ((1 << PICK_BITS) - 1)
            yield batch.filter(pa.array((bits.value[x >> 3] >> (x & 7)) & 1 == 1))

    return texts.select("cls", "text").mapInArrow(keep, "cls long, text string")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """A written table of the pairs whose shingle sets, cut again from the texts, reach the threshold.

    Sets meet at the smaller class: its text goes to every salt of its members, and members follow it. The texts of
    repeated rows come one after the other, and the first counts.
    """
    pairs = S.written(pairs, "candidates")
    salt = F.abs(F.hash("b")) % F.greatest(F.lit(1), F.ceil(F.col("m") / MEMBERS_PER_TASK)).cast("int")
    counts = pairs.groupBy("a").agg(F.count("*").alias("m"))
    seats = pairs.join(counts, "a").select("a", "b", salt.alias("salt"))
    seats = S.written(seats, "pairs")
    asked = seats.select("a", "salt", F.col("b").alias("cls")).union(seats.select("a", "salt", F.col("a").alias("cls")).distinct())
    if pairs.count() > MANY_PAIRS:
        texts = picked(texts, pairs.select(F.explode(F.array("a", "b")).alias("cls")))
    rows = asked.join(texts, "cls").select("a", "salt", "cls", "text").repartition(S.wide(pairs), "a", "salt")
    rows = rows.withColumn("rest", F.col("a") != F.col("cls")).sortWithinPartitions("a", "salt", "rest", "cls")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mine, last = None, None, None
        for batch in batches:
            a, cls, rest = (batch.column(i).to_pylist() for i in (0, 2, 4))
            good = []
            for i, grams in enumerate(shingle_sets(batch.column(3), words)):
                again, last = (a[i], cls[i]) == last, (a[i], cls[i])
                if again:
                    good.append(False)
                    continue
                if not rest[i]:
                    head, mine = a[i], grams
                    good.append(False)
                    continue
                common = len(np.intersect1d(mine, grams, assume_unique=True)) if head == a[i] else 0
                good.append(100 * common >= percent * (len(mine) + len(grams) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = S.written(rows.select("a", "salt", "cls", "text", "rest").mapInArrow(check, "a long, b long"), "near-links")
    S.forget(seats, pairs)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id``, ``mark``, ``n_shingles``, ``cls``, ``component_id``, ``head``.

    Documents link when the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``percent`` / 100; ``component_id`` is the smallest id reachable by links. The join is exact: equal sets
    form one class, classes meet in tiles of (prefix shingle, size band), bitmap signatures bound the overlap
    from above, and sorted arrays decide. Each tile first compares its members with the band's leader, large tiles
    then each with its nearest by bitmap while that finds links, and at last all pairs that are still in different
    components, so a large group of near copies costs a few comparisons per member.

    Null text and text without words: an empty set, linked with nothing, ``component_id`` its own id. Repeated
    rows and exact copies: the same class, one row each. Null ids: kept, and never a component's id unless all
    of its ids are null. Other columns of ``docs`` are ignored. ``head`` marks one row per component (equal
    rows share the mark). Shingles are equal when their 64-bit hashes are.
    """
    signs = S.written(signatures(docs, id_col, text, words, percent), "signatures")
    documents = S.written(signs.select("id", "mark", "n", F.col("s1").alias("cls")), "documents")
    full = signs.where("n > 0")
    heads = F.min_by(F.struct("id", "mark", "prefix", "bits"), F.struct(F.col("id").isNull(), "id", "mark")).alias("r")
    classes = S.written(full.groupBy("s1", "s2", "n").agg(heads).select(F.col("s1").alias("cls"), "n", "r.*"), "classes")
    S.forget(signs)
    rows = S.written(tiles(classes.select(F.posexplode("prefix").alias("at", "key"), "n", "cls"), percent), "tiles")
    stars = rows.where("cls <> lead and room").select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct()
    members = S.written(classes.select("cls", "n", "id", "mark", "bits").join(rows.select("cls").distinct(), "cls", "left_semi"), "members")
    texts = class_texts(members, docs, id_col, text)

    def linked(pairs: DataFrame) -> DataFrame:
        return verified(bounded(pairs, members, percent), texts, words, percent)

    def crossed(known: DataFrame, members: DataFrame, nearest: int | None) -> DataFrame:
        """Links among the pairs of tiles; those that met by bitmap are not bounded again."""
        pairs = crossing(known, members, percent, nearest)
        if nearest is not None:
            return verified(pairs.select("a", "b"), texts, words, percent)
        pairs = S.written(pairs, "crossing")
        links = verified(pairs.where("seen").select("a", "b").union(bounded(pairs.where("not seen"), members, percent)), texts, words, percent)
        S.forget(pairs)
        return links

    def rooted(known: DataFrame, roots: DataFrame) -> DataFrame:
        met = known.select("key", "n", "cls").join(roots, known["cls"] == roots["node"], "left")
        return S.written(met.select("key", "n", "cls", F.coalesce("root", "cls").alias("root")), "rooted")

    def joined_up(roots: DataFrame, found: DataFrame) -> DataFrame:
        """Components of the stars so far and the new links."""
        return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    found = linked(stars)
    roots = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = rooted(rows.join(rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > LARGE_TILE).select("key"), "key", "left_semi"), roots)
    near = S.written(members.select("cls", "bits").join(known.select("cls").distinct(), "cls", "left_semi"), "near-members")
    while (found := crossed(known, near, NEAREST)).take(1):  # asks large tiles alone
        roots = joined_up(roots, found)
        old, known = known, rooted(known, roots)
        S.forget(old, found)
    old, known = known, rooted(rows, roots)
    S.forget(old, near)
    if (found := crossed(known, members, None)).take(1):
        roots = joined_up(roots, found)
    # Names by class: the documents of a large class or component never meet in one task.
    rooted_classes = classes.select("cls", "id", "mark").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "id", "mark", F.coalesce("root", "cls").alias("root"))
    rooted_classes = S.written(rooted_classes, "class-roots")
    names = S.written(rooted_classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("void"), "id", "cls", "mark")).alias("h")), "names")
    named = S.written(rooted_classes.select("cls", "root").join(names, "root").select(F.col("cls").alias("c"), "h"), "class-names")
    S.forget(known, rows, members, texts, classes, rooted_classes, names)
    joined = documents.where("n > 0").join(named, F.col("cls") == F.col("c")).select("id", "mark", F.col("n").alias("n_shingles"), "cls", F.col("h.id").alias("component_id"),
                                               (F.col("id").eqNullSafe(F.col("h.id")) & (F.col("cls") == F.col("h.cls")) & (F.col("mark") == F.col("h.mark"))).alias("head"))
    alone = documents.where("n = 0").select("id", "mark", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("cls"), F.col("id").alias("component_id"), F.lit(True).alias("head"))
    return joined.union(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one of the smallest id.

    Rows without words all stay; of equal repeated rows one stays.
    """
    found = near_duplicates(docs, id_col, text, words, percent)
    row, mark, own, bare = S.free(docs.columns, "head_id", "head_mark", "mark", "bare")
    heads = found.where("head").select(F.col("id").alias(row), F.col("mark").alias(mark), (F.col("n_shingles") == 0).alias(bare)).distinct()
    marked = docs.withColumn(own, F.xxhash64(S.text_of(text)))
    kept = marked.join(heads, marked[id_col].eqNullSafe(heads[row]) & (F.col(own) == F.col(mark)))
    wordless = kept.where(F.col(bare)).select(*docs.columns)
    return kept.where(~F.col(bare)).dropDuplicates([id_col, own]).select(*docs.columns).union(wordless)
