"""Languages of documents as mixtures: expectation-maximisation over n-gram likelihoods, with a penalty per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edlens.llm import shared as S

#: Cells of the n-gram table; a model is 4 bytes x cells x languages, whatever the corpus.
CELLS = 1 << 16
CHUNKS = 32
#: Added to each count, and the log-likelihood that a further language must bring, per log of the n-grams.
SMOOTH, PENALTY = 0.5, 8.0
STEPS = 12

#: ASCII bytes that are not letters read as a space.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def held_out(id_col: str) -> Column:
    """Whether a document is kept from learning: crc32 of the id as text is a multiple of 5. A null id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def gram_cells(text: str) -> np.ndarray:
    """Cells of the overlapping 4-byte grams of the lower-cased text, framed by spaces; runs of spaces count once."""
    raw = LETTERS[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))].astype(np.uint32)
    if len(raw) < 4:
        raw = np.append(raw, np.full(4 - len(raw), 32, np.uint32))
    gram = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    return ((gram * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


class Model:
    """Languages and their probabilities of a gram's cell, each cell's largest being one."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = (counts + SMOOTH) / (counts.sum(0) + SMOOTH * CELLS)
        self.scale = np.log(p.max(1)) if langs else np.zeros(CELLS)
        self.p = (p / p.max(1, keepdims=True)).astype(np.float32) if langs else p.astype(np.float32)


def learn(docs: DataFrame, id_col: str, text: str, lang: str) -> Model:
    """Counts of every gram of every labelled document that is not held out, summed in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = total.setdefault(label, np.zeros(CELLS, np.int64))
                mine += np.bincount(gram_cells(body.as_py()), minlength=CELLS)
        for label, mine in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [label] * CHUNKS, "chunk": pa.array(range(CHUNKS), pa.int32()), "counts": [x.tobytes() for x in mine.reshape(CHUNKS, -1)]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"])
        return table.slice(0, 1).set_column(2, "counts", pa.array([total.tobytes()], pa.binary()))

    known = docs.where(~held_out(id_col) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    parts = known.mapInArrow(count, "lang string, chunk int, counts binary").groupBy("lang", "chunk").applyInArrow(add, "lang string, chunk int, counts binary").collect()
    langs = sorted({x["lang"] for x in parts})
    table = np.zeros((len(langs), CHUNKS, CELLS // CHUNKS))
    for x in parts:
        table[langs.index(x["lang"]), x["chunk"]] = np.frombuffer(x["counts"], np.int64)
    return Model(langs, table.reshape(len(langs), CELLS).T)


def fit(p: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Shares of the languages after ``steps`` of expectation-maximisation, and their log-likelihood."""
    for _ in range(steps):
        share = share * (p.T @ (1 / (p @ share))) / len(p)
    return share, float(np.log(p @ share, dtype=np.float64).sum())


def languages(text: str, model: Model) -> list[tuple[int, float]]:
    """Languages of a text with their shares, the largest first.

    Languages join in the order of their shares in the full mixture as long as the likelihood grows by more
    than the penalty.
    """
    p = model.p[gram_cells(text)]
    k = p.shape[1]
    share, _ = fit(p, np.full(k, 1 / k, np.float32), STEPS)
    order = np.argsort(-share, kind="stable")
    cost = PENALTY * np.log(len(p) + 1)
    best = None
    for m in range(1, k + 1):
        few = order[:m]
        part, value = fit(p[:, few], share[few] / share[few].sum(), STEPS // 2 if m > 1 else 0)
        if best is not None and value - cost * m <= best[0]:
            break
        best = (value - cost * m, few, part)
    _, few, part = best
    rank = sorted(zip((-part / part.sum()).tolist(), few.tolist()))
    return [(lang, -s) for s, lang in rank]


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id``, ``held_out``, ``lang_pred``, ``score``, ``languages`` (map of shares) of every whole text.

    The model learns from all labelled documents that are not held out; it sees nothing but their text and
    label. ``lang_pred`` is the language of the largest share and ``score`` that share; ties go to
    the first in the order of names. A model has a fixed size per language, and is all that is broadcast.

    Null text, text without a letter, or nothing to learn from: ``und``, score 0, no languages. Null ids are
    held out. Null labels are not learned from. Repeated rows: a row each. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text, lang))
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores, maps = [], [], []
            for body in batch.column(2):
                text = body.as_py()
                if not model.langs or not text or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    maps.append([])
                    continue
                found = languages(text, model)
                names.append(model.langs[found[0][0]])
                scores.append(min(1.0, found[0][1]))
                maps.append([(model.langs[i], s) for i, s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                                             names=["id", "held_out", "lang_pred", "score", "languages"])

    return docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text).cast("string").alias("text")).mapInArrow(
        predict, f"id {kind}, held_out boolean, lang_pred string, score double, languages map<string,double>")
