"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's terms are its byte 3-grams (capitals as one sign, digits as another), hashed into ``BUCKETS`` counts, and classes of the
share of words that echo; counts are damped, weighted by rarity and projected by a truncated singular value decomposition that is fitted on the
labelled sample. The sample's vectors are broadcast; every document is compared with all of them in blocks (exact
cosine products), and its ``NEIGHBOURS`` nearest vote with a weight that grows with their similarity. Votes are scaled to
the labels' shares in the whole table.

The sample takes at most ``max_labelled`` labelled documents of each label (those with the least hash of doc_id), a
documented bound that also bounds what is broadcast (max_labelled * 2 * RANK floats, about 1 MB). Everything else
covers every row and every byte.

Nulls: a missing text is the empty one; an empty text has no terms, so its score is the labels' share. Rows of labels
without doc_id or quality are left out; several labels of one doc_id count by their mean. Without labels of both kinds the
score is the share of good labels (0.5 without any). Equal rows get equal scores, empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronofold.llm.encoding import forget
from chronofold.llm.line_rules import WHITE, span_hashes
from chronofold.llm.shared import text_of

BUCKETS = 2048
#: A text whose words echo (stand one or two words before too) to these shares has a term for each, counted so often.
ECHO_SHARES = np.array([0.05, 0.1, 0.2, 0.4], np.float32)
ECHO_COUNT = 1000
TERMS = BUCKETS + len(ECHO_SHARES)
RANK = 48
NEIGHBOURS = 25
MAX_LABELLED = 1500
POWER = 8
BATCH_BYTES = 1 << 19
BLOCK = 512
FOLDS, HELD = 3, 1

#: Bytes by kind for terms: letters keep their value in lower case, digits are one, white space is one.
_KIND = np.arange(256, dtype=np.uint32)
_KIND[65:91] = 1000
_KIND[48:58] = 48
_KIND[[9, 10, 11, 12, 13]] = 32


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Hashed counts (text, bucket) of byte 3-grams, and terms for the share of words that stand one or two words before too."""
    out = np.zeros((len(texts), TERMS), np.float32)
    data = np.frombuffer(b"  ".join(texts) + b"  ", np.uint8)
    ends = np.cumsum([len(t) + 2 for t in texts])
    doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    k = _KIND[data]
    three = (k[:-2] * np.uint32(0x9E3779B1) ^ k[1:-1] * np.uint32(0x85EBCA77) ^ k[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    at = doc[:-2] * BUCKETS + (three >> np.uint32(32 - BUCKETS.bit_length() + 1))
    inside = doc[:-2] == doc[2:]
    out[:, :BUCKETS] = np.bincount(at[inside], minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
    sizes = np.diff(ends, prepend=0)
    white = WHITE[data]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    words = span_hashes(data, starts, np.flatnonzero(white & np.concatenate([[False], ~white[:-1]])))
    echo = np.zeros(len(starts), bool)
    for back in (1, 2):
        echo[back:] |= (words[back:] == words[:-back]) & (doc[starts[back:]] == doc[starts[:-back]])
    share = np.bincount(doc[starts], echo, len(texts)) / np.maximum(1, np.bincount(doc[starts], minlength=len(texts)))
    out[:, BUCKETS:] = ECHO_COUNT * (share[:, None] >= ECHO_SHARES)
    out[sizes == 2] = 0  # the separators of an empty text are no terms
    return out


def damped(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit rows of log counts times rarity."""
    x = np.log1p(counts) * weights
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    """Projection, labelled vectors and label weights."""

    def __init__(self, counts: np.ndarray, quality: np.ndarray, share: float, rank: int = RANK):
        self.share = share
        self.votes = None
        good = quality >= 0.5
        if not good.any() or good.all():
            return
        self.weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        x = damped(counts, self.weights)
        # Randomised range finder, then an exact decomposition of the small matrix.
        rank = min(rank, *x.shape)
        y = x @ np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, x.shape[0]))).astype(np.float32)
        for _ in range(3):
            q, _ = np.linalg.qr(y)
            y = x @ (x.T @ q)
        q, _ = np.linalg.qr(y)
        self.basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
        v = x @ self.basis
        self.vectors = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        # A label's votes weigh by its share among all labels over its share in the sample.
        p = good.mean()
        self.votes = np.stack([good * share / p, ~good * (1 - share) / (1 - p)], axis=1).astype(np.float32)

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of votes for label 1; exact cosines with every labelled vector, in blocks of rows."""
        out = np.full(len(counts), self.share)
        if self.votes is None:
            return out
        k = min(neighbours, len(self.vectors))
        for a in range(0, len(counts), BLOCK):
            some = counts[a : a + BLOCK]
            v = damped(some, self.weights) @ self.basis
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            cosine = v @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosine, near, axis=1).astype(np.float64), 1e-6) ** POWER
            votes = np.einsum("ij,ijk->ik", w, self.votes[near])
            known = some.any(axis=1)
            out[a : a + BLOCK][known] = (votes[:, 0] / votes.sum(axis=1))[known]
        return np.clip(out, 0, 1)


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves HELD modulo FOLDS; without doc_id never."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, learn_all: bool = False) -> Model:
    """The model from labels (doc_id, quality) of docs (doc_id, text); held-out rows are never learned from."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if not learn_all:
        marked = marked.where(~is_held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    shares = marked.agg(F.avg((F.col("quality") >= 0.5).cast("double"))).first()[0]
    # Bounded: 2 * max_labelled ids.
    sample = None
    for good in (True, False):
        some = marked.where((F.col("quality") >= 0.5) == F.lit(good)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        sample = some if sample is None else sample.unionByName(some)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for i in range(batch.num_rows):
                c = term_counts([batch.column(1)[i].as_py().encode()])[0]
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([at.astype("<u2").tobytes()]), pa.array([c[at].astype("<f4").tobytes()])], names=["doc_id", "quality", "at", "n"]
                )

    packed = rows.select("doc_id", "text", "quality").mapInArrow(pack, "doc_id long, quality double, at binary, n binary").collect()
    packed.sort(key=lambda r: (r["doc_id"], bytes(r["at"]), bytes(r["n"])))
    counts = np.zeros((len(packed), TERMS), np.float32)
    for i, r in enumerate(packed):
        counts[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<f4")
    return Model(counts, np.array([r["quality"] for r in packed]), 0.5 if shares is None else float(shares))


def _scored(rows: DataFrame, model: Model, field: int | None = None) -> DataFrame:
    """rows with their scores. The last column is the text, which goes; with field it is a struct that has the text there and stays."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = rows.columns[:-1] if field is None else rows.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            texts = (last if field is None else last.field(field)).cast(pa.binary()).fill_null(b"")
            sizes = np.cumsum([len(x.as_buffer()) + 2 for x in texts])
            at = 0
            while at < len(texts):
                # As many texts as fit the byte budget, and no more rows than a block of counts.
                end = min(at + BLOCK, max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, side="right"))))
                scores = held.value.scores(term_counts(texts.slice(at, end - at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(at, end - at) for i in range(len(names))], pa.array(scores)], names=[*names, "score"])
                at = end

    return rows.mapInArrow(score, StructType([*rows.schema.fields[: len(names)], StructField("score", DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = fit_quality(docs, labels, max_labelled)
    scored = _scored(docs.select("doc_id", text_of().alias("_text")), model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs with a score of 0.5 or more, all columns."""
    model = fit_quality(docs, labels, max_labelled)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # The text goes to Python once, within its row.
    at = next(i for key in (str, str.lower) for i, c in enumerate(docs.columns) if key(c) == "text")
    return _scored(docs.select(row), model, at).where("score >= 0.5").select("row.*")
