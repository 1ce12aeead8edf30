"""Toxicity: a linear-chain CRF tags toxic spans; its marginals give document scores and offending offsets.

Tokens are runs of letters (ASCII letters and all bytes from 0x80), lower-cased in
A-Z. Labels are per document, so tokens are labelled first: over the training rows the
document frequencies of words, prefixes and suffixes in toxic and other documents
give each feature a log-odds weight (its lower bound); a token of a toxic document whose strongest
feature reaches ``STRONG`` is labelled toxic. The CRF is trained on all tokens of
these rows, with the token's own weight and its neighbours' as features.

Training and scoring run over whole texts. Tokens without any weighted feature in
reach are ordinary, and a run of them enters forward-backward as one matrix power, so
a text of any length costs its word hashing and its few weighted tokens. The document
score is a logistic function, fitted on the training documents, of the tokens' summed and
largest marginals.

Labels, lang, source and doc_id never enter a score. Defined results: null and
empty texts get the score of a text without toxic tokens; repeated rows get equal
scores; a null doc_id counts as not held out; without both classes among the labels
every score is the share of toxic labels (0 if none); an empty table gives no rows.
Other columns of the documents pass through, except those that bear the name of a result in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm import crf, kernels
from resona.llm.labelled import held_out, training_sample
from resona.llm.tables import without

PREFIXES, SUFFIXES = (4, 5, 6), (4, 5)
STRONG = 1.5
#: standard errors that a feature's log-odds must give up, so that chance finds weigh nothing
CAUTION = 2.5
OTHER = np.ones(256, bool)
OTHER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    hashes: np.ndarray  # ascending
    odds: np.ndarray
    present: np.ndarray  # by the upper 16 bits of a hash
    chain: crf.Chain | None
    document: np.ndarray | None
    share: float


def tokens(raw: np.ndarray, offsets: np.ndarray):
    return kernels.spans(raw, offsets, OTHER)


def token_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tokens that have it, hash) for each kind of feature: the word, then prefixes and suffixes in bytes."""
    length = ends - starts
    words = kernels.span_hashes(raw, starts, ends)
    out = [(np.arange(len(starts)), words)]
    for kind, sizes, side in ((1, PREFIXES, starts), (2, SUFFIXES, ends)):
        hashed = np.zeros(len(starts), np.uint64)
        longest = max(sizes)
        for k in range(longest):
            has = length > k
            at = side + k if kind == 1 else side - 1 - k
            hashed = hashed * kernels.BASE + np.where(has, kernels.FOLDED[raw[np.where(has, at, 0)]], np.uint64(0)) if len(raw) else hashed
            if k + 1 in sizes:
                which = np.flatnonzero(length > k + 1)
                out.append((which, kernels.mix64(hashed[which] + np.uint64(100 * kind + k))))
    return out


def _odds(model: Model, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each token's largest weight; 0 without a weighted feature."""
    best = np.zeros(len(starts))
    if not len(model.hashes):
        return best
    for which, hashes in token_features(raw, starts, ends):
        near = np.flatnonzero(model.present[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(model.hashes, hashes[near]), len(model.hashes) - 1)
        hit = model.hashes[place] == hashes[near]
        np.maximum.at(best, which[near[hit]], model.odds[place[hit]])
    return best


def _chain_features(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """bias, weight, has a weight, previous token has one, next token has one; neighbours stay inside a text."""
    has = (odds > 0).astype(float)
    before, after = np.concatenate([[0.0], has[:-1]])[: len(has)], np.concatenate([has[1:], [0.0]])[-len(has) or len(has) :]
    before[first[:-1][first[:-1] < len(has)]] = 0
    last = first[1:] - 1
    after[last[last >= 0]] = 0
    return np.column_stack([np.ones(len(odds)), odds, has, before, after])


def _document_features(total: np.ndarray, most: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(total), most])


def _listed(odds: np.ndarray, first: np.ndarray):
    """The tokens that differ from an ordinary one: their indices, count per text, gaps before them, tails after the last."""
    x = _chain_features(odds, first)
    at = np.flatnonzero(x[:, 1:].any(1))
    bounds = np.searchsorted(at, first)
    counts = np.diff(bounds)
    gaps = np.diff(at, prepend=-1) - 1
    heads = bounds[:-1][counts > 0]
    gaps[heads] = at[heads] - first[:-1][counts > 0]
    tails = np.diff(first).copy()
    tails[counts > 0] = first[1:][counts > 0] - 1 - at[bounds[1:][counts > 0] - 1]
    return x[at], at, counts, gaps, tails


def _tag(model: Model, raw: np.ndarray, offsets: np.ndarray):
    """Per text the summed and largest marginal; and the listed tokens' marginals, spans and counts per text."""
    starts, ends, first = tokens(raw, offsets)
    x, at, counts, gaps, tails = _listed(_odds(model, raw, starts, ends), first)
    p = crf.marginals(model.chain, x @ model.chain.weights, counts, gaps, tails, float(model.chain.weights[0])) if len(at) else np.zeros(0)
    total, most = np.zeros(len(counts)), np.zeros(len(counts))
    text = np.repeat(np.arange(len(counts)), counts)
    np.add.at(total, text, p)
    np.maximum.at(most, text, p)
    return total, most, p, starts[at], ends[at], counts


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 3000, min_docs: int = 5) -> Model:
    """Learn from all tokens of at most ``per_class`` rows of each class; a weighted feature occurs in ``min_docs`` toxic ones at least, which bounds their number."""
    sample, sizes = training_sample(docs, labels, label, per_class)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(1 << 16, bool), None, None, share)
    if len(sizes) < 2:
        return nothing

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernels.pieces(batches, "text"):
            raw, offsets = kernels.text_bytes(piece.column("text"))
            starts, ends, first = tokens(raw, offsets)
            owner = np.repeat(np.arange(piece.num_rows), np.diff(first))
            label = piece.column("y").to_numpy(zero_copy_only=False)
            for which, hashes in token_features(raw, starts, ends):
                order = np.lexsort((owner[which], hashes))
                h, d = hashes[order], owner[which][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, y = h[new], label[d[new]]
                names, place = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(np.bincount(place, weights=y, minlength=len(names)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(names)))],
                    names=["feature", "toxic", "docs"],
                )

    taken = {y: min(sizes[y], per_class) for y in (0, 1)}
    toxic, other = F.col("toxic") + 0.5, F.col("docs") - F.col("toxic") + 0.5
    odds = F.log(toxic / (taken[1] + 1)) - F.log(other / (taken[0] + 1)) - CAUTION * F.sqrt(1 / toxic + 1 / other)
    weighted = (
        sample.select("text", "y")
        .mapInArrow(count, "feature long, toxic long, docs long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
        .where(F.col("toxic") >= min_docs)
        .withColumn("odds", odds)
        .where(F.col("odds") > 1)
        .select("feature", "odds")
        .toPandas()
    )
    hashes = weighted["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    present = np.zeros(1 << 16, bool)
    present[(hashes >> np.uint64(48)).astype(np.int64)] = True
    model = Model(hashes[order], weighted["odds"].to_numpy(float)[order], present, None, None, share)
    if not len(hashes):
        return nothing

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens of a text that differ from an ordinary one (row by row), with the runs of ordinary ones between them."""
        for piece in kernels.pieces(batches, "text"):
            raw, offsets = kernels.text_bytes(piece.column("text"))
            starts, ends, first = tokens(raw, offsets)
            odds = _odds(model, raw, starts, ends)
            x, at, counts, gaps, tails = _listed(odds, first)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            rows = [x[a:b].astype(np.float32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            between = [gaps[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("y"), pa.array(rows, pa.binary()), pa.array(between, pa.binary()), pa.array(tails)], names=["y", "x", "gaps", "tail"])

    rows = sample.select("text", "y").mapInArrow(listed, "y int, x binary, gaps binary, tail long").toPandas()
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, 5).astype(float)
    gaps = np.frombuffer(b"".join(rows["gaps"]), np.int64)
    lengths = rows["gaps"].map(len).to_numpy() // 8
    states = (x[:, 1] >= STRONG) & (np.repeat(rows["y"].to_numpy(), lengths) == 1)
    model.chain = crf.fit(x, states, lengths, gaps, rows["tail"].to_numpy())

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernels.pieces(batches, "text"):
            total, most, *_ = _tag(model, *kernels.text_bytes(piece.column("text")))
            yield pa.RecordBatch.from_arrays([piece.column("y"), pa.array(total), pa.array(most)], names=["y", "total", "most"])

    tagged = sample.select("text", "y").mapInArrow(tag, "y int, total double, most double").toPandas()
    y = tagged["y"].to_numpy(float)
    weight = np.where(y == 1, sizes[1] / taken[1], sizes[0] / taken[0])
    model.document = crf.logistic(_document_features(tagged["total"].to_numpy(), tagged["most"].to_numpy()), y, weight / weight.mean())
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` plus held_out, score, predicted and ``toxic_spans`` (code points, end exclusive) with marginals of 0.5 or more."""
    docs = without(docs, "held_out", "score", "predicted", "toxic_spans").withColumn("held_out", held_out())
    names = [*docs.columns, "score", "predicted", "toxic_spans"]
    fields = "score double, predicted int, toxic_spans array<struct<start:int,end:int>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernels.pieces(batches, "text"):
            raw, offsets = kernels.text_bytes(piece.column("text"))
            spans: list[list] = [[] for _ in range(piece.num_rows)]
            if model.document is None:
                scores = np.full(piece.num_rows, model.share)
            else:
                total, most, p, starts, ends, counts = _tag(model, raw, offsets)
                scores = crf.apply_logistic(model.document, _document_features(total, most))
                owner = np.repeat(np.arange(piece.num_rows), counts)
                points = None
                for k in np.flatnonzero(p >= 0.5):
                    if points is None:
                        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    base = points[offsets[owner[k]]]
                    spans[owner[k]].append({"start": int(points[starts[k]] - base), "end": int(points[ends[k]] - base)})
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, spans_type)],
                names=names,
            )

    return docs.mapInArrow(run, f"{schema}, {fields}")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Train on ``labels`` and score every row of ``docs`` (doc_id, text)."""
    return score(docs, train(docs, labels), threshold)
