"""Quality: a linear-chain CRF labels every line good or bad; length-weighted marginals give the document's score.

A line's features are shares of its characters (letters, capitals, digits,
punctuation, symbols, bars), of its words (repeats of the word before, words that
carry symbols, single letters), its length and mean word length, and the
same symbol, bar, capital and repeat shares of the lines before and after it.

Training labels are per document: all lines of a bad document start out bad; a line
classifier then relabels those it finds good itself, but for the worst line of each
document, and the chain is fitted on the outcome. A document's badness is the mean of its lines' marginals,
weighted by their length; a logistic function fitted on the training documents turns
it into the score.

Labels, lang, source and doc_id never enter a score. Defined results: a null or
empty text is one empty line and is scored as such; repeated rows get equal
scores; a null doc_id counts as not held out; without both classes among the labels every
score is the share of good labels (0.5 without labels); an empty table gives no
rows. Other columns pass through, except those that bear the name of a result in any case.
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

LETTER, CAPITAL, DIGIT, POINT, SYMBOL, BAR = range(6)
KINDS = np.zeros((256, 6), bool)
KINDS[[*range(65, 91), *range(97, 123), *range(192, 256)], LETTER] = True
KINDS[range(65, 91), CAPITAL] = True
KINDS[range(48, 58), DIGIT] = True
KINDS[[ord(c) for c in ".,;:'\"()?-"], POINT] = True
KINDS[[ord(c) for c in "#$%&*!@^~+=<>[]{}\\/_"], SYMBOL] = True
KINDS[ord("|"), BAR] = True


@dataclass
class Model:
    chain: crf.Chain | None
    document: np.ndarray | None
    share: float


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes, and the number of lines per text."""
    feeds = np.flatnonzero(raw == 10)
    counts = np.diff(np.searchsorted(feeds, offsets)) + 1
    first = np.cumsum(counts) - counts
    begins = np.empty(int(counts.sum()), np.int64)
    begins[first] = offsets[:-1]
    inner = np.ones(len(begins), bool)
    inner[first] = False
    begins[inner] = feeds + 1
    ends = np.empty_like(begins)
    ends[first + counts - 1] = offsets[1:]
    outer = np.ones(len(begins), bool)
    outer[first + counts - 1] = False
    ends[outer] = feeds
    length = ends - begins
    shares = np.empty((len(begins), 6))
    for k in range(6):
        total = np.concatenate([[0], np.cumsum(KINDS[raw, k], dtype=np.int64)])
        shares[:, k] = total[ends] - total[begins]
    starts, stops, word_first = kernels.spans(raw, np.append(begins, offsets[-1]))
    words = np.diff(word_first)
    hashes = kernels.span_hashes(raw, starts, stops)
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes):
        repeat = np.concatenate([[False], hashes[1:] == hashes[:-1]])
        repeat[word_first[:-1][words > 0]] = False
        same[1:] = np.cumsum(repeat)
    dressed = np.concatenate([[0], np.cumsum(KINDS[raw[np.maximum(stops - 1, 0)], SYMBOL] | KINDS[raw[np.maximum(stops - 1, 0)], BAR] if len(stops) else [], dtype=np.int64)])
    short = np.concatenate([[0], np.cumsum(stops - starts == 1, dtype=np.int64)])
    per_word = lambda x: (x[word_first[1:]] - x[word_first[:-1]]) / np.maximum(words, 1)
    shares /= np.maximum(length, 1)[:, None]
    shares[:, CAPITAL] /= np.maximum(shares[:, LETTER], 0.05)
    repeats = per_word(same)
    own = np.column_stack([np.ones(len(begins)), shares, repeats, per_word(dressed), per_word(short), np.log1p(length) / 10, np.log1p(length / np.maximum(words, 1)) / 4, words == 0])
    telling = np.column_stack([shares[:, [CAPITAL, SYMBOL, BAR]], repeats])
    before, after = np.zeros_like(telling), np.zeros_like(telling)
    before[1:], after[:-1] = telling[:-1], telling[1:]
    before[first], after[first + counts - 1] = 0, 0
    return np.column_stack([own, before, after]), length, counts


def _badness(chain: crf.Chain, features: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    p = crf.marginals(chain, features @ chain.weights, counts)
    first = np.cumsum(counts) - counts
    weight = length + 1.0
    return np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first) if len(counts) else np.zeros(0)


def _document_features(bad: np.ndarray) -> np.ndarray:
    bad = np.clip(bad, 1e-6, 1 - 1e-6)
    return np.column_stack([np.log(bad / (1 - bad))])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000) -> Model:
    """Learn from all lines of at most ``per_class`` rows of each class; the driver holds 4 bytes per line and feature."""
    sample, sizes = training_sample(docs, labels, label, per_class)
    if len(sizes) < 2:
        return Model(None, None, (sizes.get(1, 0) / sum(sizes.values())) if sizes else 0.5)
    width = len(line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0][0])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernels.pieces(batches, "text"):
            x, _, counts = line_features(*kernels.text_bytes(piece.column("text")))
            ends = np.cumsum(counts)
            rows = [x[e - c : e].astype(np.float32).tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("y"), pa.array(rows, pa.binary())], names=["y", "x"])

    rows = sample.select("text", "y").mapInArrow(gather, "y int, x binary").toPandas()
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, width)
    if rows["y"].nunique() < 2:  # the labelled rows are not among the documents
        return Model(None, None, sizes.get(1, 0) / sum(sizes.values()))
    counts = np.array([len(x) for x in rows.pop("x")], np.int64) // (4 * width)
    first = np.cumsum(counts) - counts
    bad = np.repeat(rows["y"].to_numpy() == 0, counts)
    states = bad.copy()
    for _ in range(3):
        balance = np.where(states, 0.5 / max(1, states.sum()), 0.5 / max(1, (~states).sum())) * len(states)
        alone = crf.apply_logistic(crf.logistic(x, states.astype(float), balance), x)
        states = bad & (alone >= np.minimum(0.5, np.repeat(np.maximum.reduceat(alone, first), counts)))
    chain = crf.fit(x, states, counts)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernels.pieces(batches, "text"):
            bad = _badness(chain, *line_features(*kernels.text_bytes(piece.column("text"))))
            yield pa.RecordBatch.from_arrays([piece.column("y"), pa.array(bad)], names=["y", "bad"])

    judged = sample.select("text", "y").mapInArrow(judge, "y int, bad double").toPandas()
    y = judged["y"].to_numpy(float)
    weight = np.where(y == 1, sizes[1] / min(sizes[1], per_class), sizes[0] / min(sizes[0], per_class))
    return Model(chain, crf.logistic(_document_features(judged["bad"].to_numpy()), y, weight / weight.mean()), 0.5)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` plus held_out, score and predicted."""
    docs = without(docs, "held_out", "score", "predicted").withColumn("held_out", held_out())
    names = [*docs.columns, "score", "predicted"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernels.pieces(batches, "text"):
            if model.chain is None:
                scores = np.full(piece.num_rows, model.share)
            else:
                bad = _badness(model.chain, *line_features(*kernels.text_bytes(piece.column("text"))))
                scores = crf.apply_logistic(model.document, _document_features(bad))
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(i) for i in range(piece.num_columns)), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=names
            )

    return docs.mapInArrow(run, f"{schema}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Train on ``labels`` and score every row of ``docs`` (doc_id, text)."""
    return score(docs, train(docs, labels), threshold)
