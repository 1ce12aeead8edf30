"""SentencePiece encoding and decoding, with a max-plus parallel scan.

A unigram model's encoding is the path of pieces with the largest sum of scores
(method "max_plus"). A BPE model's encoding is the outcome of its merges, which is not
such a path: over the public BPE model's scores "the" is "_t" + "he", while its
merges give "_the". So for BPE models ``encode`` defaults to method "merges", which
lets the library merge every distinct word of a batch once and so returns the
library's own ids; "max_plus" stays available for any model. Model files are never
trained or copied here.

The scan: in the max-plus semiring a chunk of text is a matrix T:
T[k, e] is the best score from a path that enters the chunk k characters after its
start to one that leaves it e characters after its end, with k and e below the longest
piece. Such matrices combine associatively.

* No piece of the vocabulary crosses from a word into the blank before the next one (checked
  when it is loaded), so paths meet where words end, and every distinct word of a batch is
  encoded once, all words in lockstep. Words longer than a ``CHUNK`` are scanned
  chunk by chunk in lockstep.
* Texts of more than ``scan_chars`` characters are scanned in chunks of so many characters, which
  end anywhere. A chunk's matrix is then the outer sum of two vectors and a number: what
  its last word, begun but not ended, gives to each exit; what the rest of its first
  word asks of each entry; and the score of the words between. The product of two neighbours
  needs these vectors alone; the best entry in it is where both chunks are backtraced to, each on its own.
* Giant texts, of more than ``giant_chars`` characters, are split into chunks that are rows of their own. With "merges", chunks
  end where a word ends and are encoded alone. With "max_plus": (1) every chunk yields
  its matrix; (2) a document's matrices, 2 KB each, give each chunk its entry scores;
  (3) each chunk, alone, tells for every exit which entry its best path comes from;
  (4) these maps, composed from the right, give each chunk its exit; (5) each chunk is
  backtraced on its own.

The result is the path a scan from left to right would give, ties included (the longest
last piece wins), whatever the chunks.

Characters that no piece covers become their UTF-8 bytes' pieces. Decoding joins the
pieces' bytes, turns the blank mark into a space and drops the first one.

Defined results: a null or empty text has no pieces and decodes to the empty
string; a text that itself holds the blank mark (U+2581) decodes with spaces in its
place; repeated rows are encoded alike; a null doc_id passes through; an empty table gives no
rows. Other columns pass through, except those that bear the name of a result in any case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm.kernels import BASE, mix64, pieces, powers
from resona.llm.tables import cut, without

BLANK = "▁"
CHUNK = 64
SCAN = 4096
PAD = np.uint32(0xFFFFFFFF)
_WORD_END = re.compile(f"[^{BLANK}](?={BLANK})")


@dataclass
class Vocabulary:
    keys: np.ndarray  # ascending hashes of the pieces
    numbers: np.ndarray  # their ids
    present: np.ndarray  # by the upper 20 bits of a hash
    scores: np.ndarray  # by id
    byte_ids: np.ndarray
    unknown: float
    longest: int
    words_apart: bool
    text: list[bytes]  # what each id decodes to
    model: bytes  # the model file itself, for the library's merges
    method: str  # what the model was trained for: "merges" or "max_plus"


def load(path: str) -> Vocabulary:
    """The pieces and scores of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = SentencePieceProcessor(model_file=path)
    proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    method = "merges" if proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE else "max_plus"
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    scores = np.array([model.get_score(i) for i in range(len(names))], np.float64)
    byte_ids, text, normal = np.full(256, model.unk_id(), np.int32), [], []
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            text.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            text.append(b"")
        else:
            normal.append(i)
            text.append(name.replace(BLANK, " ").encode())
    width = max(len(names[i]) for i in normal)
    codes = np.full((len(normal), width), PAD, np.uint32)
    for row, i in enumerate(normal):
        codes[row, : len(names[i])] = [ord(c) for c in names[i]]
    length = np.array([len(names[i]) for i in normal])
    keys = _keys(_prefixes(codes)[np.arange(len(normal)), length], length)
    order = np.argsort(keys)
    present = np.zeros(1 << 20, bool)
    present[(keys >> np.uint64(44)).astype(np.int64)] = True
    apart = not any(BLANK in names[i][1:] and names[i].strip(BLANK) for i in normal)
    return Vocabulary(keys[order], np.array(normal, np.int32)[order], present, scores, byte_ids, float(scores[normal].min()) - 10, width, apart, text, model.serialized_model_proto(), method)


@lru_cache(maxsize=2)
def _processor(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    mixed = mix64(codes.astype(np.uint64) + np.uint64(1))
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + mixed[:, i]
    return out


def _keys(values: np.ndarray, length) -> np.ndarray:
    return mix64(values + np.asarray(length).astype(np.uint64))


def _piece_ids(codes: np.ndarray, v: Vocabulary) -> np.ndarray:
    """ids[row, start, length - 1]; -1 where no piece is."""
    width = codes.shape[1]
    most = min(v.longest, width)
    prefix, ids = _prefixes(codes), np.full((len(codes), width, most), -1, np.int32)
    for n in range(1, most + 1):
        keys = _keys(prefix[:, n:] - prefix[:, : width - n + 1] * powers(n + 1)[n], n)
        row, start = np.nonzero(v.present[(keys >> np.uint64(44)).astype(np.int64)])
        wanted = keys[row, start]
        place = np.minimum(np.searchsorted(v.keys, wanted), len(v.keys) - 1)
        hit = v.keys[place] == wanted
        ids[row[hit], start[hit], n - 1] = v.numbers[place[hit]]
    return ids


def _forward(codes: np.ndarray, inside: np.ndarray, ids: np.ndarray, v: Vocabulary, entry: np.ndarray):
    """Best scores and last-piece lengths at every boundary. entry (rows, states, longest): scores at the first boundaries.

    Pieces start before ``inside`` (per row); earlier starts win ties.
    """
    rows, width = codes.shape
    best = np.full((rows, entry.shape[1], width + 1), -np.inf)
    back = np.zeros((rows, entry.shape[1], width + 1), np.int8)
    span = min(entry.shape[2], width + 1)
    best[:, :, :span] = entry[:, :, :span]
    order = np.argsort(-inside, kind="stable")
    sorted_inside = inside[order]
    for s in range(int(inside.max(initial=0))):
        live = order[: np.searchsorted(-sorted_inside, -s, "left")]
        now = best[live, :, s]
        for n in range(1, min(v.longest, width - s) + 1):
            found = ids[live, s, n - 1]
            score = np.where(found >= 0, v.scores[found], v.unknown if n == 1 else -np.inf)
            some = np.flatnonzero(score > -np.inf)
            if not len(some):
                continue
            if n == 1:
                some = some[codes[live[some], s] != PAD]
            to = live[some]
            value, old = now[some] + score[some, None], best[to, :, s + n]
            better = value > old
            best[to, :, s + n] = np.where(better, value, old)
            back[to, :, s + n] = np.where(better, n, back[to, :, s + n])
    return best, back


def _trace(back: np.ndarray, ids: np.ndarray, codes: np.ndarray, exits: np.ndarray, v: Vocabulary, entries: np.ndarray | None = None):
    """Piece ids of every row back to back and their count per row. back (rows, width + 1); stops at entry boundaries (back 0)."""
    at, rows = exits.astype(np.int64).copy(), np.arange(len(exits))
    steps = []
    while True:
        n = back[rows, at].astype(np.int64)
        live = np.flatnonzero(n > 0)
        if not len(live):
            break
        row, start = rows[live], at[live] - n[live]
        steps.append((row, start, ids[row, start, n[live] - 1]))
        at[live] = start
        rows_live = np.zeros(len(rows), bool)
        rows_live[live] = True
        at, rows = at[rows_live], rows[rows_live]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(len(exits), np.int64)
    row, start, piece = (np.concatenate([s[i] for s in steps]) for i in range(3))
    order = np.lexsort((start, row))
    row, start, piece = row[order], start[order], piece[order]
    unknown = np.flatnonzero(piece < 0)
    if not len(unknown):
        return piece, np.bincount(row, minlength=len(exits))
    point = codes[row[unknown], start[unknown]].astype(np.int64)
    size = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
    counts = np.ones(len(piece), np.int64)
    counts[unknown] = size
    out = np.repeat(piece, counts)
    begin = (np.cumsum(counts) - counts)[unknown]
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    for k in range(4):
        has = size > k
        bits = point[has] >> (6 * (size[has] - 1 - k))
        byte = np.where(k == 0, lead[has] | bits, 0x80 | (bits & 0x3F))
        out[begin[has] + k] = v.byte_ids[byte]
    return out, np.bincount(np.repeat(row, counts), minlength=len(exits))


def _rows(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    index = starts[:, None] + np.arange(width)
    return np.where(index < ends[:, None], codes[np.minimum(index, max(len(codes) - 1, 0))], PAD)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices."""
    return (a[:, :, :, None] + b[:, None, :, :]).max(2)


def _fresh(rows: int, v: Vocabulary, each: bool) -> np.ndarray:
    """Entry scores: one state at boundary 0, or (each) one state per entry."""
    if each:
        return np.repeat(np.where(np.eye(v.longest, dtype=bool), 0.0, -np.inf)[None], rows, 0)
    entry = np.full((rows, 1, v.longest), -np.inf)
    entry[:, 0, 0] = 0
    return entry


class Scan:
    """The chunks of one long run of characters. ``ahead``: characters at its end that belong to what follows."""

    def __init__(self, codes: np.ndarray, ahead: int, v: Vocabulary):
        own = len(codes) - ahead
        starts = np.arange(0, max(own, 1), CHUNK)
        self.v, self.inside = v, np.minimum(CHUNK, own - starts)
        self.codes = _rows(codes, starts, np.full(len(starts), len(codes)), CHUNK + v.longest - 1)
        self.ids = _piece_ids(self.codes, v)

    def matrices(self) -> np.ndarray:
        best, _ = _forward(self.codes, self.inside, self.ids, self.v, _fresh(len(self.codes), self.v, True))
        return np.stack([best[np.arange(len(best)), :, np.minimum(self.inside + e, best.shape[2] - 1)] for e in range(self.v.longest)], axis=2)

    def matrix(self) -> np.ndarray:
        """The product of all chunks' matrices, by halves."""
        m = self.matrices()
        while len(m) > 1:
            m = np.concatenate([_times(m[0 : len(m) // 2 * 2 : 2], m[1::2]), m[len(m) // 2 * 2 :]])
        return m[0]

    def forward(self, entry: np.ndarray):
        """Best and back with every chunk's true entry scores, given those of the first."""
        m = self.matrices()
        entries = [entry]
        for t in m[:-1]:
            entries.append((entries[-1][:, None] + t).max(0))
        best, back = _forward(self.codes, self.inside, self.ids, self.v, np.stack(entries)[:, None, :])
        return best[:, 0], back[:, 0]

    def entries_by_exit(self, back: np.ndarray, exit_: int) -> np.ndarray:
        """The exit of every chunk for a path that leaves the last one ``exit_`` after its end; the last value is the run's entry."""
        exits = np.empty(len(back) + 1, np.int64)
        exits[-1] = exit_
        for i in range(len(back) - 1, -1, -1):
            at = int(self.inside[i] + exits[i + 1])
            while back[i, at]:
                at -= int(back[i, at])
            exits[i] = min(at, self.v.longest - 1)  # an exit that no path reaches ends anywhere
        return exits

    def encode(self, entry: np.ndarray, exit_: int) -> np.ndarray:
        _, back = self.forward(entry)
        exits = self.entries_by_exit(back, exit_)
        return _trace(back, self.ids, self.codes, self.inside + exits[1:], self.v)[0]


def _best_paths(codes: np.ndarray, s: np.ndarray, n: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the stretches [s, s + n), where each one's begin, and how many there are."""
    found_ids: list[np.ndarray] = []
    offset, count = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    at, low = 0, 0
    for width in (6, 10, 16, 28, CHUNK):
        group = np.flatnonzero((n > low) & (n <= width))
        low = width
        for k in range(0, len(group), 8192):
            part = group[k : k + 8192]
            rows = _rows(codes, s[part], s[part] + n[part], width)
            ids = _piece_ids(rows, v)
            _, back = _forward(rows, n[part], ids, v, _fresh(len(part), v, False))
            out, counts = _trace(back[:, 0], ids, rows, n[part], v)
            offset[part], count[part] = at + np.cumsum(counts) - counts, counts
            found_ids.append(out)
            at += len(out)
    entry = np.where(np.arange(v.longest) == 0, 0.0, -np.inf)
    for i in np.flatnonzero(n > CHUNK):
        out = Scan(codes[s[i] : s[i] + n[i]], 0, v).encode(entry, 0)
        offset[i], count[i] = at, len(out)
        found_ids.append(out)
        at += len(out)
    ids = np.concatenate(found_ids)
    return ids, offset, count


def _across(codes: np.ndarray, s: np.ndarray, cut_: np.ndarray, e: np.ndarray, v: Vocabulary) -> list[np.ndarray]:
    """Ids of the words [s, e), each of which a chunk's end ``cut_`` divides, from the two chunks' vectors at that end."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(s)
    before, behind = cut_ - s, e - cut_
    for i in np.flatnonzero(np.maximum(before, behind) > CHUNK):
        out[i] = Scan(codes[s[i] : e[i]], 0, v).encode(np.where(np.arange(v.longest) == 0, 0.0, -np.inf), 0)
    low = 0
    for width in (4, 8, 16, CHUNK):  # like lengths in lockstep
        part = np.flatnonzero((np.maximum(before, behind) > low) & (np.maximum(before, behind) <= width))
        low = width
        if not len(part):
            continue
        rows = np.arange(len(part))
        left = _rows(codes, s[part], e[part], width + v.longest - 1)
        left_ids = _piece_ids(left, v)
        best, left_back = _forward(left, before[part], left_ids, v, _fresh(len(part), v, False))
        exits = np.stack([best[rows, 0, np.minimum(before[part] + k, best.shape[2] - 1)] for k in range(v.longest)], axis=1)
        exits[np.arange(v.longest)[None] > behind[part][:, None]] = -np.inf
        right = _rows(codes, cut_[part], e[part], max(width, v.longest))
        right_ids = _piece_ids(right, v)
        _, right_back = _forward(right, behind[part], right_ids, v, exits[:, None, :])
        entry = behind[part].copy()
        while (step := right_back[rows, 0, entry].astype(np.int64)).any():
            entry -= step
        head, n_head = _trace(left_back[:, 0], left_ids, left, before[part] + entry, v)
        tail, n_tail = _trace(right_back[:, 0], right_ids, right, behind[part], v)
        for i, own, rest in zip(part, np.split(head, np.cumsum(n_head)[:-1]), np.split(tail, np.cumsum(n_tail)[:-1]), strict=True):
            out[i] = np.concatenate([own, rest])
    return out


def _ends_inside(bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, scan_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that a chunk's end divides, and that end; a word that several divide is left whole."""
    texts = np.flatnonzero(np.diff(bounds) > scan_chars)
    cuts = np.concatenate([np.zeros(0, np.int64), *[np.arange(bounds[i] + scan_chars, bounds[i + 1], scan_chars) for i in texts]])
    word = np.searchsorted(starts, cuts, "right") - 1
    inside = (cuts > starts[word]) & (cuts < ends[word]) if len(cuts) else np.zeros(0, bool)
    word, cuts = word[inside], cuts[inside]
    _, first, times = np.unique(word, return_index=True, return_counts=True)
    return word[first[times == 1]], cuts[first[times == 1]]


def n_chunks(texts: list[str | None], v: Vocabulary, method: str, scan_chars: int) -> np.ndarray:
    """In how many chunks each text's path is scanned."""
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    if method == "merges":
        return np.ones(len(texts), np.int32)
    return np.maximum(1, -(-size // (scan_chars if v.words_apart else CHUNK))).astype(np.int32)


def _mark(text: str) -> str:
    return BLANK + text.replace(" ", BLANK)


def encode_texts(texts: list[str | None], v: Vocabulary, method: str | None = None, scan_chars: int = SCAN) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts back to back and their count per text."""
    return _encode_marked([_mark(t) if t else "" for t in texts], v, method or v.method, scan_chars)


def _encode_marked(marked: list[str], v: Vocabulary, method: str, scan_chars: int = SCAN) -> tuple[np.ndarray, np.ndarray]:
    if method == "merges" and not v.words_apart:
        found = _processor(v.model).encode([m[1:].replace(BLANK, " ") for m in marked], num_threads=1)
        return np.fromiter(chain.from_iterable(found), np.int32), np.array([len(f) for f in found], np.int64)
    joined = "".join(marked)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in marked])])
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(marked), np.int64)
    begin = np.zeros(len(codes), bool)
    begin[bounds[:-1][np.diff(bounds) > 0]] = True
    if v.words_apart:
        blank = codes == ord(BLANK)
        begin[1:] |= blank[1:] & ~blank[:-1]
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(codes))
    length = ends - starts
    mixed = mix64(codes.astype(np.uint64) + np.uint64(1))
    inside = np.arange(len(codes)) - np.repeat(starts, length)
    names = mix64(np.add.reduceat(mixed * powers(int(length.max()) + 1)[inside], starts) + length.astype(np.uint64))
    _, first, which = np.unique(names, return_index=True, return_inverse=True)
    s, n = starts[first], length[first]
    if method == "merges":
        found = _processor(v.model).encode([joined[a + 1 : a + k].replace(BLANK, " ") for a, k in zip(s.tolist(), n.tolist(), strict=True)], num_threads=1)
        lone = [_processor(v.model).piece_to_id(BLANK)]  # a single blank is empty to the library
        found = [f or lone for f in found]
        count = np.array([len(f) for f in found], np.int64)
        ids, offset = np.fromiter(chain.from_iterable(found), np.int32, int(count.sum())), np.cumsum(count) - count
    else:
        ids, offset, count = _best_paths(codes, s, n, v)
        word, cuts = _ends_inside(bounds, starts, ends, scan_chars)
        found = _across(codes, starts[word], cuts, ends[word], v)
        which[word] = len(count) + np.arange(len(word))
        more = np.array([len(f) for f in found], np.int64)
        offset, count = np.concatenate([offset, len(ids) + np.cumsum(more) - more]), np.concatenate([count, more])
        ids = np.concatenate([ids, *found])
    counts = count[which]
    total = int(counts.sum())
    place = np.repeat(offset[which] - (np.cumsum(counts) - counts), counts) + np.arange(total)
    owner = np.searchsorted(bounds, starts, "right") - 1
    return ids[place], np.bincount(owner, weights=counts, minlength=len(marked)).astype(np.int64)


def decode_ids(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> list[bytes]:
    """The UTF-8 bytes each run of ids stands for."""
    length = np.array([len(t) for t in v.text], np.int64)
    table, begins = np.frombuffer(b"".join(v.text), np.uint8), np.cumsum(length) - length
    n = length[ids]
    raw = table[np.repeat(begins[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] if len(ids) else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
    data = raw.tobytes()
    return [data[a + 1 if data[a : a + 1] == b" " else a : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _decoded(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> pa.Array:
    return pa.array([t.decode("utf-8", "replace") for t in decode_ids(ids, counts, v)], pa.string())


def _plain(docs: DataFrame, v: Vocabulary, found: dict[str, tuple[str, ...]], scan_chars: int) -> DataFrame:
    """found: by method, the names of its ids, its number of chunks and, if wanted, of what the ids decode to; a text is read once for all methods."""
    names = [*docs.columns, *(c for own in found.values() for c in own)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{c} {kind}" for own in found.values() for c, kind in zip(own, ("array<int>", "int", "string"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts, columns = piece.column("text").to_pylist(), list(piece.columns)
            for method, own in found.items():
                ids, counts = encode_texts(texts, v, method, scan_chars)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(n_chunks(texts, v, method, scan_chars))]
                if len(own) > 2:
                    columns.append(_decoded(ids, counts, v))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def _giant_words(docs: DataFrame, v: Vocabulary, chunk_chars: int) -> DataFrame:
    """docs (row_key, text) as (row_key, piece_ids, n_chunks); chunks end with a word, so each is encoded alone."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                marked, at, k = _mark(text), 0, 0
                while at < len(marked):
                    to = len(marked)
                    if v.words_apart and at + chunk_chars < to:
                        next_word = _WORD_END.search(marked, at + chunk_chars)
                        to = next_word.end() if next_word else to
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([marked[at:to]])], names=["row_key", "chunk", "part"])
                    at, k = to, k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, _ = _encode_marked(batch.slice(i, 1).column("part").to_pylist(), v, "merges")
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).select(["row_key", "chunk"]).columns, pa.array([ids.tolist()], pa.list_(pa.int32()))], names=["row_key", "chunk", "ids"])

    chunks = cut(docs.mapInArrow(split, "row_key string, chunk int, part string").repartition("row_key", "chunk"))
    return _joined(chunks.mapInArrow(run, "row_key string, chunk int, ids array<int>"))


def _joined(coded: DataFrame) -> DataFrame:
    return coded.groupBy("row_key").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("piece_ids"), F.count("*").cast("int").alias("n_chunks")
    )


def _giant(docs: DataFrame, v: Vocabulary, chunk_chars: int) -> DataFrame:
    """docs (row_key, text) as (row_key, piece_ids, n_chunks)."""
    ahead = v.longest - 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                marked = BLANK + text.replace(" ", BLANK)
                for k, at in enumerate(range(0, len(marked), chunk_chars)):
                    part = marked[at : at + chunk_chars + ahead]
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([max(0, len(part) - chunk_chars)], pa.int32()), pa.array([part])], names=["row_key", "chunk", "ahead", "part"])

    chunks = cut(docs.mapInArrow(split, "row_key string, chunk int, ahead int, part string").repartition("row_key", "chunk"))
    scan = lambda row: Scan(np.frombuffer(row["part"].encode("utf-32-le"), np.uint32), row["ahead"], v)

    def each(batches: Iterator[pa.RecordBatch], work, names: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([row["row_key"]]), pa.array([row["chunk"]], pa.int32()), *work(row)], names=["row_key", "chunk", *names])

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each(batches, lambda row: [pa.array([scan(row).matrix().tobytes()])], ["matrix"])

    def enter(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        now, out = np.where(np.arange(v.longest) == 0, 0.0, -np.inf), []
        for m in group["matrix"]:
            out.append(now.tobytes())
            now = (now[:, None] + np.frombuffer(m).reshape(v.longest, v.longest)).max(0)
        return pd.DataFrame({"row_key": group["row_key"], "chunk": group["chunk"], "entry": out})

    entered = cut(chunks.join(chunks.mapInArrow(transfer, "row_key string, chunk int, matrix binary").groupBy("row_key").applyInPandas(enter, "row_key string, chunk int, entry binary"), ["row_key", "chunk"]))

    def trace_back(row: dict) -> list[pa.Array]:
        own = scan(row)
        _, back = own.forward(np.frombuffer(row["entry"]))
        last = int(own.inside[-1])
        reached = [e for e in range(v.longest) if last + e < back.shape[1] and (e == 0 or row["ahead"] >= e)]
        return [pa.array([[int(own.entries_by_exit(back, e)[0]) if e in reached else 0 for e in range(v.longest)]], pa.list_(pa.int32()))]

    def leave(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk", ascending=False)
        now, out = 0, []
        for m in group["origin"]:
            out.append(now)
            now = int(m[now])
        return pd.DataFrame({"row_key": group["row_key"], "chunk": group["chunk"], "leaving": out})

    origins = entered.mapInArrow(lambda b: each(b, trace_back, ["origin"]), "row_key string, chunk int, origin array<int>")
    exits = origins.groupBy("row_key").applyInPandas(leave, "row_key string, chunk int, leaving int")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each(batches, lambda row: [pa.array([scan(row).encode(np.frombuffer(row["entry"]), row["leaving"]).tolist()], pa.list_(pa.int32()))], ["ids"])

    coded = entered.join(exits, ["row_key", "chunk"]).mapInArrow(encode, "row_key string, chunk int, ids array<int>")
    return _joined(coded)


def _encode(docs: DataFrame, v: Vocabulary, found: dict[str, tuple[str, ...]], giant_chars: int, chunk_chars: int, scan_chars: int) -> DataFrame:
    added = [c for own in found.values() for c in own]
    docs = without(docs, *added)
    giant = F.coalesce(F.char_length("text") > giant_chars, F.lit(False))
    plain = _plain(docs.where(~giant), v, found, scan_chars)
    if docs.where(giant).isEmpty():
        return plain
    out = docs.where(giant).withColumn("row_key", F.sha2("text", 256))
    texts = out.dropDuplicates(["row_key"]).select("row_key", "text")
    for method, (ids, chunks, *decoded) in found.items():
        coded = (_giant_words if method == "merges" else _giant)(texts, v, chunk_chars).withColumnsRenamed({"piece_ids": ids, "n_chunks": chunks})
        out = out.join(decode(coded, v, ids, decoded[0]) if decoded else coded, "row_key")
    return plain.union(out.select(*docs.columns, *added))


def encode(docs: DataFrame, vocabulary: Vocabulary, method: str | None = None, giant_chars: int = 1 << 20, chunk_chars: int = 1 << 16, scan_chars: int = SCAN) -> DataFrame:
    """``docs`` plus piece_ids (array of ints) and n_chunks (the chunks its path is scanned in; for merges 1 unless the text is giant). method: the model's own by default."""
    return _encode(docs, vocabulary, {method or vocabulary.method: ("piece_ids", "n_chunks")}, giant_chars, chunk_chars, scan_chars)


def encode_both(docs: DataFrame, vocabulary: Vocabulary, giant_chars: int = 1 << 20, chunk_chars: int = 1 << 16, scan_chars: int = SCAN) -> DataFrame:
    """``docs`` plus piece_ids, n_chunks and decoded by the model's own method, path_ids, path_chunks and path_decoded by the max-plus scan."""
    own, path = ("piece_ids", "n_chunks", "decoded"), ("path_ids", "path_chunks", "path_decoded")
    if vocabulary.method == "max_plus":
        return _encode(docs, vocabulary, {"max_plus": own}, giant_chars, chunk_chars, scan_chars).withColumns({p: F.col(o) for o, p in zip(own, path, strict=True)})
    return _encode(docs, vocabulary, {vocabulary.method: own, "max_plus": path}, giant_chars, chunk_chars, scan_chars)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """``encoded`` plus ``to`` (string) from its ``ids``."""
    encoded = without(encoded, to)
    names = encoded.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(ids)
                counts = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(np.asarray(lists.flatten(), np.int64), counts, vocabulary)], names=[*names, to])

    return encoded.mapInArrow(run, f"{schema}, {to} string")
