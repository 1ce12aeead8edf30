from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import documents, odd_rows
from pyspark.sql import functions as F

from resona.llm import crf, embed_dedup, mixing, pieces, quality, registry, topk, toxicity
from resona.llm.tables import table

CLASSIFIERS = {"quality": (quality, 0.95), "toxic": (toxicity, 0.9)}


@pytest.mark.parametrize("label", sorted(CLASSIFIERS))
def test_held_out_accuracy(spark, label):
    module, least = CLASSIFIERS[label]
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    scored = module.classify(docs.select("doc_id", "text", "lang"), labels)
    assert scored.columns[:6] == ["doc_id", "text", "lang", "held_out", "score", "predicted"]
    joined = scored.join(labels.select("doc_id", label), "doc_id").where("held_out").toPandas()
    assert (joined["predicted"] == joined[label]).mean() >= least
    assert joined["score"].between(0, 1).all()


@pytest.mark.parametrize("label", sorted(CLASSIFIERS))
def test_classifier_edges(spark, sf_dir, label):
    module, _ = CLASSIFIERS[label]
    labels = table(spark, sf_dir, "labels")
    docs = documents(spark, odd_rows())
    model = module.train(table(spark, sf_dir, "documents"), labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.text in (None, "")}) == 1
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert module.score(docs.limit(0), model).count() == 0
    none = module.classify(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert module.classify(docs.limit(0), labels).count() == 0
    far = documents(spark, [(10**9 + i, f"calm river {i}") for i in range(3)])  # no labelled row among the documents
    assert len({r.score for r in module.classify(far, labels).collect()}) == 1
    spread = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, None, None)], labels.schema))
    assert module.classify(docs, spread).count() == len(odd_rows())


def test_toxic_spans(spark, sf_dir):
    docs = spark.createDataFrame([(1, "été là IDIOT!! then stupid words, idiot"), (2, "calm words only")], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels"))).collect()}
    assert [docs.first().text[s.start : s.end] for s in rows[1].toxic_spans] == ["IDIOT", "stupid", "idiot"] and rows[2].toxic_spans == []
    assert rows[1].score > rows[2].score


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    chain = crf.Chain(np.zeros(0), rng.normal(size=(2, 2)))
    full = rng.normal(size=6)
    full[[0, 2, 3, 5]] = -1.3  # the ordinary score
    weight = {}
    for k in range(64):
        states = [k >> i & 1 for i in range(6)]
        weight[k] = np.exp(sum(chain.moves[p, s] for p, s in zip([0, *states], states)) + sum(e for e, s in zip(full, states) if s))
    want = [sum(w for k, w in weight.items() if k >> i & 1) / sum(weight.values()) for i in range(6)]
    assert np.allclose(crf.marginals(chain, full, np.array([6])), want)
    listed = np.array([1, 4])
    assert np.allclose(crf.marginals(chain, full[listed], np.array([2]), np.array([1, 2]), np.array([1]), -1.3), np.array(want)[listed])


def test_unlisted_positions_count_in_full():
    rng = np.random.default_rng(5)
    parts = {n: rng.random(n) < 0.4 for n in (12, 5, 9, 7)} | {4: np.zeros(4, bool)}
    full, states = [], []
    for n, listed in parts.items():
        full.append(np.column_stack([np.ones(n), np.where(listed[:, None], rng.normal(size=(n, 2)), 0)]))
        states.append(np.where(listed, rng.integers(0, 2, n), 0))
    at = [np.flatnonzero(listed) for listed in parts.values()]
    gaps = np.concatenate([np.diff(a, prepend=-1) - 1 for a in at])
    tails = np.array([n - 1 - a[-1] if len(a) else n for n, a in zip(parts, at)])
    share = sum(map(len, at)) / sum(parts)  # the penalty is weighed against listed positions
    one = crf.fit(np.concatenate(full), np.concatenate(states), np.array(list(parts)), penalty=1e-3 * share)
    two = crf.fit(np.concatenate([x[a] for x, a in zip(full, at)]), np.concatenate([s[a] for s, a in zip(states, at)]), np.array([len(a) for a in at]), gaps, tails)
    assert np.allclose(one.weights, two.weights, atol=1e-4) and np.allclose(one.moves, two.moves, atol=1e-4)


def test_toxicity_learns_from_late_tokens(spark):
    calm = " ".join(f"calm{i % 9} river flows" for i in range(80))
    docs = documents(spark, [(i, f"{calm} vile gromphus {calm}" if i % 2 else calm) for i in range(500)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows) and all(len(r.toxic_spans) == 2 * (r.doc_id % 2) for r in rows)


def test_scores_under_clashing_names(spark, sf_dir):
    docs = spark.createDataFrame([(1, "calm words", 3.0, 7, "y")], "doc_id long, text string, Score double, Predicted int, _held string")
    for module in (quality, toxicity):
        out = module.score(docs, module.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
        assert out.columns[:6] == ["doc_id", "text", "_held", "held_out", "score", "predicted"] and out.select("score", "_held").first()._held == "y"


def test_quality_learns_from_late_lines(spark):
    calm = [f"the calm river number {i} runs on" for i in range(40)]
    docs = documents(spark, [(i, "\n".join(calm + ["#$% @! #$%"] * 20 if i % 2 else calm)) for i in range(60)])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.chain.weights[1 + quality.SYMBOL] > 0.1
    rows = quality.score(docs, model).collect()
    assert all(r.predicted == 1 - r.doc_id % 2 for r in rows)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(registry.vocabulary_path())


def by_force(text, v, known):
    if not text:
        return []
    s = "▁" + text.replace(" ", "▁")
    best, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
    for i in range(len(s)):
        for n in range(1, 17):
            if i + n > len(s):
                break
            piece = known.get(s[i : i + n])
            score = v.scores[piece] if piece is not None else v.unknown if n == 1 else None
            if score is not None and best[i] + score > best[i + n]:
                best[i + n], back[i + n] = best[i] + score, (i, piece)
    out, at = [], len(s)
    while at:
        i, piece = back[at]
        out.append([piece] if piece is not None else [int(v.byte_ids[b]) for b in s[i:at].encode()])
        at = i
    return [x for part in out[::-1] for x in part]


def test_pieces_match_brute_force(vocabulary):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=registry.vocabulary_path())
    known = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    rng = random.Random(1)
    texts = ["", None, "a", "  ", "   a  b", "日本語テキスト" * 40, "x" * 500, "abc😀def\n\n\tq", *["".join(rng.choice("abcdefgh 日é😀") for _ in range(rng.randrange(400))) for _ in range(40)]]
    ids, counts = pieces.encode_texts(texts, vocabulary, "max_plus")
    ends = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [by_force(t, vocabulary, known) for t in texts]
    assert [t.decode() for t in pieces.decode_ids(ids, counts, vocabulary)] == [t or "" for t in texts]


@pytest.mark.parametrize("scan_chars", [5, 64, 700])
def test_chunks_end_anywhere(vocabulary, scan_chars):
    rng = random.Random(15)
    texts = ["", None, "日本語テキスト" * 60, "x" * 900 + " y", "   " * 90, *["".join(rng.choice("abcdefgh  日é😀") for _ in range(rng.randrange(3000))) for _ in range(12)]]
    whole, chunked = (pieces.encode_texts(texts, vocabulary, "max_plus", n) for n in (1 << 40, scan_chars))
    assert np.array_equal(whole[0], chunked[0]) and np.array_equal(whole[1], chunked[1])
    assert pieces.n_chunks(texts, vocabulary, "max_plus", scan_chars).max() > 1


def test_merges_are_the_library_s(spark, sf_dir, vocabulary):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=registry.vocabulary_path())
    texts = ["", "the quick  brown fox", "   a  b ", "日本語テキスト" * 30, "abc😀def\n\n\tq", *[r.text for r in table(spark, sf_dir, "documents").limit(40).collect()]]
    ids, counts = pieces.encode_texts(texts, vocabulary)
    ends = np.concatenate([[0], np.cumsum(counts)])
    assert vocabulary.method == "merges" and [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [model.encode(t) for t in texts]
    assert ids[ends[1]] == model.piece_to_id("▁the") and pieces.encode_texts(["the"], vocabulary, "max_plus")[1][0] == 2


@pytest.mark.parametrize("method", ["merges", "max_plus"])
def test_giant_texts_encode_alike(spark, sf_dir, vocabulary, method):
    docs = documents(spark, odd_rows()).unionByName(table(spark, sf_dir, "documents").limit(15), allowMissingColumns=True).select("doc_id", "text", "row")
    plain = pieces.encode(docs, vocabulary, method)
    scanned = pieces.decode(pieces.encode(docs, vocabulary, method, giant_chars=900, chunk_chars=257), vocabulary)
    key = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", tuple(r.piece_ids)) for r in df.collect())
    assert key(plain) == key(scanned)
    rows = scanned.collect()
    assert all(r.decoded == (r.text or "") for r in rows) and max(r.n_chunks for r in rows) > 100
    assert pieces.encode(docs.limit(0), vocabulary, method).count() == 0


def test_piece_query_returns_the_model_s_ids(spark, sf_dir, vocabulary):
    import hashlib

    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=registry.vocabulary_path())
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = registry.op3_piece_encoding(spark, sf_dir).collect()
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    assert all((r.n_pieces, r.ids_sha256) == (len(ids := model.encode(texts[r.doc_id])), digest(ids)) for r in rows)
    assert all(r.path_sha256 == digest(pieces.encode_texts([texts[r.doc_id]], vocabulary, "max_plus")[0].tolist()) for r in rows[:20])
    docs = documents(spark, [(1, None), (2, "one two  three"), (3, "the quick brown fox " * 60)]).select("doc_id", "text")
    key = lambda df: sorted((r.doc_id, tuple(r.piece_ids), tuple(r.path_ids), r.decoded, r.path_decoded) for r in df.collect())
    assert key(pieces.encode_both(docs, vocabulary)) == key(pieces.encode_both(docs, vocabulary, giant_chars=900, chunk_chars=257))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")


def planted(seed=0, d=32):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        for _ in range(12):
            base = rng.normal(size=d)
            for _ in range(rng.integers(1, 8)):
                v = base + rng.normal(size=d) * rng.choice([0.0, 0.02, 0.1, 0.25])
                rows.append((len(rows), [float(x) for x in v.astype(np.float32)], label))
    return rows


@pytest.mark.parametrize("block", [4, 2048])
def test_embedding_links_match_brute_force(spark, block):
    rows = planted()
    odd = [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] + [1.0] * 31, 0), (903, rows[0][1], None), (904, [1.0, 2.0], 0), (None, rows[0][1], 0), (905, [], 0), (906, [None] + [1.0] * 31, 1)]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(vectors(spark, rows + odd), block=block).collect()}
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([min([root[i], *root[link[i]]]) for i in range(len(x))])
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(x))] == [(int(link[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(x))]
    assert link.sum() > 50
    assert all(got[v].n_links == 0 and (got[v].component_id, got[v].kept) == (v, True) for v in (900, 901, 902, 903, 904, 905, 906))
    assert embed_dedup.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_repeated_vectors_link(spark):
    got = embed_dedup.near_duplicates(vectors(spark, [(5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (4, [2.0, 4.0], 1)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(3, 3, 3, True), (4, 3, 3, False), (5, 3, 3, False), (5, 3, 3, False)]


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32).round(1)], 0) for i in range(400)]
    rows += [(500 + i, rows[i][1], 0) for i in range(50)] + [(600, None, 0), (601, [float("inf")] * 6, 0), (602, [1.0], 0), (650, [2.0], 0)]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, block=64, query_block=3).collect()
    ints = {i: np.floor(256 * np.array(v, np.float64)).astype(int) for i, v, _ in rows if v and np.isfinite(v).all()}
    want = []
    for q in ints:
        if q % 50 == 0:
            ranked = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(vectors(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_repeated_query_rows(spark):
    rows = [(i, [float(i % 7), float(i % 5)], 0) for i in range(1, 40)] + [(50, [1.0, 2.0], 0), (50, [1.0, 2.0], 0), (50, [3.0, 0.0], 0), (50, [0.5], 0)]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert got == []  # the first vector in array order is the short one, which has no other of its length
    got = topk.top_k(vectors(spark, rows[:-1]), F.col("vec_id") % 50 == 0).collect()
    want = sorted((-(256 * 256 * (i % 7) + 2 * 256 * 256 * (i % 5)), i) for i in range(1, 40))[:5]
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_top_k_of_large_components(spark):
    """Scores are exact or not given."""
    near = [(50, [300_000.0, 1.0], 0), (51, [299_999.0, -5.0], 0), (52, [-4.0, 2.0], 0)]
    got = topk.top_k(vectors(spark, near), F.col("vec_id") % 50 == 0).collect()
    score = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(a, b))
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(51, score(near[0][1], near[1][1])), (52, score(near[0][1], near[2][1]))]
    with pytest.raises(ValueError, match="too large"):
        topk.top_k(vectors(spark, [(50, [3e9, 1.0], 0), (51, [3e9, 2.0], 0)]), F.col("vec_id") % 50 == 0)


def test_sainte_lague_matches_the_quotients():
    rng = random.Random(6)
    for _ in range(200):
        claims = np.array([rng.choice([0, rng.randrange(1, 50), rng.random() * 30]) for _ in range(rng.randrange(1, 8))], float)
        limits = np.array([rng.randrange(0, 30) for _ in claims])
        seats = rng.randrange(0, 60)
        pool = sorted((-c / (2 * k + 1), i) for i, (c, m) in enumerate(zip(claims, limits)) if c > 0 for k in range(m))[:seats]
        want = np.bincount([i for _, i in pool], minlength=len(claims)) if pool else np.zeros(len(claims), int)
        assert mixing.sainte_lague(claims, seats, limits).tolist() == want.tolist()


def test_mix_keeps_its_promises(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 90))), rng.choice(["a", "b", "c", "dd", None])) for i in range(500)] + [(900, None, "a"), (None, "x y", "b"), (3, "x y", "a"), (3, "x y", "a")]
    docs = documents(spark, rows)
    out = mixing.mix(docs, shard_words=2000).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 3 * out["size"]).all() and (out["taken"] >= 0).all()
    by = out.groupby(out["source"].fillna("~")).agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"), told=("source_size", "first"))
    assert (by["size"] == by["told"]).all() and (abs(by["taken"] - by["target"]) <= 16 * 6 + 0.02 * by["target"]).all()
    again = mixing.mix(docs.repartition(7), shard_words=2000).toPandas()
    order = ["doc_id", "source", "size", "taken"]
    assert out.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    ids = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf)
        assert docs.columns == before.columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        docs = spark.createDataFrame(docs.toPandas(), before.schema)
    assert 0 < len(ids[0]) < 1000 and ids[1] == ids[0] and len(ids[2]) < len(ids[1]) and ids[3] < ids[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.where("n_pieces = 0").count() == 0


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empties, one doc_id for two texts, repeated rows, clashing names, and no rows at all."""
    import corpus_pipeline

    text = lambda k: " ".join(f"{k}{i} flows" for i in range(40))
    full = [(1, text("a")), (1, text("b")), (2, None), (3, ""), (4, text("c")), (4, text("c")), (None, text("d")), (None, text("d")), (5, text("a") + " end"), (6, "  \n ")]
    names = "doc_id long, text string, lang string, source string, n_chars long, Score double, Piece_IDs string, _words string, _size string, _id string, row string, n_lines long, held_out string"
    rows = [(i, t, "en", None if i == 4 else "s", None if t is None else len(t), 1.5, "p", "w", "z", "i", "r", 7, "h") for i, t in full]
    docs = spark.createDataFrame(rows, names)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), sf_dir).count() == 0
        kept[name] = out.collect()
        assert all((r.Score, r.Piece_IDs, r._words, r._size, r._id, r.row, r.n_lines, r.held_out) == (1.5, "p", "w", "z", "i", "r", 7, "h") for r in kept[name])
    pairs = lambda name: sorted((r.doc_id or 0, r.text or "") for r in kept[name])
    assert pairs("toxicity") == sorted((i or 0, t or "") for i, t in full)
    assert len(kept["line dedup"]) == len(full)
    # the two texts of doc_id 1 both stay, the copies of 4 and of the row without id stay once, 5 is a near copy
    assert pairs("minhash near-dedup") == sorted([(1, text("a")), (1, text("b")), (2, ""), (3, ""), (4, text("c")), (0, text("d")), (6, "  \n ")])
    taken = sum(len(r.text.split()) for r in kept["source mix"])
    assert abs(taken - sum(len((t or "").split()) for _, t in full)) <= 40 and all(r.n_chars == len(r.text) for r in kept["source mix"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == len(full) and all((r.n_pieces == 0) == (r.doc_id in (2, 3)) for r in last)


def test_the_mix_is_what_it_says(spark):
    """The texts that ``take`` gives hold the words that ``mix`` counts, as stretches of the documents."""
    rng = random.Random(12)
    rows = [(i, "  ".join(f"d{i}w{k}\n" for k in range(rng.randrange(1, 70))), rng.choice("abc")) for i in range(300)] + [(None, "x y z", "a")] * 40
    docs = documents(spark, rows)
    taken = mixing.mix(docs).groupBy("source").agg(F.sum("taken")).collect()
    texts = mixing.take(docs).collect()
    assert {r.source: r[1] for r in taken} == {s: sum(len(r.text.split()) for r in texts if r.source == s) for s in "abc"}
    whole = {(r[0], r[1]) for r in rows}
    by_id = {r[0]: r[1] for r in rows}
    assert all(r.text in by_id[r.doc_id] for r in texts) and sum((r.doc_id, r.text) not in whole for r in texts) <= 9  # the ends of a run, and of a block


def test_many_sources_and_rows_without_id(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, "w " * rng.randrange(1, 30), f"s{i % 40}") for i in range(400)] + [(None, "u v", "s1")] * 300
    docs = documents(spark, rows)
    key = lambda df: sorted((r.doc_id or -1, r.source, r.size, r.taken) for r in df.collect())
    one = key(mixing.mix(docs, shard_words=100, most_shards=4))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert one == key(mixing.mix(docs.repartition(5), shard_words=100, most_shards=4)) and len(one) == len(rows)


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_match_union_find(spark, few):
    from resona.llm.components import components

    rng = random.Random(14)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(7, 7)]
    root = {}
    for a, b in edges:
        if a != b:
            both = root.get(a, {a}) | root.get(b, {b})
            root.update({n: both for n in both})
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    assert got == {n: min(s) for n, s in root.items()}


def test_embedding_recall(spark):
    """Against all pairs of sf0.1."""
    import duckdb

    from resona.llm import oracle

    duck = duckdb.connect()
    duck.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    want = {r[0]: r[1] for r in duck.sql(f"SELECT vec_id, n_links FROM ({oracle.OP5})").fetchall()}
    got = {r.vec_id: r.n_links for r in registry.op5_embedding_dedup(spark, "/root/testdata/sf0.1").collect()}
    assert got.keys() == want.keys() and sum(got.values()) >= 0.99 * sum(want.values()) and all(got[k] <= want[k] for k in want)


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage and the pipeline, the entry imports and offers the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[2]
    shutil.copytree(repo / "resona", tmp_path / "resona", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
