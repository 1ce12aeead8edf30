from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from helpers import documents, odd_rows
from pyspark.sql import functions as F

from resona.llm import audit, codes, decontam


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<double>, label string, Code string, row double")


def nearest(parts, books):
    """(entry, squared distance) of each row of ``parts`` [n, w], the first of equals."""
    apart = ((parts[:, None] - books[None]) ** 2).sum(-1)
    return apart.argmin(1), apart.min(1)


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_pruned_assignment_is_the_plain_one(leaf):
    rng = np.random.default_rng(leaf)
    for n, k, w, spread in ((1, 1, 1, 5), (40, 16, 3, 4), (300, 7, 2, 1000), (513, 16, 8, 3), (64, 5, 0, 9)):
        parts, books = rng.integers(-spread, spread, (codes.PARTS, n, w)), rng.integers(-spread, spread, (codes.PARTS, k, w))
        if w == 0:
            continue
        tree = codes._unpacked(codes._packed(grown := codes.grow(parts, leaf)), grown.depth, grown.points.shape[1], w)
        code, sums, counts, _ = codes.assign(tree, books)
        for p in range(codes.PARTS):
            want, _ = nearest(parts[p], books[p])
            real = tree.order[p] >= 0
            got = np.full(n, -1)
            got[tree.order[p][real]] = code[p][real]
            assert got.tolist() == want.tolist()
            assert counts[p].tolist() == np.bincount(want, minlength=k).tolist()
            assert all((sums[p, e] == parts[p][want == e].sum(0)).all() for e in range(k))


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(3)
    middles = rng.integers(-5000, 5000, (codes.PARTS, 16, 4))
    which = rng.integers(0, 16, (codes.PARTS, 4096))
    parts = np.take_along_axis(middles, which[:, :, None], 1) + rng.integers(-200, 200, (codes.PARTS, 4096, 4))
    _, _, counts, work = codes.assign(codes.grow(parts, codes.LEAF), middles)
    assert counts.sum() == parts.shape[0] * parts.shape[1] and work < 0.1 * parts.shape[0] * parts.shape[1] * 16


def lloyd(rows, rounds=6):
    """{vec_id: (code, error)} by the plain rounds, for vectors of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.floor(np.array([r[1] for r in rows]) * 4096).astype(np.int64)
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % 8)))
    parts = v.reshape(len(v), 8, -1)
    books = parts[:16].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for p in range(8):
            at, _ = nearest(parts[:, p], books[p])
            for e in range(books.shape[1]):
                if (at == e).any():
                    books[p, e] = parts[at == e, p].sum(0) // (at == e).sum()
    found = [nearest(parts[:, p], books[p]) for p in range(8)]
    out = [("".join(f"{found[p][0][i]:02x}" for p in range(8)), int(sum(found[p][1][i] for p in range(8)))) for i in range(len(rows))]
    return [(r[0], r[2], *x, codes.digest(books)) for r, x in zip(rows, out, strict=True)]


@pytest.mark.parametrize("block", [5, 2048])
def test_codes_match_plain_rounds(spark, block):
    rng = np.random.default_rng(9)
    make = lambda n, d, at: [(at + i, [float(x) for x in rng.normal(size=d).round(2)], rng.choice(["a", "b", None])) for i in range(n)]
    long, odd_length, few = make(150, 16, 0), make(40, 11, 1000), make(3, 8, 2000)
    long += [long[3], long[3], (None, long[4][1], None), (7, long[9][1], "a")]  # repeated rows, no id, one id for two vectors
    bad = [(3000, None, "a"), (3001, [], "a"), (3002, [float("nan")] * 16, "a"), (3003, [None] + [1.0] * 15, "b"), (3004, [float("-inf")] * 16, None)]
    coded, books = codes.compress(vectors(spark, long + odd_length + few + bad), block=block)
    got = codes.with_label_errors(coded)
    assert set(got.columns) == {"vec_id", "label", "row", "code", "error", "codebooks_sha256", "label_error"} and sorted(books) == [8, 11, 16]
    got = got.collect()
    want = lloyd(long) + lloyd(odd_length) + lloyd(few)
    key = lambda rows: sorted(rows, key=repr)
    assert key((r.vec_id, r.label, r.code, r.error, r.codebooks_sha256) for r in got) == key(want)
    by_label = Counter()
    for _, label, _, error, _ in want:
        by_label[label] += error
    assert all(r.label_error == by_label[r.label] for r in got)


def test_code_edges(spark):
    assert codes.with_label_errors(codes.compress(vectors(spark, [(1, [1.0] * 8, "a")]).limit(0))[0]).count() == 0
    one = codes.compress(vectors(spark, [(1, [0.5] * 8, None)]))[0].collect()
    assert [(r.code, r.error) for r in one] == [("00" * 8, 0)]
    with pytest.raises(ValueError, match="too large"):
        codes.compress(vectors(spark, [(1, [1e9] * 8, None)]))


WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def flags_by_force(rows):
    """{(doc_id, text): set of failed filters}."""
    texts = defaultdict(list)
    for i, t in rows:
        if i is not None:
            texts[t or ""].append(i)
    out = []
    for i, t in rows:
        t = t or ""
        w = WHITE.findall(t)
        fails = {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and min(texts[t]) < i else set()
        out.append((i, len(w), len(set(w)), "".join(sorted(fails))))
    return out


def audit_rows():
    rng = random.Random(21)
    rows = []
    for i in range(120):
        words = [rng.choice(["été", "Calm", "river", "FLOW", "x|y", "日本", f"w{rng.randrange(300)}", f"v{rng.randrange(9)}"]) for _ in range(rng.choice([5, 150, 240, 400]))]
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(words)))
    return rows + [(200 + i, rows[i % 7][1]) for i in range(30)] + odd_rows()


@pytest.mark.parametrize("sizes", [{"shard_bytes": 3000, "bucket_bytes": 800}, {}])
def test_filter_flags_match_brute_force(spark, sizes):
    rows = audit_rows()
    got = audit.failures(documents(spark, rows).repartition(3), **sizes).collect()
    named = lambda f: "".join(x for k, x in enumerate("ABCDE") if f >> k & 1)
    assert sorted(((r.doc_id, r.n_words, r.n_distinct, named(r.fails)) for r in got), key=repr) == sorted(flags_by_force(rows), key=repr)


def test_document_term_matrix(spark):
    rows = audit_rows()
    docs = documents(spark, rows).repartition(3).select(F.struct(F.coalesce("text", F.lit("")).alias("t")).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    shards, terms = audit.matrix(docs, shard_bytes=3000, bucket_bytes=800)
    words = {r.id: r.word for r in terms.collect()}
    assert sorted(words.values()) == sorted({w for _, t in rows for w in WHITE.findall(t or "")})
    got = []
    for s in shards.collect():
        for k, own in enumerate(s.rows):
            a, b = s.bounds[k], s.bounds[k + 1]
            got.append((own.row.t, sorted((words[c], n) for c, n in zip(s.columns[a:b], s["counts"][a:b], strict=True))))
    assert sorted(got) == sorted((t or "", sorted(Counter(WHITE.findall(t or "")).items())) for _, t in rows)


def test_audit_matches_brute_force(spark):
    rows = [(i, t) for i, t in audit_rows()]
    rng = random.Random(2)
    langs = [rng.choice(["en", "de", None, ""]) for _ in rows]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _ in rows if rng.random() < 0.7] + [(5, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, g, 7) for (i, t), g in zip(rows, langs, strict=True)], "doc_id long, text string, lang string, fails int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    known = defaultdict(lambda: (False, False))
    for i, q, x in labels:
        if i is not None:
            known[i] = (known[i][0] or q == 1, known[i][1] or x == 1)
    judged = [(g or "", f, *(known[i] if i is not None else (False, False))) for (i, _, _, f), g in zip(flags_by_force(rows), langs, strict=True)]
    want, removed = {}, Counter()
    for part in {j[0] for j in judged}:
        for order in map("".join, permutations("ABCDE")):
            left = [j for j in judged if j[0] == part]
            whole = left
            for step, x in enumerate(order, 1):
                gone = [j for j in left if x in j[1]]
                left = [j for j in left if x not in j[1]]
                removed[part, x] += len(gone)
                want[part, order, step] = [x, len(left), len(gone), sum(x in j[1] for j in whole) - len(gone), sum(j[1] == x for j in whole), sum(j[2] for j in gone), sum(j[3] for j in gone)]
    assert got == {k: (*v[1:], removed[k[0], v[0]]) for k, v in want.items()}
    assert audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hits_by_force(rows, items, window):
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    wanted = defaultdict(set)
    for i, t in items:
        w = split(t)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            wanted[tuple(w[at : at + window])].add(i)
    out = []
    for i, t in rows:
        w, hit, ids = split(t), set(), set()
        for n in {len(x) for x in wanted}:
            for at in range(len(w) - n + 1):
                if (found := wanted.get(tuple(w[at : at + n]))) is not None:
                    hit |= set(range(at, at + n))
                    ids |= found
        out.append((i, len(w), sorted(hit), sorted(str(x) for x in ids if x is not None)))
    return out


@pytest.mark.parametrize("most", [7, 10**6])
@pytest.mark.parametrize("window", [4, 10])
def test_decontamination_matches_brute_force(spark, most, window):
    rng = random.Random(window)
    pick = lambda n, k=12: [f"w{rng.randrange(k)}" for _ in range(n)]
    common = pick(30, 400)
    items = [(i, "  ".join(pick(rng.randrange(1, 25), 60)).title()) for i in range(14)] + [(20, " ".join(common)), (21, ", ".join(common[5:25])), (20, "Été 日本 x9"), (None, "alone b c"), (30, None), (31, "!?"), (32, "w1 w1")]
    texts = {i: t for i, t in items if t}
    rows = []
    for i in range(60):
        words = pick(rng.randrange(0, 50), 60)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = WORD.findall(rng.choice(list(texts.values())).translate(LOWER))
        rows.append((i, rng.choice([" ", "-", "\n"]).join(words)))
    rows += [(100 + i, f"x{i} " + "; ".join(common).upper()) for i in range(25)]  # a passage many share
    rows += [(200, "été 日本 x9 w1"), (200, "été 日本 x9 w1"), (201, "ALONE b c d"), (202, "w1 w1w1 w1"), *odd_rows()]
    docs = documents(spark, rows).withColumn("Hits", F.lit(3)).repartition(3)
    bench = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, window string")
    out = decontam.decontaminate(docs, bench, window, most_windows=most)
    assert [c for c in out.columns if c.lower() == "hits"] == ["hits"] and "lang" in out.columns
    got = [(r.doc_id, r.n_words, [k for h in r.hits for k in range(h.first, h.end)], r["items"]) for r in out.collect()]
    want = hits_by_force(rows, items, window)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r.n_hit == sum(h.end - h.first for h in r.hits) and r.n_items == len(r["items"]) for r in out.collect())
    assert sum(len(w[2]) > 0 for w in want) > 40


def test_decontamination_edges(spark):
    docs = documents(spark, odd_rows())
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    none = decontam.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == len(odd_rows()) and not any(r.n_hit or r.n_items for r in none)
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect() if r.n_hit == 3} == {3, None}
