"""Ball k-means, substring dedup and collocations against brute force, and their defined cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import centroids, collocations, substrings
from skein.llm.chunks import pieces

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


def texts(seed, n, vocabulary, longest, passages=4):
    """Texts of few words with passages that several share."""
    rng = random.Random(seed)
    shared = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 40))] for _ in range(passages)]
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(longest))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        yield "".join(w + rng.choice([" ", "  ", "\n", ", ", ". ", "\t"]) for w in words)


def test_pieces_hold_all_rows_in_order_and_a_bounded_size():
    rng = random.Random(1)
    rows = ["x" * rng.choice([0, 1, 50, 500]) for _ in range(300)] + [None]
    batches = [pa.RecordBatch.from_pydict({"t": pa.array(rows[i : i + 70], pa.string())}) for i in range(0, len(rows), 70)]
    got = list(pieces(batches, "t", 1000))
    assert [v for part in got for v in part.column("t").to_pylist()] == rows
    assert all(p.num_rows == 1 or sum(len(v or "") for v in p.column("t").to_pylist()) <= 1000 for p in got)
    assert not list(pieces([], "t", 10))


# 11 ball k-means
def brute_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middle = [v for _, v in named[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(middle)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                middle[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=str), middle


@pytest.mark.parametrize("seed, dims, k, spread, rounds", [(1, 3, 4, 2.0, 3), (2, 2, 7, 0.05, 4), (3, 5, 16, 1.0, 3), (4, 1, 5, 0.1, 6), (5, 64, 16, 0.3, 3)])
def test_clusters_equal_brute_force(spark, seed, dims, k, spread, rounds):
    """Small spreads make many ties and empty clusters."""
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 2]), spread) for _ in range(dims)]) for i in range(250)] + [(7, [0.0] * dims), (7, [0.0] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    start = centroids.first_centroids(df, k, dims, 64, "vec_id", "embedding")
    got, final = centroids.cluster_vectors(df, start, rounds, 64, dims=dims)
    want, middle = brute_clusters(rows, k, rounds, dims, 64)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert final.tolist() == middle


def test_neighbours_beyond_a_balls_reach_are_left_out_and_not_needed():
    rng = np.random.default_rng(4)
    middle = rng.integers(-900, 900, (40, 3))
    data = np.concatenate([c + rng.integers(-60, 60, (50, 3)) for c in middle])
    own = np.repeat(np.arange(40, dtype=np.uint32), 50)
    far = ((data[:, None] - middle) ** 2).sum(axis=2)
    reach = [int(np.sqrt(far[own == i, i].max())) + 1 for i in range(40)]
    balls = centroids.Balls(middle, reach)
    assert sum(map(len, balls.neighbours)) < 40 * 39 / 4
    cluster, nearest = balls.assign(data, own)
    assert (nearest == far.min(axis=1)).all() and (cluster == far.argmin(axis=1)).all()


def test_cases_of_vectors(spark):
    rows = [(1, [1.0, 2.0], 5), (None, [1.0, 2.5], 5), (2, None, 5), (3, [1.0], 5), (4, [1.0, None], 5), (5, [float("nan"), 1.0], 5), (6, [float("inf"), 1.0], 5), (7, [], 5), (1, [1.0, 2.0], 5), (8, [-0.01, 9.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    start = centroids.first_centroids(df, 16, 2, 64, "vec_id", "embedding")
    got, _ = centroids.cluster_vectors(df, start, 3, 64, dims=2)
    want, _ = brute_clusters([r[:2] for r in rows], 16, 3, 2, 64)
    assert len(start) == 3 and sorted((tuple(r) for r in got.collect()), key=str) == want
    none = df.where("false")
    got, final = centroids.cluster_vectors(none, centroids.first_centroids(none, 16, 2, 64, "vec_id", "embedding"), 3, 64, dims=2)
    assert got.count() == 0 and len(final) == 0
    with pytest.raises(Exception, match="no longer exact"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e12, 1.0])], "vec_id long, embedding array<double>"), [[0, 0]], 1, 64, dims=2)


# 12 substring dedup
def brute_removed(rows, words):
    found = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, ws in found:
        for s in range(len(ws) - words + 1):
            key = tuple(ws[s : s + words])
            least[key] = min(least.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, ws in found:
        gone = set()
        for s in range(len(ws) - words + 1):
            if least[tuple(ws[s : s + words])] < (float("inf") if i is None else i):
                gone |= set(range(s, s + words))
        out.append((i, len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    return sorted(out, key=str)


def removed(df, **options):
    marked, _ = substrings.mark_repeats(df, **options)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in marked.collect()), key=str)


def test_covers_bring_any_two_places_into_line():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert [substrings.cover_for(n)[0] for n in (1, 2, 4, 12, 13, 26, 50, 100)] == [1, 1, 3, 7, 7, 13, 21, 31]


@pytest.mark.parametrize("words, vocabulary, chunk", [(13, "abcdef", 400), (13, "ab", 1 << 20), (1, "abcdefgh", 300), (5, "abc", 500), (30, "ab", 700)])
def test_removed_words_equal_brute_force(spark, monkeypatch, words, vocabulary, chunk):
    rows = list(enumerate(texts(words, 60, vocabulary, 60)))
    rows += [(3, rows[9][1]), (None, rows[5][1]), (None, rows[5][1] + "tail"), (1000, None), (1001, ""), (1002, "é\x0bü " * 40), (1003, "é\x0bü " * 40)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS).repartition(3)
    assert removed(df, words=words, chunk_bytes=chunk) == brute_removed(rows, words)
    monkeypatch.setattr(substrings, "buckets_for", lambda size: 37)
    assert removed(df, words=words, chunk_bytes=chunk) == brute_removed(rows, words)


def test_long_texts_are_cut_between_words(monkeypatch):
    data = b"  one two\tthree\xc3\xa9 four\n" * 50
    for most in (1, 3, 7, 1000):
        assert [w for c in substrings.cuts(data, most) for w in c.split()] == data.split()
    assert list(substrings.cuts(b"x" * 50, 3)) == [b"x" * 50]


def test_removed_spans_and_other_columns(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"a {passage} b"), (2, f"c d {passage}")]
    names = ["chunk", "asked", "bucket", "bits", "first", "second", "extra", "_h", "start", "n_words"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(f"own {n}") for n in names})
    marked, _ = substrings.mark_repeats(df)
    got = {r["doc_id"]: r for r in marked.collect()}
    assert [(s["start"], s["end"]) for s in got[2]["removed"]] == [(2, 22)] and got[1]["removed"] == []
    assert got[2]["kept_text"] == "c d" and got[2]["text"] == rows[1][1] and got[2]["n_words"] == 22
    assert all(got[1][n] == f"own {n}" for n in names[:-1])
    assert removed(df.where("false")) == []


def test_one_passage_in_all_documents(spark):
    """A hot passage: every chunk asks for it once."""
    passage = "the same thirteen words and some more stand in each and every one of these texts"
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " "), F.col("id").cast("string")).alias("text"))
    got = removed(df, chunk_bytes=20_000)
    n = len(passage.split())
    assert all(x == (i, n + 1, 0 if i == 0 else n, f"{passage} 0" if i == 0 else str(i)) for i, *_ in got for x in [(i, *_)])


# 13 collocations
def brute_collocations(rows, least, longest, top, percent=100):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                for s in range(len(ws) - k + 1):
                    f[lang, tuple(ws[s : s + k])] += 1
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    explained = set()
    for (lang, ws), a in found.items():
        for k in range(2, len(ws)):
            explained |= {(lang, ws[s : s + k]) for s in range(len(ws) - k + 1) if 100 * a >= percent * f[lang, ws[s : s + k]]}
    out = {}
    for (lang, ws), a in found.items():
        if (lang, ws) not in explained:
            cut = lambda k, lang=lang, ws=ws, a=a: (1000 * a * total[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k)
            score, k = min(map(cut, range(1, len(ws))))
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, xs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top]))


def mined(df, least, longest=5, top=50, **options):
    return sorted(tuple(r) for r in collocations.collocations(*collocations.frequent_phrases(df, longest, least, **options), top=top).collect())


@pytest.mark.parametrize("seed, vocabulary, least, buckets", [(1, ["a", "B", "c", "é", "D.", "x"], 4, 1 << 10), (2, [f"w{i}" for i in range(60)], 3, None), (3, ["a", "a", "b"], 300, 1 << 12)])
def test_collocations_equal_brute_force(spark, seed, vocabulary, least, buckets):
    rng = random.Random(seed)
    rows = [(t, rng.choice(["en", "de", None, "und", ""])) for t in texts(seed, 150, vocabulary, 40)] + [(None, "en"), ("", "fr"), (" .\t,", "fr"), ("x\x0by\rz", "de")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).repartition(3)
    want = brute_collocations(rows, least, 5, 50)
    assert want and mined(df, least, buckets=buckets, chunk_bytes=900) == want


def test_collocations_of_nothing_and_of_other_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 30, "en")], DOCS).withColumns({n: F.lit(1) for n in ("phrase", "n", "words", "slice", "counts", "k", "chunk")})
    assert mined(df, 20) == brute_collocations([("a b " * 30, "en")], 20, 5, 50)
    assert mined(df.where("false"), 1) == [] and mined(df, 100) == []


def test_slices_hold_every_bucket():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    buckets = 4 * collocations.SLICE
    whole = np.concatenate([at + part * collocations.SLICE for part, at in collocations._slices(hashes, buckets)])
    assert sorted(whole.tolist()) == sorted((hashes % np.uint64(buckets)).tolist())
    marked = collocations.Bitmap(buckets)
    flags = np.zeros(buckets, bool)
    flags[whole] = True
    marked.fill([(i, np.packbits(flags[i * collocations.SLICE : (i + 1) * collocations.SLICE]).tobytes()) for i in range(4)])
    others = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    assert marked.has(hashes).all() and (marked.has(others) == flags[(others % np.uint64(buckets)).astype(int)]).all()


def test_chunks_without_words_or_vectors(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "x"), (None, " \n ", None)], DOCS)
    assert removed(docs) == sorted([(1, 0, 0, ""), (2, 0, 0, ""), (None, 0, 0, "")], key=str)
    assert mined(docs, 1) == []
    vectors = spark.createDataFrame([(1, None), (2, []), (3, [float("nan")] * 2), (4, [0.5, 0.5])], "vec_id long, embedding array<float>").repartition(4)
    got, _ = centroids.cluster_vectors(vectors, centroids.first_centroids(vectors, 3, 2, 64, "vec_id", "embedding"), 3, 64, dims=2)
    assert [tuple(r) for r in got.collect()] == [(4, 0, 0)]
