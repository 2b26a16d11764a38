"""The numbered operators against brute force, and their defined cases."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import exact, html, neardup, neighbours, packing, quality, sharding, tokenfiles, warc
from skein.llm.common import scratch_path
from skein.llm.shingles import exact_shingles

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
CASES = [(1, "a b  c\td", "x"), (2, "a b c d", "x"), (3, None, None), (4, "", "y"), (5, " ", "y"), (6, "a b c d", "x"), (6, "a b c d", "x"), (None, "a b c d", "x"), (None, "lonely", "x"), (9, "word " * 30_000, "z"), (10, "é\x0bü", "z")]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(CASES, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def clashing(df, **names):
    return df.withColumns({n: F.lit(v) for n, v in names.items()})


# 1 sharding
def test_longest_first_is_the_greedy_schedule():
    rng = random.Random(1)
    sizes = {i: rng.randrange(1, 1000) for i in range(300)}
    loads = [0] * 7
    for i, s in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        j = min(range(7), key=lambda k: (loads[k], k))
        assert sharding.longest_first(sizes, 7)[i] == j
        loads[j] += s


@pytest.mark.parametrize("cell_groups", [50_000, 40])
def test_shards(docs, cases, none, cell_groups):
    for df in (docs, clashing(cases, shard=1, slot=2, _size=3)):
        rows = sharding.assign_shards(df, 5, cell_groups=cell_groups).collect()
        assert len(rows) == df.count()
        by_text, slots, loads = {}, {}, [0] * 5
        for r in rows:
            assert by_text.setdefault(r["text"] or "", r["shard"]) == r["shard"]
            assert r["_size"] == len((r["text"] or "").encode()) + 16 and r["_crc32"] == zlib.crc32((r["text"] or "").encode())
            slots.setdefault(r["shard"], []).append(r["slot"])
            loads[r["shard"]] += r["_size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(none, 5).count() == 0
    balanced = sharding.assign_shards(docs, 5, cell_groups=cell_groups).groupBy("shard").agg(F.sum("_size").alias("b")).toPandas()["b"]
    assert balanced.max() - balanced.min() <= 0.02 * balanced.sum()


@pytest.mark.parametrize("cells, bins", [(1, 400), (1, 30), (4, 30)])
def test_every_group_goes_largest_first_to_the_least_loaded_bin(spark, cells, bins):
    rng = random.Random(3)
    rows = [(bytearray(i.to_bytes(16, "big")), rng.choice([rng.randrange(20, 60), rng.randrange(20, 40_000)])) for i in range(300)]
    got = sharding.bins_of_groups(spark.createDataFrame(rows, "_group binary, bytes long").repartition(3), cells, bins).collect()
    assert sorted((bytes(r["_group"]), r["bytes"]) for r in got) == sorted((bytes(g), s) for g, s in rows)
    for cell in {r["_cell"] for r in got}:
        mine = {bytes(r["_group"]): (r["bytes"], r["_bin"]) for r in got if r["_cell"] == cell}
        assert {g: b for g, (_, b) in mine.items()} == sharding.longest_first({g: s for g, (s, _) in mine.items()}, bins)


# 2 packing
def brute_bfd(lengths, capacity):
    rooms = []
    for size in sorted(lengths, reverse=True):
        best = min((r for r in range(len(rooms)) if rooms[r] >= size), key=lambda r: rooms[r], default=None)
        if best is None:
            rooms.append(capacity - size)
        else:
            rooms[best] -= size
    return len(rooms)


def fewest(lengths, capacity):
    """The optimum, by trying all placements (few items)."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i]:
                rooms[j] -= lengths[i]
                place(i + 1, rooms)
                rooms[j] += lengths[i]
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_best_fit_and_its_bound():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 64, 100])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        bins, offsets, n = packing.best_fit_decreasing(np.array(lengths), capacity)
        assert n == brute_bfd(lengths, capacity)
        assert packing.lower_bound(np.array(lengths), capacity) <= fewest(lengths, capacity) <= n
        for b in range(n):
            at = 0
            for o, size in sorted((o, s) for o, s, x in zip(offsets, lengths, bins, strict=True) if x == b):
                assert o == at
                at += size
            assert at <= capacity


def test_packed_documents(spark, docs, cases, none):
    from tokenizers import Tokenizer

    from skein.llm.tokens import resolve

    tok = Tokenizer.from_file(resolve(packing.TOKENIZER))
    for df in (docs.limit(60), clashing(cases, piece=1, offset="x")):
        rows = packing.pack_documents(df).collect()
        expected = []
        for r in df.select("doc_id", "text").collect():
            ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            expected += [(r["doc_id"], k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        key = lambda x: tuple((v is None, v or 0) for v in x)
        assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(expected, key=key)
        sequences = {}
        for r in rows:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
    assert packing.pack_documents(none).count() == 0


def test_exchange_between_partitions(spark):
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.randrange(1, 2048), 0, i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, packing._PIECES_SQL)
    got = packing.pack_pieces(pieces, part_items=1000).toPandas()
    assert sorted(got["uid"]) == list(range(3000))
    sums = got.groupby("sequence_id")["length"].sum()
    least, whole = packing.lower_bound(np.array([r[3] for r in rows]), 2048), brute_bfd([r[3] for r in rows], 2048)
    assert sums.max() <= 2048 and least <= len(sums) <= 1.02 * least
    # exchanges end where the bound is met, where one partition holds all, or where a round gains nothing
    sums = packing.pack_pieces(pieces, part_items=100, most_items=3000).toPandas().groupby("sequence_id")["length"].sum()
    assert sums.max() <= 2048 and len(sums) <= 1.02 * whole


# 3 neighbours
def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((700, 24)).astype(np.float32)
    data[100:180] = data[100]  # ties
    data[200] *= 1000
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] + [1.0] * 23), (1060, [None] + [1.0] * 23), (1080, [1.0] * 3), (1100, [float("inf")] + [1.0] * 23), (None, [1.0] * 24), (1120, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=20).toPandas()
    assert sorted(got["query_id"].unique()) == list(range(0, 700, 20))
    exact_data = data.astype(np.float64)
    for q, part in got.groupby("query_id"):
        score = neighbours.exact_products(np.repeat(exact_data[[q]], 700, 0), exact_data)
        best = sorted((-s, i) for i, s in enumerate(score.tolist()) if i != q)[:20]
        part = part.sort_values("rank")
        assert part["vec_id"].tolist() == [i for _, i in best] and part["score"].tolist() == [-s for s, _ in best] and part["rank"].tolist() == list(range(1, 21))
    twice = df.where("vec_id in (0, 20)").unionByName(df.where("vec_id = 0")).unionByName(df.where("vec_id = 200").withColumn("vec_id", F.lit(20).cast("long")))
    again = neighbours.nearest(clashing(df, name=1, s="x", v=2), clashing(twice, id=3), k=20).toPandas()
    one = got[got["query_id"] == 0].sort_values("rank")["vec_id"].tolist()
    assert again[again["query_id"] == 0].sort_values("rank")["vec_id"].tolist() == one and (again["query_id"] == 20).sum() == 40
    few = df.where("vec_id < 5")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 4
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e-200, 1e-12, 1e12, 1e150])
def test_neighbours_of_any_size(spark, size):
    rng = np.random.default_rng(5)
    data = rng.standard_normal((300, 6)) * size * 10.0 ** rng.integers(-3, 3, (300, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), k=7).toPandas()
    for q, part in got.groupby("query_id"):
        score = neighbours.exact_products(np.repeat(data[[q]], 300, 0), data)
        best = sorted((-s, i) for i, s in enumerate(score.tolist()) if i != q)[:7]
        assert part.sort_values("rank")["vec_id"].tolist() == [i for _, i in best]


# 4 quality
def test_quality_held_out_accuracy_and_cases(spark, cases, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    scored = quality.query(spark, sf).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    held = scored[scored["held_out"]]
    assert ((held["score"] >= 0.7) == (held["quality"] == 1)).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(scored["doc_id"], scored["held_out"], strict=True))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality.fit(docs, flipped)
    assert np.array_equal(model.vectors, other.vectors) and np.array_equal(model.labels, other.labels)
    got = quality.score(clashing(cases, score="s", _t=1), model).collect()
    assert len(got) == len(CASES) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if not r["text"]} == {model.prior}
    assert quality.score(none, model).count() == 0
    assert {r["score"] for r in quality.score(cases, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_votes_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    texts = [r["text"] or "" for r in docs.limit(50).collect()] + ["", "one", "Ж 中 ! 1", "again again again"]
    got = model.score(np.stack([quality.term_counts(t) for t in texts]))
    for text, score in zip(texts, got, strict=True):
        v = model._weighted(quality.term_counts(text)[None])[0].astype(np.float64) @ model.basis.astype(np.float64)
        v /= max(np.linalg.norm(v), 1e-9)
        near = sorted(((max(float(v @ u), 0.0), float(y)) for u, y in zip(model.vectors.astype(np.float64), model.labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        total = sum(c**quality.POWER for c, _ in near)
        assert abs(score - (sum(c**quality.POWER * y for c, y in near) / total if total else model.prior)) < 2e-3


def test_terms_by_definition():
    text = "Ab ab 1,\nÉ é é " * 3
    counts = quality.term_counts(text)
    words, trigrams, fives, repeated = np.split(counts, quality._ENDS[1:-1])
    data, found = text.encode(), text.encode().lower().split()
    assert words.sum() == len(found) and trigrams.sum() == len(data) - 2 and fives.sum() == len(data) - 4
    for kind, n in ((trigrams, 3), (fives, 5)):
        assert len({data[i : i + n] for i in range(len(data) - n + 1)}) >= np.count_nonzero(kind) > 5
    for i, n in enumerate((2, 3, 5)):
        grams = [tuple(found[j : j + n]) for j in range(len(found) - n + 1)]
        share = 1 - len(set(grams)) / len(grams)
        assert abs(sum(k / 8 * v for k, v in enumerate(repeated[9 * i : 9 * i + 9])) - share) < 1e-6
    assert not np.any(quality.term_counts("")) and quality.term_counts("one")[quality._ENDS[-2] :].sum() == 0


def test_latent_space_is_that_of_the_svd(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    ids = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["quality"] is not None}
    texts = [r["text"] or "" for r in docs.where(F.col("doc_id").isin(*ids)).orderBy("doc_id").collect()]
    x = model._weighted(np.stack([quality.term_counts(t) for t in texts])).astype(np.float64)
    values = np.linalg.svd(x, compute_uv=False)
    least = float((values[quality.DIMS :] ** 2).sum())
    basis = model.basis.astype(np.float64)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)
    left = float(((x - x @ basis @ basis.T) ** 2).sum())
    assert least - 1e-6 <= left <= 1.02 * least + 1e-6


def test_fit_is_the_same_whatever_the_order_of_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    twice = docs.unionByName(docs.select("doc_id", F.concat(F.lit("~ another "), "text").alias("text")))
    a, b = (quality.fit(df, labels) for df in (twice.repartition(7), twice.orderBy(F.desc("text"))))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels)


def test_without_labels_nothing_is_dropped_silently(spark, cases, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    with pytest.raises(ValueError, match="no document of the training fold has a label"):
        quality.keep_good(cases, labels)
    assert quality.keep_good(none, labels).count() == 0


def test_columns_named_like_internal_ones_keep_their_values(spark):
    """Every operator that carries columns, with names that it, or another one, uses inside."""
    names = "_t _h _s _id _y _n _sub _rank _offset _near_row _row _own _null _order c c0 i t row score a.b x`y keep chunk".split()
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "something else altogether here"), (None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    df = plain.select("*", *(F.concat(F.lit(f"{n} of "), F.coalesce("text", F.lit("nothing"))).alias(n) for n in names))
    quoted = [F.col("`" + n.replace("`", "``") + "`") for n in names]
    want = lambda text: tuple(f"{n} of {'nothing' if text is None else text}" for n in names)
    labels = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    found = {
        "op1": sharding.assign_shards(df, 2), "op8": exact.mark_exact(df), "drop_exact": exact.drop_exact(df), "drop_near": neardup.drop_near(df), "keep_good": quality.keep_good(df, labels, 0.0),
        "score": quality.score(df.drop("score").withColumn("score", F.lit("old")), quality.fit(df, labels)),
    }
    for name, out in found.items():
        kept = out.select("text", *(q for q, n in zip(quoted, names) if not (name == "score" and n == "score"))).collect()
        assert len(kept) in (3, 4), name
        for r in kept:
            assert tuple(r)[1:] == tuple(v for v, n in zip(want(r["text"]), names) if not (name == "score" and n == "score")), name


# 5 WARC
def test_warc_round_trip_and_cases(spark):
    big = "<p>" + "é" * 2000
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "n", big), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 200)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), payload=1)
    whole, apart = scratch_path(spark, "w"), scratch_path(spark, "w")
    for size in (1, 1 << 20):
        written = warc.write_archives(warc.mark_revisits(pages), whole, size)
        got = warc.read_archives(warc.normalise(written, whole, apart), apart).collect()
        key = lambda x: str(x)
        expected = [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h in rows]
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(expected, key=key)
        assert all(bytes(r["payload"]) == next((h or "").encode() for i, _, h in rows if i == r["page_id"]) for r in got if r["record_type"] == "response")
    assert warc.read_archives(warc.normalise(warc.write_archives(warc.mark_revisits(pages.limit(0)), whole), whole, apart), apart).count() == 0


def test_normaliser_reads_any_gzip_framing():
    import gzip
    import io

    records = [warc.record(i, "u", b"x" * n, None) for i, n in enumerate([0, 10, 300_000])]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(records[0] + records[1]) + gzip.compress(records[2])):
        out = [(h["warc-record-id"], sum(map(len, parts))) for h, parts in warc.split_records(warc.inflate(io.BytesIO(data)))]
        assert [n for _, n in out] == list(map(len, records))
    with pytest.raises(ValueError):
        list(map(lambda x: list(x[1]), warc.split_records(iter([records[2][:1000]]))))


# 7 token files
def test_perfect_hash():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 1000, 40_000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        h = tokenfiles.PerfectHash.build(keys)
        assert sorted(h(keys).tolist()) == list(range(len(keys)))


def test_token_files(spark, docs, cases, none):
    from tokenizers import Tokenizer

    from skein.llm.tokens import resolve

    tok = Tokenizer.from_file(resolve(tokenfiles.TOKENIZER))
    for df in (docs.limit(80), clashing(cases, i=1, t="x")):
        folder = scratch_path(spark, "t")
        manifest = tokenfiles.write_token_files(df, folder, shard_bytes=20_000)
        got = sorted(map(tuple, tokenfiles.read_token_files(manifest, folder).collect()), key=lambda r: r[1])
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert [r[0] for r in got] == [r[0] for r in rows]
        start = 0
        for (key, at, n, crc), (_, text) in zip(got, rows, strict=True):
            ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4")
            assert (at, n) == (start, len(ids)) and (crc == zlib.crc32(ids.tobytes()) or key in (None, 6))
            start += n
        for r in manifest.collect():
            shard = tokenfiles.Shard(folder, r["name"])
            assert (shard.find(np.arange(10_000_000, 10_000_500)) == -1).all()
            keys, offsets = shard.table("keys"), shard.table("offsets").tolist()
            assert (r["first_key"], r["last_key"]) == ((keys[shard.n_null], keys[-1]) if shard.n_null < len(keys) else (None, None))
            for i, key in enumerate(keys[shard.n_null :].tolist(), shard.n_null):
                assert shard.ids(*offsets[i : i + 2]).tolist() in [x.tolist() for x in shard.get(key)] and shard.find(np.array([key]))[0] <= i
            assert shard.get(10_000_001) == []
        # random lookups over all shards, absent and repeated keys among them
        asked = [1, 3, 6, 6, 10_000_001, -5, 10, None]
        expected = sorted((r["doc_id"], [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in df.collect() if r["doc_id"] in asked and r["doc_id"] is not None)
        found = tokenfiles.lookup(manifest, folder, spark.createDataFrame([(a, "s") for a in asked], "doc_id long, shard string"))
        assert sorted((r["key"], r["ids"]) for r in found.collect()) == expected
    folder = scratch_path(spark, "t")
    empty = tokenfiles.write_token_files(none, folder)
    assert tokenfiles.read_token_files(empty, folder).count() == 0
    assert tokenfiles.lookup(empty, folder, cases).count() == 0


# 8 exact
def test_exact(cases, none):
    import re

    got = exact.mark_exact(clashing(cases, keep_id=0, kept="x")).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert len(got) == len(CASES)
    for r in got:
        same = [i for i, t, _ in CASES if norm(t) == norm(r["text"])]
        keep = min((i for i in same if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(same), keep is not None and r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256(norm(r["text"]).encode()).hexdigest()
    assert exact.mark_exact(none).count() == 0
    plan = exact.mark_exact(cases)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    assert exact.drop_exact(cases).columns == cases.columns


def test_equal_hashes_with_other_bytes_stay_apart(cases, monkeypatch):
    monkeypatch.setattr(F, "md5", lambda c: F.lit("00" * 16))  # every text collides
    got = {(r["doc_id"], r["text"]): r["keep_id"] for r in exact.mark_exact(cases).collect()}
    assert got[(1, "a b  c\td")] == 1 and got[(4, "")] == 3 and got[(10, "é\x0bü")] == 10


# 9 HTML
@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<script>x</script><style>y</style>", ""),
        ("<body><nav><a>m</a></nav><article><h1>T &amp; t</h1><p>one <b>two</b><br>three</p></article><footer>f</footer>", "T & t\n\none two three"),
        ("<div class='sidebar'>s</div><div id=main><p>" + "long text " * 20 + "</p><p>end</p></div><div class='ad'>x</div><form>q<input></form>", "long text " * 19 + "long text\n\nend"),
        ("<main><p>kept</p><div class='comments'><p>said</p></div><aside>side</aside></main>", "kept"),
        ("<div class='with-sidebar'><nav>m</nav><article><p>kept</p></article></div>", "kept"),
        ("<article></article><div class='ad'>x</div>", ""),
        ("<article><p>a &lt;b&gt; &#233;&nbsp;x</p><ul><li>i<li>j</ul></article>", "a <b> é x\n\ni\n\nj"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


LONG = "A sentence of the article that tells what it is about. " * 2


@pytest.mark.parametrize(
    "page,text",
    [
        ("<div><p class='ad'>Buy<p>One</p><p>Two</p></div>", "One\n\nTwo"),
        ("<ul><li class='ad'>Buy<li>One<li>Two</ul>", "One\n\nTwo"),
        ("<div><nav><a>m</a></div><p>One", "One"),
        ("<div><form>q</div><p>One", "One"),
        ("<head><title>t</title><p>One", "One"),
        ("<table><tr><td class='ad'>x<td>One</table>", "One"),
        ("<b><nav>m</b>n</nav>One", "One"),
        ("<div class='content has-sidebar'><div class='post'><p>One</p></div><div class='sidebar'>s</div></div>", "One"),
        (f"<div class='widget'><div class='post'><p>{LONG}<p>{LONG}</div><div class='sidebar'>s</div></div><div class='ad'>x</div>", LONG.strip() + "\n\n" + LONG.strip()),
        (f"<form id='page'><nav>m</nav><div><p>{LONG}</p></div></form>", LONG.strip()),
        (f"<div class='related'><article>Teaser</article></div><div class='post'><p>{LONG}</p></div>", LONG.strip()),
        (f"<article>{LONG}</article><div class='widget'>{LONG * 2}</div>", LONG.strip()),
        (f"<p>kept</p><div class='comments'><p>{LONG}</p></div>", "kept"),
    ],
)
def test_elements_left_out_swallow_no_article(page, text):
    assert html.main_text(page) == text


PARA, MENU = f"<p>{LONG}</p>", "<ul>" + "<li><a href='x'>Somewhere else</a></li>" * 12 + "</ul>"


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<div class='entry'><h2>Head</h2><section>{PARA * 5}</section><section>{PARA * 4}<p>{LONG}<a href='x'>ref</a></p></section></div>", ["Head", *[LONG] * 9, LONG + "ref"]),
        (f"{MENU}<div><h2>Head</h2><section>{PARA * 5}</section>Bare<p>Short</p><b>bold</b><section>{PARA * 5}</section></div><div>{MENU}</div>", ["Head", *[LONG] * 5, "Bare", "Short", "bold", *[LONG] * 5]),
        (f"{MENU}<div>{LONG}<br>{LONG}<div>{PARA * 3}</div></div>{MENU}", [LONG + LONG, *[LONG] * 3]),
        (f"{MENU}<div><h1>Title</h1><p>By one</p><div>{PARA * 5}</div><p>End</p></div>{MENU}", ["Title", "By one", *[LONG] * 5, "End"]),
        (f"{MENU}<div><section>{PARA * 5}</section><section>{PARA * 5}</section></div><div>{PARA * 5}</div>{MENU}", [LONG] * 15),
    ],
)
def test_article_in_sections(page, text):
    assert html.main_text(page) == "\n\n".join(t.strip() for t in text)


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar content", "content widget-free", "post ad-free", "post reply-enabled", "entry share-enabled", "search-page", "post comments-closed"])
@pytest.mark.parametrize("key", ["class", "id"])
def test_a_role_word_never_empties_a_page(name, key):
    page = f"<nav><a href='x'>m</a></nav><div {key}='{name}'><h1>Title</h1>{PARA * 5}</div><footer>Copyright</footer>"
    assert html.main_text(page) == "\n\n".join(["Title", *[LONG.strip()] * 5])


def brute_densities(node, share):
    """(chars, tags, link chars, link tags, density, density sum) by the definition, element by element."""
    import math

    chars, tags, lc, lt, total = sum(len(p.strip()) for p in node.parts if isinstance(p, str)), 0, 0, 0, 0.0
    for p in node.parts:
        if not isinstance(p, str) and not p.out:
            c, t, a, b, d, _ = brute_densities(p, share)
            chars, tags, lc, lt, total = chars + c, tags + t + 1, lc + a, lt + b, total + d
    if node.tag == "a":
        lc, lt = chars, lt + 1
    density = chars / max(tags, 1)
    if chars and share:
        base = math.log(chars / max(chars - lc, 1) * lc + share * chars + math.e)
        density *= max(math.log(chars / max(lc, 1) * max(tags, 1) / max(lt, 1)) / max(math.log(base), 0.05), 0)
    return chars, tags, lc, lt, density, total


def test_density_sums_equal_brute_force_and_choose_the_text(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40).collect() if r["html"]]
    # without the names that a page may give its article, the densities find the same text
    bare = lambda p: re.sub(r"(</?)(?:article|main)\b", r"\1div", re.sub(r" role=.main.", "", p))
    for page in [*pages, *map(bare, pages)]:
        tree = html._parsed(page)
        html._open_wrappers(tree.root)
        order = html._measure(tree.root)
        share = tree.root.link_chars / max(tree.root.chars, 1)
        for node in order:
            chars, tags, lc, lt, density, total = brute_densities(node, share)
            assert (node.chars, node.tags, node.link_chars, node.link_tags) == (chars, tags, lc, lt)
            assert abs(node.density - density) < 1e-9 * max(density, 1) and abs(node.total - total) < 1e-9 * max(total, 1)
    assert sum(html.main_text(p) == html.main_text(bare(p)) for p in pages) >= 0.95 * len(pages)


def test_deep_and_broken_pages_end():
    assert html.main_text("<div>" * 50_000 + "deep") == "deep"
    assert html.main_text("</p></b>" * 50_000 + "<p>x") == "x"
    assert html.main_text("<" * 20_000 + "p>x") is not None


def test_extract(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), text="x")
    assert sorted((r["text"], r["n_chars"]) for r in html.extract(df).collect()) == [("", 0), ("a", 1), ("a", 1)]
    assert html.extract(df.limit(0)).count() == 0


# 10 near copies
def brute_components(rows, k, percent):
    sets = [exact_shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (100 * c >= percent * (len(sets[i]) + len(sets[j]) - c)):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def family(rng, words, base, n, edits):
    """Copies with up to ``edits`` words changed, many near the threshold, and chains between them."""
    out = [base]
    for _ in range(n):
        text = list(rng.choice(out[-5:]))
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(text)
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_components_equal_brute_force(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(3000)]
    texts = [rng.choices(words, k=rng.randrange(1, 200)) for _ in range(60)]
    for size in (40, 120, 300):
        texts += family(rng, words, rng.choices(words, k=size), 40, 5)
    passage = rng.choices(words, k=60)
    texts += [[*rng.choices(words, k=rng.randrange(5, 60)), *passage] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "ONE  two"), (1005, rows[70][1].upper()), (None, rows[70][1]), (None, "only here without an id")]
    rng.shuffle(rows)
    got = neardup.near_components(clashing(spark.createDataFrame(rows, "doc_id long, text string"), n=1, digest="x"), k).collect()
    key = lambda x: str(x)
    expected = [(d, n, c if n else d) for d, n, c in brute_components(rows, k, 80)]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_equal_digests_with_other_sets_stay_apart(spark, monkeypatch):
    class Colliding:  # a digest that tells sets apart by their size only
        xxh3_64_intdigest = staticmethod(neardup.xxhash.xxh3_64_intdigest)

        @staticmethod
        def xxh3_128_digest(data):
            return len(data).to_bytes(16, "big")

    monkeypatch.setattr(neardup, "CLASS_LOT", 2)
    monkeypatch.setattr(neardup, "xxhash", Colliding)
    rows = [(i, f"{i % 3} one two three four five six") for i in range(30)] + [(30, "0 one two three four five SIX")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_components(df, 7, 80).collect()}
    assert got == {i: i % 3 for i in range(30)} | {30: 0}


def test_a_bucket_of_many_members_is_a_grid(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    base = rng.choices(words, k=120)
    texts = family(rng, words, base, 60, 9)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    monkeypatch.setattr(neardup, "CELL", 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, neardup.near_components(df, 4, 80).collect()))
    assert got == sorted(brute_components(rows, 4, 80))


def test_near_and_exact_filters_decide_for_rows(spark):
    """Rows without id or with a shared one are neither lost nor kept for another's sake."""
    copy = "one two three four five six seven eight nine ten"
    rows = [(None, "alone without an id", 1), (None, copy, 2), (7, copy, 3), (7, copy, 4), (7, "another text of the id seven", 5), (3, copy.upper(), 6), (8, None, 7), (9, "", 8), (None, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp int").repartition(2)
    kept = lambda got: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    near = neardup.drop_near(df)
    assert near.columns == df.columns
    assert kept(near) == sorted([(True, 0, "alone without an id"), (False, 7, "another text of the id seven"), (False, 3, copy.upper()), (False, 8, ""), (False, 9, ""), (True, 0, "")])
    single = exact.drop_exact(df)
    assert single.schema == df.schema
    assert kept(single) == sorted([(True, 0, "alone without an id"), (False, 7, copy), (False, 7, "another text of the id seven"), (False, 3, copy.upper()), (False, 8, "")])
    assert next(r["text"] for r in single.collect() if r["doc_id"] == 8) is None
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_near_cases(spark, none, docs):
    assert neardup.near_components(none).count() == 0
    kept = neardup.drop_near(docs)
    assert kept.columns == docs.columns
    expected = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c in expected if d == c)


def test_bayesian_bound_keeps_what_may_be_true():
    for n in (28, 140):
        m = neardup.least_matches(n, 0.8, neardup.MISS)
        assert neardup._tail(m, n, 0.8) >= neardup.MISS > neardup._tail(m - 1, n, 0.8)


def test_merge_by_heap_is_sorted():
    assert list(heapq.merge([(-3, 1), (-1, 2)], [(-2, 5)])) == [(-3, 1), (-2, 5), (-1, 2)]


# 9 again: what density chooses, and what words may not do
def nameless(page: str) -> str:
    """The page with containers' names, and all classes, ids and roles, taken away."""
    plain = re.sub(r"(</?)(?:article|main|nav|footer|header|aside|section)\b", r"\1div", page)
    return re.sub(r' (?:class|id|role)="[^"]*"', "", plain)


def article_of(page: str) -> str:
    todo = [html._parsed(page).root]
    while todo:
        node = todo.pop()
        if node.tag == "article":
            return html._text([node])
        todo += [p for p in node.parts if not isinstance(p, str)]
    return ""


def test_density_alone_finds_the_article_of_every_page(spark):
    """No menu, footer or advert line, and all blocks of the article, on pages that name nothing, bare and in wrappers."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]]
    assert len(pages) == 250
    for page in pages:
        want = article_of(page)
        assert html.main_text(page) == want
        assert html.main_text(nameless(page)) == want
        assert html.main_text(re.sub(r"(</?)(?:nav|footer|header|form)\b", r"\1div", page)) == want
    wrapped = [nameless(p).replace("<body>", "<body><div><div>").replace("</body>", "</div></div></body>") for p in pages]
    assert sum(html.main_text(w) == article_of(p) for w, p in zip(wrapped, pages)) >= 0.99 * len(pages)


def brute_choice(root):
    """The element of the largest density sum, by the definition, over every element of the tree."""
    share = root.link_chars / max(root.chars, 1)
    page = html._page(root)
    found = []

    def walk(node, doubt):
        doubt = doubt or node.doubt
        *_, density, total = brute_densities(node, share)
        if node in page:
            own = [p for p in node.parts if isinstance(p, str) or not p.out and p.tag not in html._CONTAINERS] if node is page[-1] else []
            total, density = sum(len(p.strip()) / 4 if isinstance(p, str) else brute_densities(p, share)[4] for p in own), 0
        found.append(((total or density / 4) * (0.25 if doubt else 1), node))
        for p in node.parts:
            if not isinstance(p, str) and not p.out:
                walk(p, doubt)

    walk(root, False)
    most = max(w for w, _ in found)
    return [n for w, n in found if abs(w - most) <= 1e-9 * max(most, 1)]


def test_the_choice_equals_brute_force(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r["html"]]
    pages += [f"<div><div class='related'>{PARA * 9}</div><div>{PARA * 4}</div></div>", f"{MENU}<p>{LONG}<p>{LONG}", f"<div><section>{PARA}</section>{PARA * 3}</div>{MENU}"]
    for page in [*pages, *map(nameless, pages)]:
        tree = html._parsed(page)
        html._open_wrappers(tree.root)
        order = html._measure(tree.root)
        best = html._densest(order, html._page(tree.root))
        assert any(best is n or n.tag not in html._BLOCKS for n in brute_choice(tree.root))


@pytest.mark.parametrize("tag, key, name", [(t, k, n) for t, names in {"section": ("discussion", "related-work", "social-history", "notice-of-motion", "search", "share", "recommendations"), "h2": ("search", "navigation", "share", "discussion"), "li": ("share", "menu", "related"), "p": ("notice", "alert"), "div": ("related-work", "social-history", "notice-of-motion", "discussion")}.items() for n in names for k in ("id", "class")])
def test_words_drop_no_text_of_the_article(tag, key, name):
    inner = {"h2": "Heading", "li": "An item", "p": "A word on it."}.get(tag, PARA * 2)
    element = f"<{tag} {key}='{name}'>{inner}</{tag}>"
    element = f"<ul><li>First</li>{element}</ul>" if tag == "li" else element
    page = f"<nav><a href='x'>m</a></nav><article><h1>Title</h1>{PARA * 2}{element}{PARA * 2}</article><footer>(c) a line at the end of the page</footer>"
    text = html.main_text(page)
    assert text == article_of(page.replace(f" {key}='{name}'", "")) and "Title" in text and "(c)" not in text


@pytest.mark.parametrize("name", ["related", "share", "navigation", "recommended", "social"])
def test_words_leave_out_what_is_thin_or_links(name):
    links = "".join(f"<a href='x'>Another story {i}</a>" for i in range(5))
    page = f"<article><h1>Title</h1>{PARA * 3}<div class='{name}'>{links}</div>{PARA * 3}<div class='{name}'>Tell your friends</div></article>"
    assert html.main_text(page) == "\n\n".join(["Title", *[LONG.strip()] * 6])


def test_a_block_beside_the_article_must_be_as_dense():
    beside = lambda x: html.main_text(f"{MENU}<div>{PARA * 5}</div><div>{x}</div>{MENU}")
    assert beside(PARA * 5) == "\n\n".join([LONG.strip()] * 10)
    assert beside("A line of the footer, with a name and an address in it, and the year") == "\n\n".join([LONG.strip()] * 5)


def test_extract_carries_columns_of_any_name(spark):
    names = ["_h", "h", "c", "c0", "text", "n_chars", "url", "a b", "x.y"]
    df = spark.createDataFrame([("<p>a",)], "html string").withColumns({n: F.lit(f"own {n}") for n in names})
    row = html.extract(df).first().asDict()
    assert row == {n: f"own {n}" for n in names} | {"text": "a", "n_chars": 1}


# 3 again: the grid
@pytest.mark.parametrize("queries, files", [(0, 0), (1, 1), (3, 2), (5, 8), (40, 9), (1000, 100_000)])
def test_the_grid_follows_the_files(queries, files):
    rows, columns = neighbours.grid_of(queries, files)
    assert rows >= 1 and columns >= 1 and -(-queries // rows) <= neighbours.QUERY_FILES and -(-files // columns) <= neighbours.CANDIDATE_FILES
    assert rows <= max(neighbours.LEAST_CELLS[0], -(-queries // neighbours.QUERY_FILES)) and rows <= max(1, queries) and columns <= max(1, files)


def test_neighbours_over_files_of_several_blocks(spark, monkeypatch):
    """More files and blocks than cells hold: every pair is met once, whatever the grid, and a candidate file is read once a row of it."""
    rng = np.random.default_rng(11)
    data = np.round(rng.standard_normal((900, 6)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 9 = 0")
    whole = sorted(map(tuple, neighbours.nearest(df, asked, k=5).collect()))
    monkeypatch.setattr(neighbours, "QUERY_FILES", 3)
    monkeypatch.setattr(neighbours, "CANDIDATE_FILES", 4)
    small = neighbours.nearest(df, asked, k=5, block=16, blocks_a_file=3, a_query_file=7)
    assert sorted(map(tuple, small.collect())) == whole
    scores = data[::9] @ data.T
    for q in range(100):
        scores[q, 9 * q] = -np.inf
        want = sorted(range(900), key=lambda j, q=q: (-round(scores[q, j], 9), j))[:5]
        assert [r[2] for r in whole if r[0] == 9 * q] == want
