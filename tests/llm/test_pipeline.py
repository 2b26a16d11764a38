import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import exact, packing, quality
from tests.llm.test_operators import brute_bfd, brute_components

SF = "/root/testdata/sf0.001"


def brute_scores(model, texts):
    """The vote of each text's nearest labelled vectors, one cosine after another."""
    vectors, labels = model.vectors.astype(np.float64), model.labels.tolist()
    out = []
    for text in texts:
        v = model._weighted(quality.term_counts(text)[None])[0].astype(np.float64) @ model.basis.astype(np.float64)
        v /= max(np.linalg.norm(v), 1e-9)
        near = sorted(((max(sum(a * b for a, b in zip(v.tolist(), u)), 0.0), y) for u, y in zip(vectors.tolist(), labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        total = sum(c**quality.POWER for c, _ in near)
        out.append(sum(c**quality.POWER * y for c, y in near) / total if total else model.prior)
    return out


def brute_exact(rows):
    """Of rows (id, text) with equal normalised texts the one with the least id, null ids last; as (id, text)."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((doc_id is None, doc_id or 0, text))
    return [min(g, key=lambda r: (r[0], r[1], r[2] or "")) for g in groups.values()]


def brute_pieces(rows):
    from tokenizers import Tokenizer

    from skein.llm.tokens import resolve

    tok, out = Tokenizer.from_file(resolve(packing.TOKENIZER)), []
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out += [(doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    return out


def key(row):
    return tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in row)


def check_packed(got, rows):
    expected = brute_pieces(rows)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(expected, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= brute_bfd([p[3] for p in expected], 2048)


def test_every_stage_equals_brute_force(spark):
    import corpus_pipeline

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    columns, (q, e, n, p) = docs.columns, [f for _, f in corpus_pipeline.STAGES]
    good = q(spark, docs, SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scores = brute_scores(quality.fit(docs, labels), [t or "" for _, t in rows])
    sure = [(d, s) for (d, _), s in zip(rows, scores, strict=True) if abs(s - 0.7) > 2e-3]  # float32 against double
    kept = {r["doc_id"] for r in good.collect()}
    assert {d for d, s in sure if s > 0.7} <= kept and not kept & {d for d, s in sure if s < 0.7}
    single = e(spark, good, SF)
    expected = brute_exact([(r["doc_id"], r["text"]) for r in good.collect()])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(d for _, d, _ in expected)
    apart = n(spark, single, SF)
    expected = brute_components([(r["doc_id"], r["text"]) for r in single.collect()], 5, 80)
    assert {r["doc_id"] for r in apart.collect()} == {d for d, _, c in expected if d == c}
    assert good.columns == single.columns == apart.columns == columns
    check_packed(p(spark, apart, SF).collect(), [(r["doc_id"], r["text"]) for r in apart.collect()])
    whole = corpus_pipeline.run(spark, SF)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, p(spark, apart, SF).select(names).collect())) == sorted(map(tuple, whole.select(names).collect()))


def test_defined_cases_of_the_pipeline(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns; and empty tables."""
    import corpus_pipeline

    copy = "one two three four five six seven eight nine ten"
    rows = [(1, copy), (1, copy), (2, copy + " "), (None, copy), (None, "alone without an id and nothing like it"), (3, None), (4, ""), (5, "word " * 20_000), (6, copy.upper()), (6, "a second text under the id six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "'s' AS source", "1L AS score", "2L AS keep_id", "3L AS piece")
    for name, table in (("cases", docs), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        # without labels every score is 0.5: the classifier does not drop all documents silently; what follows it is asked apart
        if name == "empty":
            assert corpus_pipeline.run(spark, folder).count() == 0
        else:
            with pytest.raises(ValueError, match="no document of the training fold has a label"):
                corpus_pipeline.run(spark, folder)
        single = corpus_pipeline.exact_dedup(spark, table, folder)
        apart = corpus_pipeline.near_dedup(spark, single, folder)
        packed = corpus_pipeline.best_fit_packing(spark, apart, folder).collect()
        assert single.columns == apart.columns == docs.columns
        if name == "empty":
            assert not packed
            continue
        # without white space runs, "one two ... ten" with and without a last space are different texts
        assert sorted(map(key, ((r["doc_id"], r["text"]) for r in single.collect()))) == sorted(map(key, [(1, copy), (2, copy + " "), (None, "alone without an id and nothing like it"), (3, None), (5, "word " * 20_000), (6, copy.upper()), (6, "a second text under the id six")]))
        left = [(r["doc_id"], r["text"]) for r in apart.collect()]
        assert sorted(map(key, left)) == sorted(map(key, [(1, copy), (None, "alone without an id and nothing like it"), (3, None), (5, "word " * 20_000), (6, "a second text under the id six")]))
        check_packed(packed, left)
    assert exact.drop_exact(docs.where(F.lit(False))).count() == 0


def test_quality_stage_with_labels_and_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns pass the classifier with values of their own."""
    import corpus_pipeline

    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").select("doc_id", "text").limit(40)
    text = good.first()["text"]
    odd = spark.createDataFrame([(10_001, text), (10_001, text), (None, text), (10_002, None), (10_003, ""), (10_004, (text + " ") * 60)], "doc_id long, text string")
    docs = good.unionByName(odd).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "concat('own ', doc_id) AS score", "'t' AS _t", "7L AS keep_id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert kept and kept[0].__fields__ == docs.columns
    assert all(r["score"] == (None if r["doc_id"] is None else f"own {r['doc_id']}") and r["_t"] == "t" and r["keep_id"] == 7 for r in kept)
    assert sum(r["doc_id"] == 10_001 for r in kept) == 2 and sum(r["doc_id"] is None for r in kept) == 1
    assert {r["doc_id"] for r in kept} >= {r["doc_id"] for r in good.collect()}
