import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from skein.llm import bpe


def whole(text):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.RANKS), special_tokens={})
    return np.array(enc.encode_ordinary(text or ""), "<u4").tobytes()


def texts():
    rng = random.Random(3)
    words = ["the", "née", "  ", "\n\n", "x\n", "don't", "12345", "—", "日本語", "\t", "....", " ", "\u3000", "end.", "<|endoftext|>", "a" * 90]
    out = ["".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    # overlaps without a boundary, one after another and apart
    out += ["a" * 3000, "word " * 100 + "b" * 1500 + " tail" * 300, " " * 2500, "=" * 700 + " x y z" * 200 + "9" * 900, "\n" * 900 + "end " * 200 + "c" * 300]
    return out


@pytest.mark.parametrize("chunk,overlap", [(200, 100), (300, 128), (513, 90)])
def test_chunks_give_the_ids_of_the_whole_text(spark, chunk, overlap):
    rows = [(i, t) for i, t in enumerate([*texts(), None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = bpe.decode_documents(bpe.encode_documents(df, chunk=chunk, overlap=overlap)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r["ids"]) == whole(r["text"]), repr(r["text"][:80])
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_empty_table_repeated_rows_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(empty).count() == 0
    long = "many words " * 3000
    df = spark.createDataFrame([(None, long, 1), (None, long, 1), (7, "x", 2)], "doc_id long, text string, ids int")
    got = bpe.encode_documents(df).collect()
    assert sorted(hashlib.sha256(bytes(r["ids"])).hexdigest() for r in got) == sorted(hashlib.sha256(whole(t)).hexdigest() for t in (long, long, "x"))
