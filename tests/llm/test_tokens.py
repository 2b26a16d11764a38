import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from skein.llm import packing, tokenfiles
from skein.llm.tokens import byte_document_encoder, byte_encoder, resolve, word_document_encoder, word_encoder

from .test_operators import scratch_path

FIXED = ["", " ", "\n", "a\nb", 'x.\n"y', "don't\nit's", "a'\ns b", "x !\n? y", "'s\n's 's", "ab\x1cq", "x y", "a b", "½ ² x²", "İ' İ. İ", "é́ a", "中文 字\n字", "<|endoftext|> a"]


@pytest.mark.parametrize("name, encoder", [("byte_bpe_50k.json", byte_encoder), ("word_bpe_49k.json", word_encoder)])
def test_pieces_give_the_ids_of_the_whole_text(name, encoder):
    rng, parts = random.Random(0), [*"ab1 .,'\n!sé²", "'s", " the", "́", "中", "​", "ß", "İ", "ͅ", " ", "\t"]
    texts = FIXED + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    tok = Tokenizer.from_file(resolve(name))
    tok.encode_special_tokens = True
    one = encoder(name)
    width = np.dtype("<u2" if len(one.encode("a")) == 2 * len(tok.encode("a", add_special_tokens=False).ids) else "<u4")
    for text in texts:
        assert np.frombuffer(one.encode(text), width).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name, encoder", [("byte_bpe_50k.json", byte_document_encoder), ("word_bpe_49k.json", word_document_encoder)])
def test_added_tokens_in_a_text_have_their_own_ids(name, encoder):
    rng, parts = random.Random(1), [*"ab1 .,'\n!é<|>", "'s", " the", "\u0301", "<|endoftext|>", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "<|EndOfText|>"]
    texts = FIXED + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 15))) for _ in range(3000)]
    tok, one = Tokenizer.from_file(resolve(name)), encoder(name)
    for text in texts:
        assert np.frombuffer(one.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents_that_quote_a_marker(spark):
    texts = ["a b <|endoftext|> c", "<|startoftext|>x<|endoftext|>", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = lambda module, text, dtype: np.array([*Tokenizer.from_file(resolve(module.TOKENIZER)).encode(text, add_special_tokens=False).ids, module.END_ID], dtype)
    expected = [whole(packing, t, "<u4") for t in texts]
    got = sorted(packing.cut(docs).select("doc_id", "length", "ids_crc32").collect())
    assert [tuple(r) for r in got] == [(i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in enumerate(expected)]
    folder = scratch_path(spark, "t")
    got = sorted(map(tuple, tokenfiles.read_token_files(tokenfiles.write_token_files(docs, folder), folder).collect()))
    start = 0
    for i, (key, at, n, crc) in enumerate(got):
        ids = whole(tokenfiles, texts[i], "<u4")
        assert (key, at, n, crc) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += n
