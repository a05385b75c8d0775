import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

bpe = pytest.importorskip("threadloom.llm.bpe")
pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.DEFAULT_TOKENIZERS), reason="no tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.DEFAULT_TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def own(texts):
    ids, n = bpe.Encoder.load(bpe.DEFAULT_TOKENIZERS).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_known_cases(library):
    texts = ["", "a" * 300_000, " " * 5000, "'" * 999, "I'll we've 'stop n't 's", "<|endoftext|> x", "a\r\n\n  b\t c \n", "漢字 é 😀", "\x00\x1c\x85", "12345 ½٣", "don't  'S", "aa" * 777]
    assert own(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.text(alphabet=st.sampled_from(" \n\tsStTlLvVrReEmMdD'’.-a1é漢😀 ​"), max_size=25), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_like_the_library(library, texts):
    assert own(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_table(spark):
    df = spark.createDataFrame([(1, "hello world", 9), (2, None, 9), (3, "", 9), (1, "hello world", 9), (None, "x", 9)], "doc_id bigint, text string, ids int")
    got = sorted(((r[0] or 0, r[1]) for r in bpe.encode_table(df).collect()), key=repr)
    assert got == [(0, [87]), (1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert sorted(r["n_tokens"] for r in bpe.count_table(df).collect()) == [0, 0, 1, 2, 2]
    assert bpe.encode_table(df.where("false")).count() == 0
