import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")

from helmsway.llm import tokenizer as T  # noqa: E402

ODD = [
    "", None, " ", "\n", "  \n\n  a", "<|endoftext|> it's I'LL we've'd", "a\n\n\n b  c\t\td \n", "\x1c a\x1c\x1db", "a\x85b \x85\x85 c", "x​ y", "İstanbul ﬁ ½ ① ٣",
    "🏽‍🦰 \U0001FAE8 𞤀", "a\r\nb\r\n\r\n c", "　　x", "﻿abc  d", "x" * 50_000, "ab" * 30_000 + "\n" * 1000 + "c", "\x00\x01", "é" * 999,
]


@pytest.fixture(scope="module")
def peer():
    t = tokenizers.Tokenizer.from_file(T.BYTE_BPE_50K)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(*T.read_merges(T.BYTE_BPE_50K))


def ids(parts):
    return [np.frombuffer(p, "<i4").tolist() for p in parts]


def test_whole_table_equals_the_library(spark, peer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = T.encode(docs, "doc_id", "text").toPandas().sort_values("doc_id")
    text = docs.select("doc_id", "text").toPandas().sort_values("doc_id").text.tolist()
    assert [list(x) for x in got.ids] == peer(text)
    counts = T.token_counts(docs, ["doc_id", "source"], "text").toPandas().sort_values("doc_id")
    assert counts.n_tokens.tolist() == [len(x) for x in got.ids]


def test_odd_texts(encoder, peer):
    assert ids(encoder.encode(ODD)) == peer(ODD)
    assert ids(encoder.encode(ODD[::-1])) == peer(ODD[::-1])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n'stre1.!", max_size=80)), max_size=5))
def test_any_text(encoder, peer, texts):
    assert ids(encoder.encode(texts)) == peer(texts)


def test_full_caches_are_emptied(monkeypatch, peer):
    monkeypatch.setattr(T, "MOST_LINES", 3)
    e = T.Encoder(*T.read_merges(T.BYTE_BPE_50K))
    texts = [f"line {i}\nand {i * 7}\nmore" for i in range(30)]
    assert ids([b for i in range(0, 30, 5) for b in e.encode(texts[i : i + 5])]) == peer(texts)


def test_keys_copies_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b", 1), (7, None, 2), (7, None, 2), (8, "", 3)], "doc_id bigint, text string, ids int")
    got = sorted(T.encode(df, "doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0]))
    assert [(r[0], list(r[1])) for r in got] == [(None, [64, 275]), (7, []), (7, []), (8, [])]
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0
    assert T.token_counts(df.limit(0), ["doc_id"], "text").count() == 0


def test_slices_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(pd.DataFrame({"i": range(10), "t": ["x" * 100] * 9 + [None]}))
    got = [b.num_rows for b in T._slices(iter([batch]), 1, most_rows=4, most_bytes=250)]
    assert sum(got) == 10 and max(got) <= 4 and got[0] == 2
