import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from seekspark.llm import bpe_replay as B
from seekspark.llm import queries, tokens
from tests.conftest import SF001
from tests.llm import cases

PATH = tokens.vocabulary(B.VOCABULARY)
ODD = st.text(alphabet=st.sampled_from(list("aAàéßİ 's\n\t\r\xa0 \x1cre!?.1٣²日本é̇\U0001F600<|endoftext|>​\x00զ՘\U00011de0thelv")), max_size=30)
TEXT = st.one_of(ODD, st.text(max_size=30), st.text(alphabet="ab ", max_size=40)).map(lambda t: t.encode("utf8", "ignore").decode())


def library(path):
    return tiktoken.Encoding("own", pat_str=B.split_pattern(), mergeable_ranks=B.merges(path).ranks, special_tokens={})


@pytest.mark.parametrize("name", [B.VOCABULARY, "byte_bpe_multi_50k.tiktoken"])
def test_same_ids_as_the_library(name):
    path = tokens.vocabulary(name)
    own = library(path)

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.lists(TEXT, max_size=5))
    def run(texts):
        assert [i.tolist() for i in B.encode_block(texts, path, B.split_pattern())] == [own.encode_ordinary(t) for t in texts]
    run()
    for t in (cases.LONG, "a" * 3001, " " * 777 + "x", "\n" * 50, "ab" * 999 + "aba"):
        assert next(B.encode_block([t], path, B.split_pattern())).tolist() == own.encode_ordinary(t)


def test_every_character_has_the_class_of_the_library():
    """Three neighbours tell letters, digits and others apart; a text of one match is one token here."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    ranks = {bytes([b]): b for b in range(256)}
    texts = [w + c + w for c in chars for w in "a1!"]
    for t in texts:
        ranks.setdefault(t.encode(), len(ranks))
    encode = tiktoken.Encoding("one", pat_str=B.split_pattern(), mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
    split = B.splitter(B.split_pattern())
    assert [t for t in texts if (len(split(t)) == 1) != (len(encode(t)) == 1)] == []


def _vocabulary(tmp_path, tokens_in_order):
    import base64
    path = tmp_path / "ranks"
    every = [bytes([b]) for b in range(256)] + tokens_in_order
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(every)))
    return str(path)


def test_ranks_that_no_training_gives(tmp_path):
    """A merge that makes a pair of lower rank than its own: the least rank in a word still goes first."""
    path = _vocabulary(tmp_path, [b"abc", b"bcd", b"cd", b"ab", b"bc", b"aa", b"aaa", b"ca", b"abcd"])
    own = library(path)

    @settings(max_examples=500, deadline=None, database=None)
    @given(st.lists(st.text(alphabet="abcd ", max_size=14), max_size=4))
    def run(texts):
        assert [i.tolist() for i in B.encode_block(texts, path, B.split_pattern())] == [own.encode_ordinary(t) for t in texts]
    run()


def test_replay_against_one_pair_at_a_time():
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice(list(b"theanrsi "), rng.integers(1, 12)).tolist()) for _ in range(3000)]
    m = B.merges(PATH)
    ids, ends = m.replay(words)
    assert [c.tolist() for c in np.split(ids, ends[:-1])] == [m.one_word(w) for w in words]
    assert [len(a) for a in m.replay([])] == [0, 0]


@pytest.mark.parametrize("block, flush", [(B.BLOCK_CHARS, B.FLUSH_IDS), (100, 50)])
def test_documents(spark, block, flush, monkeypatch):
    """All cases, in blocks of any size; decoding gives the bytes back."""
    monkeypatch.setattr(B, "BLOCK_CHARS", block)
    monkeypatch.setattr(B, "FLUSH_IDS", flush)
    own = library(PATH)
    docs = cases.docs(spark).withColumnRenamed("words", "ids").withColumnRenamed("spans", "a.b")
    out = B.encode(docs, PATH)
    got = sorted(((r.doc_id, list(r.ids), bytes(r.back)) for r in out.withColumn("back", B.decode(out.ids, PATH)).collect()), key=str)
    want = sorted(((i, own.encode_ordinary(t or ""), (t or "").encode()) for i, t in cases.TEXTS), key=str)
    assert got == want
    assert B.encode(cases.empty(spark), PATH).count() == 0


def test_query_against_the_library(spark):
    own = library(PATH)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()

    def row(d):
        ids = own.encode_ordinary(d.text or "")
        return (d.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((d.text or "").encode()).hexdigest())
    out = queries.op13_bpe_replay(spark, SF001)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(map(row, docs))
