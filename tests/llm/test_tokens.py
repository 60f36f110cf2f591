import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seekspark.llm import prefix_counts as C
from seekspark.llm import simple8b as S
from seekspark.llm import tokens
from tests.llm import cases

ODD = st.text(alphabet=st.sampled_from(list("aàZßΣİé 's\n\t\xa0 \x1c\x0b're!?1٣日é̇\U0001F600<|endoftext|>​\x00\x01vl")), max_size=25)
TEXT = st.one_of(ODD, st.text(max_size=25)).map(lambda t: t.encode("utf8", "ignore").decode())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_ids_as_the_library(name):
    own = tokens.Pieces(tokens.vocabulary(name))

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.lists(TEXT, max_size=4))
    def run(texts):
        assert list(own.all_ids(texts)) == [own.of(t) for t in texts]
    run()
    assert list(own.all_ids([None, cases.LONG, ""])) == [b"", own.of(cases.LONG), b""]


@pytest.mark.parametrize("kept", [1, 3])
def test_forgetting_changes_nothing(kept, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", kept)
    monkeypatch.setattr(tokens, "MOST_PIECES", kept)
    own = tokens.Pieces(tokens.vocabulary("byte_bpe_50k.json"))
    texts = [t for _, t in cases.TEXTS if t] * 2
    assert [x for t in texts for x in own.all_ids([t])] == [own.of(t) for t in texts]


def test_count_of_every_prefix():
    import unicodedata
    path = tokens.vocabulary("word_bpe_49k.json")
    own, library = C.counter(path), tokens.load(path)

    def by_library(t):
        return [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]

    @settings(max_examples=400, deadline=None, database=None)
    @given(TEXT)
    def run(t):
        t = unicodedata.normalize("NFC", t)
        assert C.counts_of(own.table(t)).tolist() == by_library(t)
    run()
    for t in ("don't we're I'll 'r 're 'ab've", "a<|endoftext|>b <|endoftext", cases.BASE):
        assert C.counts_of(own.table(t)).tolist() == by_library(t)


def test_prefix_tables_answer_questions(spark):
    path = tokens.vocabulary("word_bpe_49k.json")
    library = tokens.load(path)
    rows = C.prefix_tables(cases.docs(spark), path)
    rows = rows.select("*", C.chars_within(rows.prefix_steps, 20).alias("fits"),
                       C.tokens_up_to(rows.prefix_steps, rows.n_bytes * 0 + 30).alias("first"))
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.first, r.fits) for r in rows.collect()), key=str)
    want = []
    for i, t in cases.TEXTS:
        t = t or ""
        counts = C.counts_of(C.counter(path).table(t))
        want.append((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids), int(counts[min(30, len(counts) - 1)]),
                     max(j for j, n in enumerate(counts) if n <= 20)))
    assert got == sorted(want, key=str)
    assert C.prefix_tables(cases.empty(spark), path).count() == 0


@settings(max_examples=200, deadline=None, database=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2 ** 64 - 1)), max_size=300))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, escapes, escaped = S.encode_block(v)
    assert S.decode_block(words, len(v), escapes, escaped).tolist() == values
    assert len(escapes) == sum(x >= 1 << 60 for x in values)
    assert len(words) <= len(v)


def test_small_numbers_pack_tight():
    words, _, _ = S.encode_block(np.ones(6000, np.uint64))
    assert len(words) == 100


def test_token_files(spark, monkeypatch):
    path = tokens.vocabulary(S.VOCABULARY)
    monkeypatch.setattr(S, "FILE_IDS", 500)
    folder = S.token_folder(spark)
    manifest = S.write_tokens(cases.docs(spark), folder, path)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.ids) for r in S.read_tokens(manifest, folder).collect()),
                 key=lambda x: x[2])
    assert [g[:2] for g in got] == sorted(g[:2] for g in got)  # ascending, null first
    at = 0
    for _, _, start, ids in got:
        assert start == at
        at += len(ids) // 4
    own = tokens.load(path)
    want = [(i is not None, i or 0, np.array(own.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
            for i, t in cases.TEXTS]
    assert sorted((a, b, d) for a, b, _, d in got) == sorted(want)


def test_no_token_files(spark):
    folder = S.token_folder(spark)
    manifest = S.write_tokens(cases.empty(spark), folder, tokens.vocabulary(S.VOCABULARY))
    assert S.read_tokens(manifest, folder).count() == 0


def test_files_are_read_by_several_tasks_and_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(S, "FILE_IDS", 300)
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(400)], "doc_id long, text string")
    folder = S.token_folder(spark)
    files = S.write_tokens(docs, folder, tokens.vocabulary(S.VOCABULARY))
    rows = files.orderBy("task", "part").collect()
    assert len(rows) > 8 and [r["first"] for r in rows] == np.cumsum([0] + [r.n_ids for r in rows])[:-1].tolist()
    out = S.read_tokens(files, folder)
    from pyspark.sql import functions as F
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    got = out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n")).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(400))
    assert [r["start"] for r in got] == np.cumsum([0] + [r.n for r in got])[:-1].tolist()


def test_characters_within_the_limit(spark):
    """The query's truncation answer against encoding the cut text anew."""
    from seekspark.llm import queries
    from tests.conftest import SF001
    library = tokens.load(tokens.vocabulary(C.VOCABULARY))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
    cut = 0
    for r in queries.op5_prefix_counts(spark, SF001).collect():
        text = texts[r.doc_id] or ""
        n = len(library.encode(text[:r.chars_within_limit], add_special_tokens=False).ids)
        assert n <= C.LIMIT and (r.chars_within_limit == len(text)) == (not r.over_limit)
        if r.over_limit:
            cut += 1
            assert n == C.LIMIT and len(library.encode(text[:r.chars_within_limit + 1], add_special_tokens=False).ids) > C.LIMIT
    assert cut > 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_latin_pieces_are_merged_together(name, monkeypatch):
    """No new piece of Latin characters goes to the library by itself."""
    own = tokens.Pieces(tokens.vocabulary(name))
    alphabet = "aabbcdeéßÀZ019.,-(ªñþ²"
    texts = [" ".join("".join(alphabet[(i * 7 + j * j * 3 + i // 5) % len(alphabet)] for j in range(i % 19 + 1)) for i in range(k, k + 400))
             for k in range(0, 4000, 400)]
    monkeypatch.setattr(own, "_find", lambda piece: pytest.fail(f"asked for {piece!r} alone"))
    assert list(own.all_ids(texts)) == [own.of(t) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_lower_case_beyond_latin_and_odd_pieces(name, monkeypatch):
    """Pieces with a lower case elsewhere, apostrophes, white space or no character, beside merged ones and over several rounds."""
    own = tokens.Pieces(tokens.vocabulary(name))
    monkeypatch.setattr(tokens, "LEARN_PIECES", 3)
    texts = ["aȺb Ⱦa İx", "don't 'RE we're' 5's", "a  b \n\n c\td\x85e\xa0f ", "x" * 70 + " " + "é" * 64 + " 12 345", "K Å ẞ a", " ", "\x00 \x1c\x7f"]
    assert list(own.all_ids(texts)) == [own.of(t) for t in texts]


def test_merges_of_no_words_and_of_single_bytes():
    merges = tokens.pieces(tokens.vocabulary("byte_bpe_50k.json")).merges
    none = np.zeros(0, np.int64)
    assert [x.tolist() for x in merges.ids(np.zeros(0, np.uint8), none, none)] == [[], []]
    ids, count = merges.ids(np.arange(256, dtype=np.uint8), np.arange(256), np.ones(256, np.int64))
    assert ids.tolist() == merges.inner.tolist() and set(count) == {1}
