import tempfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchloom.llm import token_blocks as tb

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, "rb") as spec:
    ENCODER = tb.TextEncoder(spec.read())


def expected(texts):
    return [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\x1c\x85\xa0'aaattthe0129é")), max_size=60), max_size=8))
def test_ids_equal_the_library(texts):
    assert [e.tolist() for e in ENCODER.encode(texts)] == expected(texts)


def test_ids_of_specials_and_long_texts():
    texts = ["", None, "a" * 5000, "<|endoftext|>", "x <|endoftext|>y<|endoftext|><|endoftext|> ", "aaaa aaaaa  aaa\n\n a", "Lorem ipsum, dolor sit amet " * 200_000, "x" * 30_000]
    assert [e.tolist() for e in ENCODER.encode(texts)] == expected(texts)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 5000), st.sampled_from([1, 2, 3, 40, 3000, 50_257, 1 << 21]), st.booleans())
def test_segments_come_back(seed, count, vocabulary, periodic):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, vocabulary, count)
    if periodic and count:
        ids = np.resize(ids[: 1 + count // 7], count)
    assert tb.unpack_segment(tb.pack_segment(ids, vocabulary)).tolist() == ids.tolist()


def test_more_blocks_than_lanes_and_small_files():
    rng = np.random.default_rng(1)
    ids = np.r_[np.minimum(rng.geometric(0.05, tb.SEGMENT_IDS), 3000), [5, 6]]
    data = tb.pack_segment(ids, 50_257)
    assert np.array_equal(tb.unpack_segment(data), ids)
    assert len(data) < len(ids)  # about 5.8 bits an id by the entropy of the draw
    text = np.resize(rng.integers(0, 50_257, 300), 2048)
    assert len(tb.pack_segment(text, 50_257)) < 1000


def test_damage_is_found():
    data = bytearray(tb.pack_segment(np.arange(5000) % 777, 50_257))
    data[-300] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        tb.unpack_segment(bytes(data))
    with pytest.raises(ValueError, match="not a segment"):
        tb.unpack_segment(b"x" * 40)


def test_report_equals_the_library(spark):
    rows = [(i, f"text {i} of many, many words " * (i % 7), 1) for i in range(300, 0, -1)]
    rows += [(None, "no id", 1), (None, None, 1), (7, "again", 1), (8, None, 1), (9, "", 1), *[(50, "the same row", 1)] * 200, (-5, "x <|endoftext|> y " * 40_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    with tempfile.TemporaryDirectory(prefix="spark-") as folder:
        tb.write_tokens(docs, f"{folder}/blocks", PATH)
        got = sorted(tb.read_documents(spark, f"{folder}/blocks", with_ids=True).collect(), key=lambda r: r.start)
    ends = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (ends, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        ends += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    wanted = [(i, [*ids, 2]) for (i, *_), ids in zip(rows, expected([t for _, t, _ in rows]), strict=True)]
    assert sorted(str((r.doc_id, r.ids)) for r in got) == sorted(map(str, wanted))


def test_query_and_empty_table(spark):
    docs = spark.createDataFrame([(2, "b"), (1, "a a")], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.n_tokens) for r in tb.token_file_report(docs, PATH).orderBy("start").collect()] == [(1, 0, 3), (2, 3, 2)]
    assert tb.token_file_report(docs.limit(0), PATH).count() == 0


ODD = " \n\t\r'’\"!<|>×÷é1²٣aZsñЖжҀДλ中丸鿿かカ한á́ั \u0085 　​\x1c\x00😀"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.sampled_from([*ODD, "  ", "\n\n", "'s", "'ll", "''", "word", "<|endoftext|>", "<|endof", "text|>"]), st.characters(codec="utf-8")), max_size=14).map("".join)), max_size=6))
def test_pieces_end_where_pre_tokens_end(texts):
    assert [e.tolist() for e in ENCODER.encode(texts)] == expected(texts)


def test_every_word_goes_to_the_library_once():
    encoder = tb.TextEncoder(LIBRARY.to_str().encode())
    texts = [" ".join(f"word{'abc'[i % 3]}{mark}" for i in range(9)) for mark in (",", ".", ";", "!\n", "?", ":", "--", "1", "22")]
    assert [e.tolist() for e in encoder.encode(texts)] == expected(texts)
    assert len(encoder.known) <= 6 + 10  # words with and without a space in front, marks; not words times marks


def test_texts_that_only_some_batches_have():
    batches = [pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["id", "text"]) for ids, texts in (([], []), ([1, None], ["a b", None]), ([3], [""]), ([4, 5], ["ü" * 40_000, "<|endoftext|>"]))]
    ((own, texts),) = tb.gathered(iter([*batches[:1], batches[3].slice(1), *batches[1:]]))
    assert own.to_pylist() == [5, 1, None, 3, 4, 5]
    ids, ends = ENCODER.encode_column(texts.slice(1))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == expected(texts.to_pylist()[1:])
