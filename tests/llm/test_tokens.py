import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TABLE = tokens.MergeTable(PATH)


def expected(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\x1c\x85\xa0'aaattthe0129é")), max_size=60), max_size=8))
def test_counts_equal_the_library(texts):
    assert tokens.TokenCounter(TABLE).count_all(texts) == expected(texts)


def test_specials_runs_and_long_texts():
    long = "Lorem ipsum dolor sit amet " * 200_000
    texts = ["", None, "a" * 5000, "<|endoftext|>", "x <|endoftext|>y<|endoftext|><|endoftext|> ", "aaaa aaaaa  aaa\n\n a", "ab" * 999, long, "x" * 30_000]
    assert tokens.TokenCounter(TABLE).count_all(texts) == expected(texts)


def test_report(spark):
    docs = spark.createDataFrame([(1, "Hello there", 9), (2, None, 9), (2, "", 9), (None, "word " * 600, 9)], "doc_id long, text string, n_tokens int")
    rows = sorted(tokens.token_report(docs, PATH).collect(), key=str)
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        (1, 11, 2, False), (2, 0, 0, False), (None, 3000, expected(["word " * 600])[0], True)}
    assert len(rows) == 4
    assert tokens.token_report(docs.limit(0), PATH).count() == 0
