import pyarrow.parquet as pq
import pytest
import sentencepiece

from markcheck.llm import token_count

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "  ", "a", "a ", " a", "a  b", "a    b   ", "\n", "\n\n a\tb\r\n", "x\x00y", "<s>x</s><unk>", "<0x0A>", "▁x▁", "ﬁ ½ Å", "日本語 text", "a　b​c", "😀😀 ok", "The the THE", "1234567890 12 ", "ab" * 500]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=token_count.bundled_model())


def test_counts_equal_the_library(library):
    count = token_count.counter(token_count.bundled_model())
    texts = TEXTS + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() + pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist()[:100]
    assert [count.text(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_memo_may_be_emptied(library, monkeypatch):
    monkeypatch.setattr(token_count, "MEMO", 3)
    count = token_count.counter(token_count.bundled_model())
    text = "some words come back and some words go and come back again"
    assert count.text(text) == len(library.encode(text))


def test_edge_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b", None), (3, "long text " * 3000, "x")]
    out = token_count.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    assert [tuple(r) for r in out[:2]] == [(1, 0, 0, False), (2, 0, 0, False)]
    assert out[3].doc_id is None and out[3].n_tokens == len(library.encode("a b"))
    assert out[4].n_tokens == len(library.encode("long text " * 3000)) and out[4].over_limit
    assert len(out) == 5
    assert token_count.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
