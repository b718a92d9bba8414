import public_tokenizers
import pytest

from kontrast.llm.token_counts import PieceCounter, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk,overlap", [(7, 2), (40, 4), (300, 16)])
def test_chunks_give_the_count_of_the_whole(chunk, overlap):
    c = PieceCounter(MODEL, chunk, overlap)
    texts = ["The quick brown fox, größer als\n\nje  zuvor. " * 20, "x" * 900, " " * 333, "日本語のテキスト" * 60, "a\n" * 200, "abc def" * 99, " lead " * 30, "ñ é ü 123456789 " * 40, "\x00\x01 <s> </s>" * 25]
    assert c.count(texts) == [len(x) for x in c.model.encode(texts)]


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "hello world", 5), (2, "", 6)], "doc_id long, text string, n_tokens int")
    n = len(PieceCounter(MODEL).model.encode("hello world"))
    rows = sorted(count_tokens(df, MODEL, limit=1).collect(), key=str)
    
    assert {(r.doc_id, r.n_tokens) for r in rows} == {(1, 0), (2, 0), (None, n)}
    assert count_tokens(df.limit(0), MODEL).count() == 0


def test_whole_table(spark):
    """Bytes, tokens and the limit of each text, long ones spliced, against the library on the whole text."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = df.collect()
    long = max(rows, key=lambda r: len(r.text or "")).text * 3
    both = df.union(spark.createDataFrame([(10**9, long)], "doc_id long, text string"))
    want = {r.doc_id: r.text or "" for r in rows} | {10**9: long}
    model = PieceCounter(MODEL).model
    got = count_tokens(both, MODEL, limit=500, chunk=3000, overlap=64).collect()
    assert len(got) == len(want)
    for r in got:
        text = want[r.doc_id]
        n = len(model.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 500), r.doc_id


def test_files_of_the_other_library(spark):
    from pathlib import Path

    from tokenizers import Tokenizer

    files = sorted(Path(MODEL).parent.glob("*.json"))
    if not files:
        pytest.skip("no such file here")
    texts = ["hello world <s> [CLS] <|endoftext|> größer", "", "日本語 " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = Tokenizer.from_file(str(files[0]))
    plain.no_truncation()
    plain.no_padding()
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, str(files[0])).collect()}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
