"""Token counts of whole texts by a public tokenizer, with overlap resynchronisation for huge documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

CHUNK = 16_384
OVERLAP = 256


class PieceCounter:
    """Counts pieces of one sentencepiece BPE model.

    A text longer than ``chunk`` code points is encoded in chunks that overlap. Two neighbouring chunks are spliced at
    a common boundary p in their overlap: both encodings break at p, and the two characters around p stand next to
    each other in no piece of the vocabulary. Every merge makes a piece of the vocabulary, so none can cross p whatever
    surrounds it: the pieces left of p in the first chunk and right of p in the second are those of the whole text.
    If an overlap holds no such p it is doubled, up to the rest of the text.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.inside: set[str] = set()
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i)):
                piece = self.model.id_to_piece(i).replace("▁", " ")
                self.inside.update(piece[k : k + 2] for k in range(len(piece) - 1))

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.count_long(t)
        return out

    def starts(self, text: str) -> list[int]:
        """Where the pieces of this text begin, in code points."""
        begins = np.fromiter((p.begin for p in self.model.encode(text, return_type="proto").pieces), np.int64)
        heads = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80  # the library's offsets are in bytes
        return (np.append(0, np.cumsum(heads))[begins]).tolist()

    def count_long(self, text: str) -> int:
        total, at = 0, 0  # pieces left of code point `at` are counted; `at` is a stable boundary
        begin, left = 0, self.starts(text[: self.chunk])
        end = min(self.chunk, len(text))
        while end < len(text):
            overlap = self.overlap
            while True:
                nxt = max(at, end - overlap)
                stop = min(len(text), nxt + self.chunk + overlap)
                right = self.starts(text[nxt:stop])
                p = self.splice(text, {begin + x for x in left}, {nxt + x for x in right}, nxt, end)
                if p is not None:
                    break
                if nxt == at:  # the overlap is all that isn't counted yet: take a longer chunk instead
                    end = min(len(text), end + self.chunk + overlap)
                    left = self.starts(text[begin:end])
                    if end == len(text):
                        return total + sum(begin + x >= at for x in left)
                overlap *= 2
            total += sum(at <= begin + x < p for x in left)
            at, begin, left, end = p, nxt, right, stop
        return total + sum(begin + x >= at for x in left)

    def splice(self, text: str, left: set[int], right: set[int], lo: int, hi: int) -> int | None:
        for p in range(hi - 1, lo, -1):
            if text[p - 1 : p + 1] not in self.inside and p in left and p in right:
                return p
        return None


class JsonCounter:
    """Counts tokens of one file of the tokenizers library; strings of special tokens in a text are handled as its default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> PieceCounter | JsonCounter:
    return JsonCounter(path) if path.endswith(".json") else PieceCounter(path, chunk, overlap)


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``df``, in one pass without a shuffle.

    ``tokenizer`` is a file that each executor has (installed with the tokenizer library). A null text counts as empty:
    0 bytes, 0 tokens. Null and repeated ids give a row for each input row; other columns are not read. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer, chunk, overlap)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = c.count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
