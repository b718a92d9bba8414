"""Shuffled controls and splits, drawn from hashes of the row so that reruns agree."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffle_dinucleotides(seq: str, seed) -> str:
    """A random sequence with the same neighbouring pairs: a random Eulerian walk from the first character to the last.

    For each character but the last of the walk one successor is kept for its final visit; these are drawn again until
    they lead to the last character from everywhere, then the other successors are shuffled.
    """
    if len(seq) < 3:
        return seq
    rng = random.Random(str(seed))
    follow: dict[str, list[str]] = {}
    for a, b in zip(seq, seq[1:]):
        follow.setdefault(a, []).append(b)
    end = seq[-1]
    while True:
        exits = {a: rng.choice(xs) for a, xs in follow.items() if a != end}

        def leads(a: str) -> bool:
            seen = set()
            while a != end and a not in seen:
                seen.add(a)
                a = exits[a]
            return a == end

        if all(leads(a) for a in exits):
            break
    order = {}
    for a, xs in follow.items():
        xs = list(xs)
        if a in exits:
            xs.remove(exits[a])
        rng.shuffle(xs)
        order[a] = iter(xs + ([exits[a]] if a in exits else []))
    out = [seq[0]]
    for _ in range(len(seq) - 1):
        out.append(next(order[out[-1]]))
    return "".join(out)


def shuffled(seqs: DataFrame, salt: int = 1) -> DataFrame:
    """Each sequence shuffled with its neighbouring pairs kept; the seed is the salt and the sequence's id."""

    @F.pandas_udf("string")
    def shuffle(seq: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([shuffle_dinucleotides(s, k) for s, k in zip(seq, key, strict=True)], dtype="object")

    return seqs.withColumn("sequence", shuffle("sequence", F.concat_ws(":", F.lit(salt), "seq_id")))


def with_control(seqs: DataFrame, salt: int = 1) -> DataFrame:
    """A contrast of one set gets a shuffled copy of it as its control, with the next set number."""
    alone = seqs.groupBy("contrast").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo = hi").select("contrast")
    copy = shuffled(seqs.join(F.broadcast(alone), "contrast", "left_semi"), salt).withColumn("set_id", F.col("set_id") + 1)
    return seqs.unionByName(copy.select(*seqs.columns))


def split(seqs: DataFrame, share: float = 0.9, salt: int = 1) -> DataFrame:
    """Adds ``is_train``: whether a hash of salt and id, as a fraction, is below ``share``."""
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), "seq_id").cast("binary")), 1, 8), 16, 10).cast("long")
    return seqs.withColumn("is_train", part / F.lit(float(2**32)) < share)
