"""Nucleotide words as Column expressions: strands, ambiguity codes, packed codes, information content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ambiguity codes of the IUPAC nomenclature and the bases that each stands for.
IUPAC = {
    "a": "a", "c": "c", "g": "g", "t": "t", "m": "ac", "r": "ag", "w": "at", "s": "cg", "y": "ct", "k": "gt",
    "v": "acg", "h": "act", "d": "agt", "b": "cgt", "n": "acgt",
}
BASES = "acgt"
LETTERS = "".join(IUPAC)
#: A letter's code has bit 0 for a, 1 for c, 2 for g, 3 for t.
CODE = {x: sum(1 << BASES.index(b) for b in bases) for x, bases in IUPAC.items()}
LETTER = {v: k for k, v in CODE.items()}
COMPLEMENT = {x: LETTER[sum(1 << BASES.index("tgca"[BASES.index(b)]) for b in bases)] for x, bases in IUPAC.items()}
#: Words up to this length are packed into one BIGINT, four bits a letter.
MOST_PACKED = 15


def _both_cases(table: dict[str, str]) -> tuple[str, str]:
    src = "".join(table)
    dst = "".join(table.values())
    return src + src.upper(), dst + dst.upper()


def normalized(seq: Column) -> Column:
    """Lower case, with u read as t."""
    return F.translate(F.lower(seq), "u", "t")


def reverse_complement(seq: Column) -> Column:
    """The other strand of a word of IUPAC letters, case kept; u becomes a, other characters stay."""
    src, dst = _both_cases(COMPLEMENT | {"u": "a"})
    return F.reverse(F.translate(seq, src, dst))


def canonical(word: Column) -> Column:
    """The smaller of a word and its reverse complement."""
    return F.least(word, reverse_complement(word))


def is_pure(word: Column) -> Column:
    return F.regexp_like(word, F.lit("^[acgt]+$"))


def is_degenerate(word: Column) -> Column:
    return F.regexp_like(word, F.lit("[^acgt]"))


def _sum_over_letters(word: Column, value: dict[int, float | int], zero) -> Column:
    """Sum of a value for each letter, by the number of bases it stands for: lengths before and after deleting the letters."""
    out = F.lit(zero)
    for size, v in value.items():
        letters = "".join(x for x, b in IUPAC.items() if len(b) == size)
        if v:
            out = out + F.lit(v) * (F.char_length(word) - F.char_length(F.translate(word, letters, "")))
    return out


def degeneracy(word: Column) -> Column:
    """Number of bases beyond one that the letters allow, summed over the word."""
    return _sum_over_letters(word, {2: 1, 3: 2, 4: 3}, 0).cast("int")


def information_content(word: Column) -> Column:
    """Bits of a word under equal base shares: 2, 1, log2(4/3) and 0 for letters of one to four bases."""
    return _sum_over_letters(word, {1: 2.0, 2: 1.0, 3: 0.4150374992788438}, 0.0)


def to_regex(word: str) -> str:
    return "".join(IUPAC[x] if len(IUPAC[x]) == 1 else "." if x == "n" else f"[{IUPAC[x]}]" for x in word)


def regex_column(word: Column) -> Column:
    """The same as a Column: each ambiguity letter becomes a class of bases, n any character."""
    for x in LETTERS.replace("n", ""):
        if len(IUPAC[x]) > 1:
            word = F.replace(word, F.lit(x), F.lit("[" + IUPAC[x].upper() + "]"))
    return F.lower(F.replace(word, F.lit("n"), F.lit(".")))


def included(query: Column, ref: Column) -> Column:
    """Whether the base or letter ``query`` is allowed by ``ref``: their codes share all bases of ``query``."""
    code = lambda c: F.element_at(F.create_map(*[F.lit(y) for kv in CODE.items() for y in kv]), c)
    return F.coalesce((code(query).bitwiseAND(code(ref)) == code(query)), F.lit(False))


def packed(word: Column, length: int) -> Column:
    """A word of one length as BIGINT, four bits a letter, first letter highest; null if a character is no IUPAC letter."""
    if length > MOST_PACKED:
        raise ValueError(f"at most {MOST_PACKED} letters can be packed")
    hexed = F.translate(word, LETTERS, "".join(f"{CODE[x]:x}" for x in LETTERS))
    return F.when(F.regexp_like(word, F.lit(f"^[{LETTERS}]{{{length}}}$")), F.conv(hexed, 16, 10).cast("long"))


def unpacked(code: Column, length: int) -> Column:
    hexed = F.lower(F.lpad(F.hex(code), length, "0"))
    return F.translate(hexed, "".join(f"{c:x}" for c in LETTER), "".join(LETTER.values()))


def generalizations(df: DataFrame, word: str, out: str = "child") -> DataFrame:
    """Each row once for each word that allows one more base at one place."""
    place = df.withColumn("__at", F.explode(F.sequence(F.lit(1), F.char_length(word))))
    letter = F.substring(F.col(word), F.col("__at"), F.lit(1))
    more = {x: [LETTER[CODE[x] | bit] for bit in (1, 2, 4, 8) if not CODE[x] & bit] for x in IUPAC}
    table = F.create_map(*[y for x, ys in more.items() for y in (F.lit(x), F.array(*[F.lit(v) for v in ys]) if ys else F.array().cast("array<string>"))])
    place = place.withColumn("__new", F.explode(F.element_at(table, letter)))
    child = F.concat(F.substring(F.col(word), F.lit(1), F.col("__at") - 1), F.col("__new"), F.substring(F.col(word), F.col("__at") + 1, F.char_length(word)))
    return place.withColumn(out, child).drop("__at", "__new")


def shifted(df: DataFrame, word: str, n: int, out: str = "variant") -> DataFrame:
    """Each row once for each shift of its word by up to ``n`` places, with n at the freed end."""
    s = F.col("__shift")
    size = F.char_length(word)
    right = F.concat(F.repeat(F.lit("n"), s), F.substring(F.col(word), F.lit(1), size - s))
    left = F.concat(F.substring(F.col(word), 1 - s, size + s), F.repeat(F.lit("n"), -s))
    return df.withColumn("__shift", F.explode(F.sequence(F.lit(-n), F.lit(n)))).withColumn(out, F.when(s >= 0, right).otherwise(left)).drop("__shift")


def padded(word: Column, left: int, right: int) -> Column:
    return F.concat(F.lit("n" * left), word, F.lit("n" * right))


def strands(seq: Column) -> Column:
    """A sequence, the separator $ and its reverse complement."""
    return F.concat(seq, F.lit("$"), reverse_complement(seq))
