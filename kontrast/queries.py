"""The engine's queries by name over the test tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import alphabet as A
from .functions import measures as M
from .operators import association as S
from .operators import counting as C
from .operators import masking, sampling, search
from .operators import report as R
from .sources.tables import sequences, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MOTIFS = ["tata", "acgt", "ttnaa", "rwy", "nncg", "gattaca"]
PWM = [[0.7, 0.1, 0.1, 0.1], [0.1, 0.2, 0.3, 0.4], [0.25, 0.25, 0.25, 0.25], [0.05, 0.05, 0.05, 0.85]]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL that the oracles share ---

_SEQ = "regexp_replace(lower(d.text), '[^acgt]', '', 'g')"
QUALITY = f"seqs AS (SELECT 'quality' AS contrast, 1 - l.quality AS set_id, d.doc_id AS seq_id, {_SEQ} AS sequence FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
LANG = f"seqs AS (SELECT 'lang' AS contrast, CAST(list_position(['de','en','es','fr'], d.lang) - 1 AS INT) AS set_id, d.doc_id AS seq_id, {_SEQ} AS sequence FROM documents d)"
BOTH = f"seqs AS (SELECT d.lang AS contrast, 1 - l.quality AS set_id, d.doc_id AS seq_id, {_SEQ} AS sequence FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
SIZES = "sizes AS (SELECT contrast, set_id, count(*) AS set_size, CAST(sum(length(sequence)) AS BIGINT) AS seq_size FROM seqs GROUP BY ALL)"


def _grams(k: int, word: str = "w", distinct: bool = True) -> str:
    return f"""occ AS (SELECT contrast, set_id, seq_id, i, substring(sequence, i, {k}) AS w FROM
        (SELECT *, unnest(range(1, length(sequence) - {k} + 2)) AS i FROM seqs WHERE length(sequence) >= {k})),
      words AS (SELECT {"DISTINCT" if distinct else ""} contrast, set_id, seq_id, {word} AS word FROM occ)"""


_RC = "reverse(translate({0}, 'acgt', 'tgca'))"
_CANON = f"least(w, {_RC.format('w')})"


def _mi_sql(cells: list[tuple[str, str]], ps: float = 1.0, power: int = 1) -> str:
    z = " + ".join(f"(CAST({n} AS DOUBLE) + {2 * ps})" for _, n in cells)
    present = " + ".join(f"(CAST({k} AS DOUBLE) + {ps})" for k, _ in cells)
    absent = " + ".join(f"(CAST({n} AS DOUBLE) - CAST({k} AS DOUBLE) + {ps})" for k, n in cells)
    terms = []
    for k, n in cells:
        for x, col in ((f"(CAST({k} AS DOUBLE) + {ps})", present), (f"(CAST({n} AS DOUBLE) - CAST({k} AS DOUBLE) + {ps})", absent)):
            terms.append(f"CASE WHEN {x} > 0 THEN {x} / ({z}) * power(ln({x} * ({z}) / ((CAST({n} AS DOUBLE) + {2 * ps}) * ({col}))), {power}) ELSE 0 END")
    return f"(({' + '.join(terms)}) / ln(2))"


def _z_sql(cells, ps=1.0):
    return "(" + " + ".join(f"(CAST({n} AS DOUBLE) + {2 * ps})" for _, n in cells) + ")"


def _wide_sql(n_sets: int, source: str = "words", key: str = "word") -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE set_id = {s}) AS k{s}" for s in range(n_sets))
    ns = ", ".join(f"(SELECT set_size FROM sizes WHERE set_id = {s}) AS n{s}" for s in range(n_sets))
    return f"wide AS (SELECT *, {ns} FROM (SELECT {key} AS motif, {cols} FROM {source} GROUP BY 1))"


TWO = [("k0", "n0"), ("k1", "n1")]
FOUR = [(f"k{i}", f"n{i}") for i in range(4)]


def _wide(spark: SparkSession, sf_dir: str, by: str, k: int) -> tuple[DataFrame, list]:
    seqs = sequences(spark, sf_dir, by)
    sizes = search.sizes_of(seqs)
    wide = search.wide_counts(C.word_counts(seqs, k).withColumnRenamed("word", "motif"), sizes, "motif")
    (c, sets), = sizes.items()
    cells = [(F.col(f"`{c}:{s}`"), F.lit(n)) for s, n in sets]
    return wide, cells


# --- sources ---


@query(f"WITH {QUALITY}, {SIZES} SELECT contrast, set_id, set_size, seq_size, round(seq_size / set_size, 6) AS mean_size FROM sizes")
def set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.set_sizes(sequences(spark, sf_dir)).withColumn("mean_size", F.round(F.col("seq_size") / F.col("set_size"), 6))


@query(f"""WITH {LANG}, b AS (SELECT contrast, set_id, seq_id // 1000 AS block, sha1(string_agg(sequence, '' ORDER BY seq_id)) AS d FROM seqs GROUP BY ALL)
SELECT contrast, set_id, sha1(string_agg(d, '' ORDER BY block)) AS digest FROM b GROUP BY ALL""")
def set_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.set_digests(sequences(spark, sf_dir, "lang"))


@query(f"WITH {QUALITY} SELECT seq_id, 'doc' || seq_id AS definition, sequence, CAST(row_number() OVER (PARTITION BY set_id ORDER BY seq_id) - 1 AS BIGINT) AS rank, set_id FROM seqs WHERE sequence <> ''")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets written as FASTA and read back; ranks follow the order of the records."""
    from .sources.fasta import read_fasta, scratch, write_fasta

    seqs = sequences(spark, sf_dir).where("sequence <> ''")
    out = None
    for set_id in (0, 1):
        path = scratch(spark, f"fasta{set_id}")
        write_fasta(seqs.where(F.col("set_id") == set_id), path)
        part = read_fasta(spark, path).withColumn("set_id", F.lit(set_id))
        out = part if out is None else out.unionByName(part)
    return out.select(F.regexp_replace("definition", "^doc", "").cast("long").alias("seq_id"), "definition", "sequence", "rank", "set_id")


@query(f"WITH {QUALITY} SELECT seq_id, sequence || '$' || {_RC.format('sequence')} AS sequence FROM seqs")
def strand_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.both_strand_sequence(sequences(spark, sf_dir)).select("seq_id", "sequence")


# --- alphabet ---

_WORDS = "SELECT DISTINCT regexp_replace(lower(p_name || p_type), '[^acgtmrwsykvhdbn]', '', 'g') AS word FROM part"


def _letters(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.regexp_replace(F.lower(F.concat("p_name", "p_type")), f"[^{A.LETTERS}]", "").alias("word")).distinct()


_CLASS = lambda letters: f"(length(word) - length(translate(word, '{letters}', '')))"
_REGEX = "word"
for _x, _b in (("m", "ac"), ("r", "ag"), ("w", "at"), ("s", "cg"), ("y", "ct"), ("k", "gt"), ("v", "acg"), ("h", "act"), ("d", "agt"), ("b", "cgt")):
    _REGEX = f"replace({_REGEX}, '{_x}', '[{_b.upper()}]')"


@query(f"""SELECT word, reverse(translate(word, 'acgtmrwsykvhdbn', 'tgcakywsrmbdhvn')) AS twin, least(word, reverse(translate(word, 'acgtmrwsykvhdbn', 'tgcakywsrmbdhvn'))) AS canonical,
 NOT regexp_matches(word, '[^acgt]') AND word <> '' AS pure, CAST({_CLASS("mrwsyk")} + 2 * {_CLASS("vhdb")} + 3 * {_CLASS("n")} AS INT) AS degeneracy,
 round(2.0 * {_CLASS("acgt")} + {_CLASS("mrwsyk")} + 0.4150374992788438 * {_CLASS("vhdb")}, 6) AS ic, lower(replace({_REGEX}, 'n', '.')) AS regex,
 'nn' || word || 'n' AS padded, upper(word) AS upper FROM ({_WORDS})""")
def alphabet_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return _letters(spark, sf_dir).select(
        "word", A.reverse_complement(w).alias("twin"), A.canonical(w).alias("canonical"), A.is_pure(w).alias("pure"), A.degeneracy(w).alias("degeneracy"),
        F.round(A.information_content(w), 6).alias("ic"), A.regex_column(w).alias("regex"), A.padded(w, 2, 1).alias("padded"), F.upper(w).alias("upper"),
    )


_HEX = "translate(substring(word, 1, 5), 'acgtmrwsykvhdbn', '12483596ac7bdef')"


@query(f"SELECT DISTINCT substring(word, 1, 5) AS word, CAST('0x' || {_HEX} AS BIGINT) AS code, substring(word, 1, 5) AS back FROM ({_WORDS}) WHERE length(word) >= 5")
def packed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _letters(spark, sf_dir).where("length(word) >= 5").select(F.substring("word", 1, 5).alias("word")).distinct()
    return w.withColumn("code", A.packed(F.col("word"), 5)).withColumn("back", A.unpacked(F.col("code"), 5))


_GEN = "(VALUES " + ", ".join(f"('{x}', '{A.LETTER[A.CODE[x] | bit]}')" for x in A.IUPAC for bit in (1, 2, 4, 8) if not A.CODE[x] & bit) + ") g(x, y)"


@query(f"""WITH w AS (SELECT DISTINCT substring(word, 1, 6) AS word FROM ({_WORDS}) WHERE length(word) >= 6)
SELECT DISTINCT word, substring(word, 1, i - 1) || g.y || substring(word, i + 1, 6) AS child FROM (SELECT word, unnest(range(1, 7)) AS i FROM w) JOIN {_GEN} ON substring(word, i, 1) = g.x""")
def all_generalizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _letters(spark, sf_dir).where("length(word) >= 6").select(F.substring("word", 1, 6).alias("word")).distinct()
    return A.generalizations(w, "word").distinct()


@query(f"""WITH w AS (SELECT DISTINCT substring(word, 1, 6) AS word FROM ({_WORDS}) WHERE length(word) >= 6)
SELECT word, CASE WHEN s >= 0 THEN repeat('n', s) || substring(word, 1, 6 - s) ELSE substring(word, 1 - s, 6) || repeat('n', -s) END AS variant FROM (SELECT word, CAST(unnest(range(-2, 3)) AS INT) AS s FROM w)""")
def wiggle_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _letters(spark, sf_dir).where("length(word) >= 6").select(F.substring("word", 1, 6).alias("word")).distinct()
    return A.shifted(w, "word", 2)


@query(f"""WITH w AS (SELECT word, unnest(range(1, length(word) - 3)) AS i FROM ({_WORDS}) WHERE length(word) >= 5)
SELECT DISTINCT word, CAST('0x' || translate(word, 'acgtmrwsykvhdbn', '12483596ac7bdef') AS BIGINT) AS code, word AS back FROM (SELECT substring(word, i, 5) AS word FROM w)""")
def packed_codes_all_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As packed_codes, for all windows of five letters and not the first only."""
    w = _letters(spark, sf_dir).where("length(word) >= 5").select(F.explode(F.sequence(F.lit(1), F.length("word") - 4)).alias("i"), "word")
    w = w.select(F.substring(F.col("word"), F.col("i"), F.lit(5)).alias("word")).distinct()
    return w.withColumn("code", A.packed(F.col("word"), 5)).withColumn("back", A.unpacked(F.col("code"), 5))


@query(f"""SELECT DISTINCT word, substring(word, 1, i - 1) || g.y || substring(word, i + 1) AS child
FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM ({_WORDS})) JOIN {_GEN} ON substring(word, i, 1) = g.x""")
def all_generalizations_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As all_generalizations, for whole words of any length."""
    return A.generalizations(_letters(spark, sf_dir), "word").distinct()


@query(f"""SELECT word, CASE WHEN s >= 0 THEN repeat('n', s) || substring(word, 1, length(word) - s) ELSE substring(word, 1 - s) || repeat('n', -s) END AS variant
FROM (SELECT word, CAST(unnest(range(-2, 3)) AS INT) AS s FROM ({_WORDS}) WHERE length(word) >= 2)""")
def wiggle_variants_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As wiggle_variants, for whole words; a shift by two needs two letters."""
    return A.shifted(_letters(spark, sf_dir).where("length(word) >= 2"), "word", 2)


# --- counting ---


@query(f"WITH {QUALITY}, {_grams(4)} SELECT contrast, set_id, word, count(*) AS n FROM words GROUP BY ALL")
def word_counts_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_counts(sequences(spark, sf_dir), 4)


@query(f"WITH {LANG}, {_grams(4, distinct=False)} SELECT contrast, set_id, word, count(*) AS n FROM words GROUP BY ALL")
def word_counts_by_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_counts(sequences(spark, sf_dir, "lang"), 4, per_occurrence=True)


@query(f"WITH {QUALITY}, {_grams(5, _CANON)} SELECT contrast, set_id, word, count(*) AS n FROM words GROUP BY ALL")
def word_counts_both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_counts(sequences(spark, sf_dir), 5, both_strands=True)


def _count_sql(motif: str, distinct: bool, both: bool) -> str:
    forms = {motif, C.twin(motif)} if both else {motif}
    test = " OR ".join(f"regexp_full_match(substring(sequence, i, {len(motif)}), '{A.to_regex(m)}')" for m in sorted(forms))
    return f"""SELECT contrast, set_id, '{motif}' AS motif, CAST(count({"DISTINCT seq_id" if distinct else "*"}) AS BIGINT) AS n FROM
 (SELECT *, unnest(range(1, length(sequence) - {len(motif)} + 2)) AS i FROM seqs WHERE length(sequence) >= {len(motif)}) WHERE {test} GROUP BY ALL"""


def _counts_sql(distinct: bool, both: bool) -> str:
    parts = " UNION ALL ".join(_count_sql(m, distinct, both) for m in MOTIFS)
    names = ", ".join(f"('{m}')" for m in MOTIFS)
    return f"WITH {QUALITY}, c AS ({parts}), s AS (SELECT DISTINCT contrast, set_id FROM seqs) SELECT s.contrast, s.set_id, m.motif, coalesce(c.n, 0) AS n FROM s CROSS JOIN (VALUES {names}) m(motif) LEFT JOIN c ON c.set_id = s.set_id AND c.motif = m.motif"


@query(_counts_sql(True, False))
def motif_counts_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.motif_counts(sequences(spark, sf_dir), MOTIFS)


@query(_counts_sql(False, False))
def motif_counts_by_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.motif_counts(sequences(spark, sf_dir), MOTIFS, per_occurrence=True)


@query(_counts_sql(True, True))
def motif_counts_both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.motif_counts(sequences(spark, sf_dir), MOTIFS, both_strands=True)


_FIVE = ["tatan", "rwyaa", "nnncg", "acgtm", "wwwww", "bbbbb"]


@query("WITH " + QUALITY + ", " + _grams(5) + " SELECT pattern, contrast, set_id, count(*) AS word_hits, count(DISTINCT seq_id) AS seq_hits FROM words JOIN (VALUES "
       + ", ".join(f"('{p}', '{A.to_regex(p)}')" for p in _FIVE) + ") p(pattern, re) ON regexp_full_match(word, re) GROUP BY ALL")
def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in _FIVE])).alias("pattern"))
    return C.pattern_hits(sequences(spark, sf_dir), patterns.select("pattern", F.col("pattern").alias("form")), 5)


@query(f"""WITH {QUALITY}, o AS (SELECT *, unnest(range(1, length(sequence) - 5 + 2)) AS i FROM seqs WHERE length(sequence) >= 5),
 h AS (SELECT seq_id, set_id, contrast, length(sequence) AS len, i - 1 AS pos, '+' AS strand FROM o WHERE regexp_full_match(substring(sequence, i, 5), '{A.to_regex("rcgta")}')
 UNION ALL SELECT seq_id, set_id, contrast, length(sequence), i - 1, '-' FROM o WHERE regexp_full_match(substring(sequence, i, 5), '{A.to_regex(C.twin("rcgta"))}'))
SELECT contrast, set_id, seq_id, CAST(pos AS INT) AS pos, CAST(pos + 5 AS INT) AS "end", 'm1' AS motifname, 'rcgta' AS motif, strand, CAST(pos AS INT) AS forwardpos, round(pos + 2.5 - len / 2, 6) AS centerdist FROM h""")
def occurrence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.occurrence_table(sequences(spark, sf_dir), {"m1": "rcgta"}, both_strands=True).withColumn("centerdist", F.round("centerdist", 6))


@query(f"""WITH {QUALITY}, o AS (SELECT *, unnest(range(1, length(sequence) - 4 + 2)) AS i FROM seqs WHERE length(sequence) >= 4)
SELECT contrast, set_id, 'tata' AS motifname, CAST(floor((i - 1 + 2.0 - length(sequence) / 2) / 50) * 50 AS BIGINT) AS bin, count(*) AS n FROM o WHERE substring(sequence, i, 4) = 'tata' GROUP BY ALL""")
def center_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.center_histogram(C.occurrence_table(sequences(spark, sf_dir), {"tata": "tata"}), 50)


# --- measures ---

_MEASURES_SQL = ", ".join([
    f"round({_mi_sql(TWO)}, 6) AS mi", f"round({_mi_sql(TWO)} + 1 / ({_z_sql(TWO)} + 1), 6) AS mic_seed", f"round({_mi_sql(TWO)} + 0.5 / ({_z_sql(TWO)} + 1), 6) AS mic_model",
    f"round(({_mi_sql(TWO, power=2)} - power({_mi_sql(TWO)} + 1 / ({_z_sql(TWO)} + 1), 2)) / ({_z_sql(TWO)} + 1), 8) AS mi_variance",
    f"round(2 * ln(2) * {_z_sql(TWO)} * {_mi_sql(TWO)}, 5) AS g", f"round(-ln(2) * {_z_sql(TWO)} * {_mi_sql(TWO)}, 5) AS llr",
    "round(CASE WHEN (k0 + k1) > 0 AND (n0 + n1 - k0 - k1) > 0 THEN (k0::DOUBLE * (n1 - k1) - k1::DOUBLE * (n0 - k0)) / sqrt(n0::DOUBLE * n1 * (k0 + k1) * (n0 + n1 - k0 - k1)) ELSE 0 END, 6) AS mcc",
    "round(k0 / n0 - k1 / n1, 6) AS dfreq", "round(k0 / n0, 6) AS signal_freq", "round(k1 / n1, 6) AS control_freq",
    "round(CASE WHEN (k0 + k1) > 0 AND (n0 + n1 - k0 - k1) > 0 THEN power(k0::DOUBLE * (n1 - k1) - k1::DOUBLE * (n0 - k0), 2) * (n0 + n1) / (n0::DOUBLE * n1 * (k0 + k1) * (n0 + n1 - k0 - k1)) ELSE 0 END, 5) AS chisq",
])


@query(f"WITH {QUALITY}, {SIZES}, {_grams(5)}, {_wide_sql(2)} SELECT motif, k0, k1, {_MEASURES_SQL} FROM wide")
def association_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, cells = _wide(spark, sf_dir, "quality", 5)
    r = lambda c, n=6: F.round(c, n)
    return wide.select(
        "motif", cells[0][0].alias("k0"), cells[1][0].alias("k1"), r(M.mutual_information(cells)).alias("mi"), r(M.corrected_mi(cells)).alias("mic_seed"), r(M.corrected_mi(cells, form="model")).alias("mic_model"),
        r(M.mi_variance(cells), 8).alias("mi_variance"), r(M.g_statistic(cells), 5).alias("g"), r(M.log_likelihood_ratio(cells), 5).alias("llr"), r(M.mcc(cells)).alias("mcc"), r(M.delta_frequency(cells)).alias("dfreq"),
        r(M.frequency(cells, 0)).alias("signal_freq"), r(M.frequency(cells, 1)).alias("control_freq"), r(M.chi_square(cells), 5).alias("chisq"),
    )


@query(f"WITH {LANG}, {SIZES}, {_grams(5)}, {_wide_sql(4)} SELECT motif, round({_mi_sql(FOUR)}, 6) AS mi, round(2 * ln(2) * {_z_sql(FOUR)} * {_mi_sql(FOUR)}, 5) AS g FROM wide")
def four_set_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, cells = _wide(spark, sf_dir, "lang", 5)
    return wide.select("motif", F.round(M.mutual_information(cells), 6).alias("mi"), F.round(M.g_statistic(cells), 5).alias("g"))


THREE = FOUR[:3]


@query(f"WITH {LANG}, {SIZES}, {_grams(4)}, {_wide_sql(3)} SELECT motif, round(greatest(0, ln(2) * {_z_sql(THREE)} * {_mi_sql(THREE)}), 5) AS log_p, round(greatest(0, ln(2) * {_z_sql(THREE)} * {_mi_sql(THREE)}) - ln(256), 5) AS corrected FROM wide WHERE k0 + k1 + k2 > 0")
def three_set_log_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two degrees of freedom, where the tail has a closed form."""
    wide, cells = _wide(spark, sf_dir, "lang", 4)
    cells = cells[:3]
    some = cells[0][0] + cells[1][0] + cells[2][0] > 0
    return wide.where(some).select("motif", F.round(M.raw_log_p(cells), 5).alias("log_p"), F.round(M.corrected_log_p(cells, 4, 0), 5).alias("corrected"))


@query(f"WITH {QUALITY}, {SIZES}, {_grams(6)}, {_wide_sql(2)} SELECT motif, k0, k1, round({_mi_sql(TWO)}, 9) AS mi FROM wide ORDER BY {_mi_sql(TWO)} DESC, motif LIMIT 10")
def kmer_mi_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: six-base words by the information between their presence and the quality label."""
    wide, cells = _wide(spark, sf_dir, "quality", 6)
    mi = M.mutual_information(cells)
    return wide.select("motif", cells[0][0].alias("k0"), cells[1][0].alias("k1"), mi.alias("score")).orderBy(F.desc("score"), "motif").limit(10).select("motif", "k0", "k1", F.round("score", 9).alias("mi"))


def _combined_sql() -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE contrast = '{c}' AND set_id = {s}) AS {c}k{s}, (SELECT set_size FROM sizes WHERE contrast = '{c}' AND set_id = {s}) AS {c}n{s}" for c in ("en", "fr") for s in (0, 1))
    en, fr = ([(f"{c}k{s}", f"{c}n{s}") for s in (0, 1)] for c in ("en", "fr"))
    return f"""WITH {BOTH}, {SIZES}, {_grams(3)}, wide AS (SELECT word AS motif, {cols} FROM words GROUP BY 1)
SELECT motif, round({_mi_sql(en)} - {_mi_sql(fr)}, 6) AS difference, round((({"enn0 + enn1"}) * {_mi_sql(en)} - (frn0 + frn1) * {_mi_sql(fr)}) / (enn0 + enn1 + frn0 + frn1), 6) AS weighted FROM wide"""


@query(_combined_sql())
def contrasts_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information in one language less that in another, plain and weighted by set sizes."""
    seqs = sequences(spark, sf_dir, "both").where(F.col("contrast").isin("en", "fr", "de", "es"))
    sizes = {c: s for c, s in search.sizes_of(seqs).items() if len(s) == 2}
    wide = search.wide_counts(C.word_counts(seqs, 3).withColumnRenamed("word", "motif"), sizes, "motif")
    score = lambda w: search.score_column(sizes, search.Objective("mi", {"en": 1, "fr": -1}, w), 1.0, False)
    return wide.select("motif", F.round(score(False), 6).alias("difference"), F.round(score(True), 6).alias("weighted"))


@query(f"WITH {QUALITY}, {SIZES}, {_grams(5)}, {_wide_sql(2)} SELECT motif, CASE WHEN k0 / n0 < k1 / n1 THEN '-Infinity'::DOUBLE ELSE round({_mi_sql(TWO)}, 6) END AS mi FROM wide WHERE k0 / n0 >= k1 / n1")
def enriched_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, cells = _wide(spark, sf_dir, "quality", 5)
    return wide.select("motif", F.round(M.measure("mi", cells, 1.0, True), 6).alias("mi")).where(F.col("mi") > float("-inf"))


@query(f"""WITH e AS (SELECT event_type, user_id % 2 AS set_id, count(DISTINCT user_id) AS k FROM events GROUP BY ALL), s AS (SELECT user_id % 2 AS set_id, count(DISTINCT user_id) AS n FROM events GROUP BY ALL),
wide AS (SELECT event_type, coalesce(max(k) FILTER (WHERE set_id = 0), 0) AS k0, coalesce(max(k) FILTER (WHERE set_id = 1), 0) AS k1, (SELECT n FROM s WHERE set_id = 0) AS n0, (SELECT n FROM s WHERE set_id = 1) AS n1 FROM e GROUP BY 1)
SELECT event_type, k0, k1, round({_mi_sql(TWO)}, 6) AS mi FROM wide""")
def event_types_by_user_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures don't ask for an alphabet: event types that a user has, by group of users."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", (F.col("user_id") % 2).alias("set_id")).distinct()
    n = {r["set_id"]: r["n"] for r in e.groupBy("set_id").agg(F.count_distinct("user_id").alias("n")).collect()}
    wide = e.groupBy("event_type").agg(F.count_if(F.col("set_id") == 0).alias("k0"), F.count_if(F.col("set_id") == 1).alias("k1"))
    cells = [(F.col("k0"), F.lit(n.get(0, 0))), (F.col("k1"), F.lit(n.get(1, 0)))]
    return wide.select("event_type", "k0", "k1", F.round(M.mutual_information(cells), 6).alias("mi"))


@query(f"""WITH wide AS (SELECT l_returnflag AS flag, count(*) FILTER (WHERE l_linestatus = 'F') AS k0, count(*) FILTER (WHERE l_linestatus = 'O') AS k1, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'F') AS n0, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS n1 FROM lineitem GROUP BY 1)
SELECT flag, k0, k1, round({_mi_sql(TWO)}, 6) AS mi FROM wide""")
def return_flags_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    n = {r["l_linestatus"]: r["count"] for r in li.groupBy("l_linestatus").count().collect()}
    wide = li.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_if(F.col("l_linestatus") == "F").alias("k0"), F.count_if(F.col("l_linestatus") == "O").alias("k1"))
    cells = [(F.col("k0"), F.lit(n.get("F", 0))), (F.col("k1"), F.lit(n.get("O", 0)))]
    return wide.select("flag", "k0", "k1", F.round(M.mutual_information(cells), 6).alias("mi"))


# --- search ---


def _level_sql(k: int, beam: int) -> str:
    return f"""WITH {QUALITY}, {SIZES}, {_grams(k)}, {_wide_sql(2)},
 b0 AS (SELECT motif, {_mi_sql(TWO)} AS score FROM wide WHERE k0 / n0 >= k1 / n1 ORDER BY score DESC, motif LIMIT {beam}),
 kids AS (SELECT child, max(score) AS parent FROM (SELECT substring(motif, 1, i - 1) || g.y || substring(motif, i + 1, {k}) AS child, score FROM (SELECT motif, score, unnest(range(1, {k + 1})) AS i FROM b0) JOIN {_GEN} ON substring(motif, i, 1) = g.x) GROUP BY 1),
 re AS (SELECT child, parent, {_REGEX.replace("word", "child")} AS r FROM kids),
 hit AS (SELECT child, parent, count(DISTINCT seq_id) FILTER (WHERE set_id = 0) AS k0, count(DISTINCT seq_id) FILTER (WHERE set_id = 1) AS k1, (SELECT set_size FROM sizes WHERE set_id = 0) AS n0, (SELECT set_size FROM sizes WHERE set_id = 1) AS n1
         FROM words JOIN re ON regexp_full_match(word, lower(replace(r, 'n', '.'))) GROUP BY ALL),
 b1 AS (SELECT child AS motif, k0, k1, {_mi_sql(TWO)} AS score FROM hit WHERE k0 / n0 >= k1 / n1 AND {_mi_sql(TWO)} >= parent ORDER BY score DESC, motif LIMIT {beam})
SELECT motif, CAST(1 AS INT) AS degeneracy, k0, k1, round(score, 6) AS score FROM b1 UNION ALL SELECT w.motif, 0, w.k0, w.k1, round({_mi_sql([("w.k0", "w.n0"), ("w.k1", "w.n1")])}, 6) FROM wide w JOIN b0 USING (motif)"""


@query(_level_sql(5, 8))
def beam_one_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.find_seeds(sequences(spark, sf_dir), 5, search.Objective("mi"), search.Options(candidates=8, max_degeneracy=1))
    return found.select("motif", "degeneracy", F.col("`quality:0`").alias("k0"), F.col("`quality:1`").alias("k1"), F.round("score", 6).alias("score"))


def _beam_sql(k: int, beam: int, levels: int) -> str:
    """All levels of a beam over canonical words: each keeps the children that score at least as much as their best parent."""
    parts = [f"""WITH {QUALITY}, {SIZES}, {_grams(k, _CANON)}, {_wide_sql(2)},
 b0 AS (SELECT motif, 0 AS degeneracy, {_mi_sql(TWO)} AS score FROM wide WHERE k0 / n0 >= k1 / n1 ORDER BY score DESC, motif LIMIT {beam})"""]
    twin = lambda x: f"reverse(translate({x}, 'acgtmrwsykvhdbn', 'tgcakywsrmbdhvn'))"
    for i in range(levels):
        regex = lambda x: f"lower(replace({_REGEX.replace('word', x)}, 'n', '.'))"
        parts.append(f"""
 kids{i} AS (SELECT least(child, {twin("child")}) AS child, max(score) AS parent FROM (SELECT substring(motif, 1, i - 1) || g.y || substring(motif, i + 1, {k}) AS child, score FROM (SELECT motif, score, unnest(range(1, {k + 1})) AS i FROM b{i}) JOIN {_GEN} ON substring(motif, i, 1) = g.x) GROUP BY 1),
 hit{i} AS (SELECT child, parent, count(DISTINCT seq_id) FILTER (WHERE set_id = 0) AS k0, count(DISTINCT seq_id) FILTER (WHERE set_id = 1) AS k1, (SELECT set_size FROM sizes WHERE set_id = 0) AS n0, (SELECT set_size FROM sizes WHERE set_id = 1) AS n1
   FROM words JOIN (SELECT *, {regex("child")} AS r, {regex(twin("child"))} AS t FROM kids{i}) ON regexp_full_match(word, r) OR regexp_full_match(word, t) GROUP BY ALL),
 b{i + 1} AS (SELECT child AS motif, {i + 1} AS degeneracy, {_mi_sql(TWO)} AS score FROM hit{i} WHERE k0 / n0 >= k1 / n1 AND {_mi_sql(TWO)} >= parent ORDER BY score DESC, motif LIMIT {beam})""")
    union = " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(levels + 1))
    return ",".join(parts) + f" SELECT motif, CAST(degeneracy AS INT) AS degeneracy, round(score, 6) AS score FROM ({union})"


@query(_beam_sql(4, 10, 3))
def seed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search at one length, both strands, by 10 candidates up to 3 of 12 degrees of degeneracy."""
    found = search.find_seeds(sequences(spark, sf_dir), 4, search.Objective("mi"), search.Options(candidates=10, both_strands=True, max_degeneracy=3))
    return found.select("motif", "degeneracy", F.round("score", 6).alias("score"))


@query()
def repeated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best pattern over two lengths, masked, twice; 5 candidates, one degree of degeneracy."""
    found = search.find_multiple(sequences(spark, sf_dir), [3, 4], 2, search.Objective("mi"), search.Options(candidates=5, max_degeneracy=1))
    return spark.createDataFrame([(f.motif, round(f.score, 6), round(f.log_p, 5)) for f in found], "motif string, score double, log_p double")


# --- masking ---

_MASK = f"""WITH {QUALITY}, c AS (SELECT *, unnest(range(1, length(sequence) + 1)) AS i FROM seqs),
 m AS (SELECT DISTINCT seq_id, i + o AS i FROM (SELECT seq_id, i, unnest([0, 1, 2]) AS o FROM c WHERE substring(sequence, i, 3) IN ('tat', 'ata')))"""


@query(f"""{_MASK}, a AS (SELECT c.seq_id, string_agg(CASE WHEN m.i IS NULL THEN substring(sequence, c.i, 1) ELSE '-' END, '' ORDER BY c.i) AS x FROM c LEFT JOIN m ON c.seq_id = m.seq_id AND c.i = m.i GROUP BY 1)
SELECT seqs.seq_id, coalesce(x, '') AS sequence FROM seqs LEFT JOIN a ON seqs.seq_id = a.seq_id""")
def masked_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mask_motif(sequences(spark, sf_dir), "tat", both_strands=True).select("seq_id", "sequence")


@query(f"WITH {QUALITY} SELECT seq_id, sequence FROM seqs WHERE NOT regexp_matches(sequence, 'tataa') AND NOT regexp_matches(sequence, 'ttata')")
def removed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.remove_motif(sequences(spark, sf_dir), "tataa", both_strands=True).select("seq_id", "sequence")


@query(f"WITH {QUALITY}, k AS (SELECT *, regexp_matches(sequence, 'tataa') AS gone FROM seqs) SELECT contrast, set_id, count(*) FILTER (WHERE gone) AS sequences, CAST(coalesce(sum(length(sequence)) FILTER (WHERE gone), 0) AS BIGINT) AS nucleotides FROM k GROUP BY ALL")
def removal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = sequences(spark, sf_dir)
    return masking.removal_report(seqs, masking.remove_motif(seqs, "tataa"))


@query(f"""WITH {QUALITY}, c AS (SELECT seq_id, sequence, length(sequence) AS n, unnest(range(0, length(sequence))) AS i FROM seqs WHERE seq_id % 3 = 0),
 a AS (SELECT seq_id, string_agg(CASE WHEN i = 0 OR i = CASE WHEN 4 < n THEN 4 ELSE 2 * n - 4 END THEN 'n' ELSE substring(sequence, i + 1, 1) END, '' ORDER BY i) AS x FROM c GROUP BY 1)
SELECT seqs.seq_id, coalesce(x, sequence) AS sequence FROM seqs LEFT JOIN a ON seqs.seq_id = a.seq_id""")
def positional_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places 0 and 4 of every third sequence; in sequences of up to four letters the second counts back from the end."""
    seqs = sequences(spark, sf_dir)
    spots = seqs.where("seq_id % 3 = 0").select("seq_id", F.explode(F.array(F.lit(0), F.lit(4))).alias("pos"))
    return masking.mask_positions(seqs, spots).select("seq_id", "sequence")


@query(f"WITH {QUALITY} SELECT seq_id, set_id FROM seqs WHERE seq_id % 3 <> 0")
def dropped_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = sequences(spark, sf_dir)
    return masking.drop_sequences(seqs, seqs.where("seq_id % 3 = 0").select("seq_id")).select("seq_id", "set_id")


# --- sampling ---


@query(f"WITH {QUALITY} SELECT seq_id, CAST('0x' || substring(md5('7:' || seq_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.9 AS is_train FROM seqs")
def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(sequences(spark, sf_dir), 0.9, 7).select("seq_id", "is_train")


@query(f"""WITH {QUALITY}, p AS (SELECT seq_id, substring(sequence, i, 2) AS pair FROM (SELECT seq_id, sequence, unnest(range(1, length(sequence))) AS i FROM seqs WHERE set_id = 0))
SELECT seq_id, pair, count(*) AS n FROM p GROUP BY ALL""")
def pairs_after_shuffling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled controls have the neighbouring pairs of the originals."""
    seqs = sampling.with_control(sequences(spark, sf_dir).where("set_id = 0")).where("set_id = 1")
    return C.words(seqs, 2, per_occurrence=True).groupBy("seq_id", F.col("word").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


# --- association over ranks and pairs ---

_X = "x AS (SELECT contrast, set_id, seq_id, CAST(regexp_matches(sequence, 'tataa') AS INT) AS x, CAST(regexp_matches(sequence, 'acgt') AS INT) AS y, length(sequence) AS len FROM seqs)"


def _presence(spark, sf_dir, by="quality"):
    s = sequences(spark, sf_dir, by)
    return s.select("contrast", "set_id", "seq_id", "rank", C.motif_count(F.col("sequence"), "tataa").alias("x"), C.motif_count(F.col("sequence"), "acgt").alias("y"), F.char_length("sequence").alias("len"))


def _mi22(a: str, b: str, c: str, d: str) -> str:
    z = f"({a} + {b} + {c} + {d})"
    cell = lambda x, r, k: f"CASE WHEN {x} > 0 THEN {x} / {z} * ln({x} * {z} / (({r}) * ({k}))) ELSE 0 END"
    return f"(({cell(a, f'{a}+{b}', f'{a}+{c}')} + {cell(b, f'{a}+{b}', f'{b}+{d}')} + {cell(c, f'{c}+{d}', f'{a}+{c}')} + {cell(d, f'{c}+{d}', f'{b}+{d}')}) / ln(2))"


@query(f"""WITH {LANG}, {_X}, r AS (SELECT *, CAST(sum(x) OVER w AS DOUBLE) AS u, CAST(count(*) OVER w AS DOUBLE) AS p, CAST(sum(x) OVER (PARTITION BY set_id) AS DOUBLE) AS t, CAST(count(*) OVER (PARTITION BY set_id) AS DOUBLE) AS n FROM x WINDOW w AS (PARTITION BY set_id ORDER BY seq_id ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT contrast, set_id, n, p, u + 1 AS a, p - u + 1 AS b, t - u + 1 AS c, n - p - (t - u) + 1 AS d FROM r)
SELECT contrast, set_id, round(sum(CASE WHEN p < n THEN {_mi22("a", "b", "c", "d")} ELSE 0 END) / max(n), 6) AS rank_information FROM c GROUP BY ALL""")
def rank_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.rank_information(_presence(spark, sf_dir, "lang"), ["contrast", "set_id"])
    return r.withColumn("rank_information", F.round("rank_information", 6))


@query(f"WITH {QUALITY}, {_X} SELECT set_id, seq_id, round(avg(x) OVER (PARTITION BY set_id ORDER BY seq_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS moving FROM x")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.moving_average(_presence(spark, sf_dir), ["set_id"], "rank", "x", 50)
    return r.select("set_id", "seq_id", F.round("moving", 6).alias("moving"))


@query(f"""WITH {LANG}, z AS (SELECT set_id, CAST(length(sequence) AS DOUBLE) AS a, CAST(length(sequence) - length(replace(sequence, 'g', '')) AS DOUBLE) AS b FROM seqs),
 k AS (SELECT *, rank() OVER (PARTITION BY set_id ORDER BY a) + (count(*) OVER (PARTITION BY set_id, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY set_id ORDER BY b) + (count(*) OVER (PARTITION BY set_id, b) - 1) / 2 AS rb FROM z)
SELECT set_id, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(0.5 * ln((1 + corr(a, b)) / (1 - corr(a, b))), 5) AS fisher_z FROM k GROUP BY 1""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences(spark, sf_dir, "lang")
    n = F.char_length("sequence")
    rows = s.select("set_id", n.cast("double").alias("a"), (n - F.char_length(F.translate("sequence", "g", ""))).cast("double").alias("b"))
    return S.correlations(rows, ["set_id"], "a", "b").select("set_id", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), F.round("fisher_z", 5).alias("fisher_z"))


@query(f"""WITH {QUALITY}, {_X}, s AS (SELECT contrast, sum(x * y) + 1.0::DOUBLE AS a, sum(x * (1 - y)) + 1.0::DOUBLE AS b, sum((1 - x) * y) + 1.0::DOUBLE AS c, sum((1 - x) * (1 - y)) + 1.0::DOUBLE AS d FROM x GROUP BY 1)
SELECT contrast, round({_mi22("a", "b", "c", "d")}, 6) AS pair_information FROM s""")
def pair_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pair_information(_presence(spark, sf_dir), ["contrast"], "x", "y").withColumn("pair_information", F.round("pair_information", 6))


@query(f"""WITH {QUALITY}, {_X}, l AS (SELECT set_id, x AS i, y AS k, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY ALL),
 g AS (SELECT s.set_id, i.i, k.k, coalesce(l.n, 0) + 1 AS n FROM (SELECT DISTINCT set_id FROM x) s CROSS JOIN (VALUES (0), (1)) i(i) CROSS JOIN (VALUES (0), (1)) k(k) LEFT JOIN l ON l.set_id = s.set_id AND l.i = i.i AND l.k = k.k),
 t AS (SELECT n / sum(n) OVER () * ln(n * sum(n) OVER (PARTITION BY k) / (sum(n) OVER (PARTITION BY i, k) * sum(n) OVER (PARTITION BY set_id, k))) AS t FROM g)
SELECT 'quality' AS contrast, round(sum(t) / ln(2), 6) AS conditional_information FROM t""")
def conditional_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.conditional_information(_presence(spark, sf_dir), "contrast", "x", "y").withColumn("conditional_information", F.round("conditional_information", 6))


@query(f"WITH {QUALITY}, {_X} SELECT contrast, CAST(sum(x) FILTER (WHERE set_id = 0) AS DOUBLE) AS tp, CAST(sum(x) FILTER (WHERE set_id = 1) AS DOUBLE) AS fp, CAST(sum(1 - x) FILTER (WHERE set_id = 0) AS DOUBLE) AS fn, CAST(sum(1 - x) FILTER (WHERE set_id = 1) AS DOUBLE) AS tn FROM x GROUP BY 1")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.confusion(_presence(spark, sf_dir))


def _pwm_sql() -> str:
    p = " * ".join("CASE substring(sequence, i + %d, 1) WHEN 'a' THEN %s WHEN 'c' THEN %s WHEN 'g' THEN %s ELSE %s END" % (j, *(f"{x}::DOUBLE" for x in row)) for j, row in enumerate(PWM))
    return f"WITH {QUALITY}, o AS (SELECT *, unnest(range(1, length(sequence) - 4 + 2)) AS i FROM seqs WHERE length(sequence) >= 4), p AS (SELECT contrast, set_id, seq_id, i, {p} AS p FROM o) SELECT contrast, set_id, seq_id, count(*) AS n, round(max(p), 9) AS best, round(sum(p), 6) AS total FROM p GROUP BY ALL"


@query(_pwm_sql())
def pwm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pwm_scan(sequences(spark, sf_dir), PWM).groupBy("contrast", "set_id", "seq_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("p"), 9).alias("best"), F.round(F.sum("p"), 6).alias("total"))


_LOGO = "(VALUES " + ", ".join(f"({i}, '{b}', {p}::DOUBLE)" for i, row in enumerate(PWM) for b, p in zip("acgt", row, strict=True)) + ") m(pos, base, p)"


@query(f"WITH i AS (SELECT pos, 2 + sum(p * log2(p)) AS ic FROM {_LOGO} GROUP BY 1) SELECT m.pos, m.base, m.p, round(m.p * i.ic / 2, 9) AS height, CAST(row_number() OVER (PARTITION BY m.pos ORDER BY m.p, m.base) AS INT) AS place FROM {_LOGO} JOIN i ON m.pos = i.pos")
def logo_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *row) for i, row in enumerate(PWM)], "pos int, a double, c double, g double, t double")
    return S.logo_heights(rows).withColumn("height", F.round("height", 9))


@query("SELECT i AS pos, " + ", ".join(f"CASE WHEN contains(b, '{x}') THEN 1.0::DOUBLE / length(b) ELSE 0 END AS {x}" for x in "acgt") + " FROM (VALUES " + ", ".join(f"({i}, '{A.IUPAC[x]}')" for i, x in enumerate("acgtrymkswvhdbn")) + ") v(i, b)")
def pattern_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(R.matrix_of("acgtrymkswvhdbn"), "pos int, a double, c double, g double, t double")


_TWO_MOTIFS = ["tataa", "rcgta"]


@query(f"""WITH {QUALITY}, {SIZES}, s AS (SELECT m.motif, m.r, seq_id, set_id FROM seqs JOIN (VALUES {", ".join(f"('{m}', '{A.to_regex(m)}')" for m in _TWO_MOTIFS)}) m(motif, r) ON regexp_matches(sequence, m.r)),
 wide AS (SELECT motif, any_value(r) AS regex, count(*) FILTER (WHERE set_id = 0) AS k0, count(*) FILTER (WHERE set_id = 1) AS k1, (SELECT set_size FROM sizes WHERE set_id = 0) AS n0, (SELECT set_size FROM sizes WHERE set_id = 1) AS n1 FROM s GROUP BY 1)
SELECT motif, regex, CAST(length(motif) AS INT) AS length, CASE motif WHEN 'tataa' THEN 10.0::DOUBLE ELSE 9.0::DOUBLE END AS ic, CAST(CASE motif WHEN 'tataa' THEN 0 ELSE 1 END AS INT) AS degeneracy, k0, k1, round({_mi_sql(TWO)}, 6) AS mi, round(2 * ln(2) * {_z_sql(TWO)} * {_mi_sql(TWO)}, 5) AS g,
 round(k0 / n0 - k1 / n1, 6) AS dfreq FROM wide""")
def seed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.seed_report(sequences(spark, sf_dir), _TWO_MOTIFS)
    k = lambda i: F.col("counts")[i]["with_motif"].alias(f"k{i}")
    return r.select("motif", "regex", "length", F.round("ic", 6).alias("ic"), "degeneracy", k(0), k(1), F.round("mi", 6).alias("mi"), F.round("g", 5).alias("g"), F.round("dfreq", 6).alias("dfreq"))


@query(f"""WITH {QUALITY}, o AS (SELECT *, unnest(range(1, length(sequence) - 5 + 2)) AS i FROM seqs WHERE length(sequence) >= 5),
 h AS (SELECT seq_id, i - 1 AS start, i + 4 AS stop, 'm0' AS motifname FROM o WHERE substring(sequence, i, 5) = 'tataa' UNION ALL SELECT seq_id, i - 1, i + 4, 'm1' FROM o WHERE regexp_full_match(substring(sequence, i, 5), '{A.to_regex("rcgta")}'))
SELECT seq_id, CAST(start AS INT) AS start, CAST(stop AS INT) AS "end", 'site_' || (row_number() OVER (PARTITION BY seq_id ORDER BY start, stop, motifname) - 1) AS name, 0 AS score, '+' AS strand FROM h""")
def seed_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bed(C.occurrence_table(sequences(spark, sf_dir), {f"m{i}": m for i, m in enumerate(_TWO_MOTIFS)}))


@query(f"""WITH {QUALITY}, c AS (SELECT seq_id, sequence, unnest(range(1, length(sequence) + 1)) AS i FROM seqs),
 a AS (SELECT seq_id, string_agg(CASE WHEN regexp_matches(substring(sequence, CAST(greatest(1, i - 2) AS BIGINT), CAST(least(i, 3) + 2 AS BIGINT)), 'ata') THEN 'A' ELSE '.' END, '' ORDER BY i) AS marks FROM c GROUP BY 1)
SELECT seqs.seq_id, coalesce(marks, '') AS marks FROM seqs LEFT JOIN a ON seqs.seq_id = a.seq_id""")
def annotated_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter over each place that an occurrence covers."""
    return R.annotated(sequences(spark, sf_dir), ["ata"]).select("seq_id", "marks")


# --- models ---

MODEL_SEED = "tataa"


def _model(seqs: DataFrame):
    from .plans.analysis import background

    n = C.set_sizes(seqs).agg(F.sum("seq_size"), F.sum("set_size")).first()
    return background(seqs).add_motif(MODEL_SEED, "tata", n[0] / n[1])


def _forward_sql() -> str:
    """Scaled forward values a and their derivatives b by the rate of entry, one letter of all sequences a step.

    The sum of b at the end is the expected number of entries.
    """
    w = len(MODEL_SEED)
    background = "CASE x " + " ".join(f"WHEN '{b}' THEN e_{b}" for b in "acgt") + " END"
    emit = [background, *(f"CASE WHEN x = '{c}' THEN 0.91 ELSE 0.03 END" for c in MODEL_SEED)]
    come = [f"a0 * (1 - s) + a{w}", "a0 * s", *(f"a{i}" for i in range(1, w))]
    more = [f"b0 * (1 - s) + b{w}", "b0 * s + a0 * s", *(f"b{i}" for i in range(1, w))]
    states = range(w + 1)
    return f"""WITH RECURSIVE {QUALITY},
 par AS (SELECT least(0.5, 1 / greatest(1, sum(length(sequence)) / count(*) - {w} + 1)) AS s, {", ".join(f"(sum(length(sequence) - length(replace(sequence, '{b}', ''))) + 1) / (sum(length(sequence)) + 4) AS e_{b}" for b in "acgt")} FROM seqs),
 f AS (SELECT contrast, set_id, seq_id, sequence, CAST(0 AS BIGINT) AS pos, CAST(0 AS DOUBLE) AS log, CAST(0 AS DOUBLE) AS log0, {", ".join(f"CAST({int(n + str(i) == 'a0')} AS DOUBLE) AS {n}{i}" for n in "ab" for i in states)} FROM seqs
  UNION ALL SELECT contrast, set_id, seq_id, sequence, pos + 1, log + ln(c), log0 + ln((1 - s) * bg), {", ".join(f"{n}{i} / c" for n in "nm" for i in states)}
  FROM (SELECT *, {" + ".join(f"n{i}" for i in states)} AS c FROM (SELECT *, {background} AS bg, {", ".join(f"({come[i]}) * {emit[i]} AS n{i}, ({more[i]}) * {emit[i]} AS m{i}" for i in states)}
        FROM (SELECT *, substring(sequence, pos + 1, 1) AS x FROM f WHERE pos < length(sequence)) CROSS JOIN par)))
SELECT contrast, CAST(set_id AS INT) AS set_id, seq_id, round(log, 6) AS log_p, round(CASE WHEN pos > 0 THEN 1 - exp(least(0, log0 - log)) ELSE 0 END, 6) AS p_site, round({" + ".join(f"b{i}" for i in states)}, 6) AS sites FROM f WHERE pos = length(sequence)"""


@query(_forward_sql())
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood and site probability of each sequence; kernels are tested against enumeration of paths."""
    from .models.training import score

    seqs = sequences(spark, sf_dir).repartition("seq_id")
    s = score(seqs, _model(seqs))
    return s.select("contrast", "set_id", "seq_id", *[F.round(c, 6).alias(c) for c in ("log_p", "p_site", "sites")])


@query()
def model_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .models.training import decode

    seqs = sequences(spark, sf_dir).repartition("seq_id")
    return decode(seqs, _model(seqs)).select("contrast", "set_id", "seq_id", "n_sites", "path")


@query()
def model_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood before each of three steps of re-estimation."""
    from .models.training import train_em

    seqs = sequences(spark, sf_dir).repartition("seq_id")
    _, history = train_em(seqs, _model(seqs), 3, 0.0)
    return spark.createDataFrame([(i, round(x, 3)) for i, x in enumerate(history)], "step int, log_likelihood double")


@query()
def pattern_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that two tempered chains visit in four steps; they hardly leave their random starts."""
    from .operators.sampler import find_mcmc

    found = find_mcmc(sequences(spark, sf_dir), 4, search.Objective("mi"), search.Options(), chains=2, steps=4)
    return spark.createDataFrame([(m, round(s, 6)) for s, m in found if s > float("-inf")], "motif string, score double")
