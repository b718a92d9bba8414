"""Benchmark passages in training text, by a positional inverted index; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, release, stored, text_or_empty

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How far from its place a term may stand in a proximity match.
NEAR = 1
BROADCAST_ROWS = 200_000
END = "\x00"


def words(col: str = "text") -> Column:
    """Maximal runs of ASCII digits and letters and of all characters outside ASCII; A-Z lower-cased."""
    parts = F.split(F.translate(text_or_empty(col), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++")
    # only the first and the last part can be empty
    head, n = F.when(parts[0] == "", 2).otherwise(1), F.size(parts)
    tail = F.when((n > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, head, F.greatest(F.lit(0), n - head + 1 - tail))


def windows_of(items: DataFrame, n: int) -> DataFrame:
    """(window, words, items): the distinct windows of ``n`` words, or of a whole shorter text, with the items that have them."""
    w = items.select(F.col("item_id").alias("item"), words().alias("ws")).where("size(ws) > 0 AND item IS NOT NULL")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (n - 1)))
    w = w.select("item", "ws", F.explode(starts).alias("at")).select("item", F.expr(f"slice(ws, at, {n})").alias("words"))
    return w.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("window", F.xxhash64("words"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if the table, of a few numbers a row, has at most BROADCAST_ROWS rows; else left to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def postings_of(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The stored positional index (row, doc_id, term, pos): where each of the given terms stands in each text.

    ``row`` numbers the rows of ``docs``; a term is named by its 64-bit hash. For each text there is one more posting, of
    the term END, which no text holds; its position is the number of words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("ws")).withColumn("row", F.monotonically_increasing_id())
    cells = rows.select("row", "doc_id", F.posexplode(F.array_append("ws", F.lit(END))).alias("pos", "word"))
    known = terms.union(terms.sparkSession.range(1).select(F.xxhash64(F.lit(END))))
    return stored(cells.select("row", "doc_id", F.xxhash64("word").alias("term"), "pos").join(small(known, n_terms), "term", "left_semi"), "postings")


def matches(docs: DataFrame, items: DataFrame, n: int = WINDOW, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, start, length, window, items, exact): where windows of ``items`` stand in ``docs``, exactly or within
    ``slop``; and (row, doc_id, n_words) of each row of ``docs``.

    1. Positional index, stored once: postings of all test terms in all training texts; counts of the terms from it.
    2. Each window's terms are ranked by these counts, rarest first; ties go to the smaller term, then the first place.
    3. A posting of the rarest term, moved left by the term's offset, is a candidate start. The list of the second
       rarest, moved by its own offset, is intersected with it first, which few candidates survive.
    4. The lists of the other terms of these texts are intersected at their offsets: a candidate stands if each term has
       a posting within ``slop`` of its place; it is exact if each has one at its place.
    A match needs each term of the window, so no bound on postings or candidates is needed.
    """
    grams = stored(windows_of(items, n), "windows")
    spread = stored(grams.select("window", F.posexplode("words").alias("offset", "word")).withColumn("term", F.xxhash64("word")), "window-terms")
    terms = stored(spread.select("term").distinct(), "terms")
    n_terms, n_spread = terms.count(), spread.count()
    index = postings_of(docs, terms, n_terms)
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = spread.groupBy("window", "term").agg(F.min("word").alias("word"), F.min("offset").alias("offset")).join(small(counts, n_terms), "term", "left")
    order = Window.partitionBy("window").orderBy(F.coalesce("df", F.lit(0)), "word", "offset")
    ranked = rarest.withColumn("place", F.row_number().over(order)).where("place <= 2").groupBy("window").agg(
        *[F.min(F.when(F.col("place") == k, F.struct("df", "term", "offset"))).alias(f"t{k}") for k in (1, 2)]
    )
    seeds = stored(ranked.where("t1.df IS NOT NULL").select("window", "t1.term", "t1.offset", "t2"), "seeds")

    n_seeds = seeds.count()
    shifts = F.explode(F.sequence(F.lit(-slop), F.lit(slop)) if slop else F.array(F.lit(0))).alias("shift")
    first = index.join(small(seeds.select("window", "term", "offset", F.col("t2").isNotNull().alias("more")), n_seeds), "term")
    first = first.select("row", "doc_id", "window", (F.col("pos") - F.col("offset")).alias("start"), "more").where(F.col("start") >= -slop)
    second = index.join(small(seeds.where("t2 IS NOT NULL").select("window", "t2.term", "t2.offset"), n_seeds), "term")
    second = second.select("row", "window", (F.col("pos") - F.col("offset")).alias("start"), shifts).select("row", "window", (F.col("start") + F.col("shift")).alias("start"))
    starts = first.where("more").join(second, ["row", "window", "start"], "left_semi").unionByName(first.where("NOT more")).drop("more")
    starts = stored(starts.select("row", "doc_id", "window", "start"), "candidates")

    some = starts.select("row").distinct()
    full = index.join(small(some, some.count()), "row", "left_semi").select("row", "pos", "term")
    wanted = starts.select("row", "window", "start").join(small(spread.select("window", "offset", "term"), n_spread), "window").select("*", shifts)
    wanted = wanted.withColumn("pos", F.col("start") + F.col("offset") + F.col("shift"))
    met = wanted.join(full, ["row", "pos", "term"]).groupBy("row", "start", "window").agg(F.count_distinct("offset").alias("met"), F.count(F.when(F.col("shift") == 0, 1)).alias("straight"))
    found = starts.join(met, ["row", "start", "window"]).join(grams, "window").where("met = size(words)")
    found = stored(found.select("row", "doc_id", "start", F.size("words").alias("length"), "window", "items", (F.col("straight") == F.size("words")).alias("exact")), "matches")
    sized = stored(index.where(F.col("term") == F.xxhash64(F.lit(END))).select("row", "doc_id", F.col("pos").cast("long").alias("n_words")), "sizes")
    release(grams, spread, terms, index, seeds, starts)
    return found, sized


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, slop: int = NEAR) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of each row of ``docs``.

    A word inside any exact occurrence of a window of ``items`` is hit. ``n_near`` counts the items of which a window
    stands in the text so that, seen from its rarest term, each term is within ``slop`` of its place. Null texts have no
    words. Each row goes by its own text, also rows without an id and rows that repeat one. Items without an id take no
    part; rows of ``items`` that repeat an id count as one item. An empty table on either side gives the rows of ``docs``
    with no hit. Texts are never cut; other columns are not read.
    """
    found, sized = matches(docs, items, n, slop)
    spans = found.where("exact").groupBy("row", "start").agg(F.max("length").alias("length"))
    w = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(w), F.lit(0))))
    hits = spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = found.select("row", "exact", F.explode("items").alias("item")).groupBy("row", "item").agg(F.max("exact").alias("exact"))
    name = F.when(F.col("exact"), F.col("item").cast("string"))
    names = named.groupBy("row").agg(F.count(name).alias("n_items"), F.sort_array(F.collect_set(name)).alias("names"), F.count(F.lit(1)).alias("n_near"))
    per_row = stored(names.join(hits, "row", "left"), "hits")
    release(found)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sized.join(per_row, "row", "left").select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce(F.concat_ws(",", "names"), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("n_near"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
     g AS (SELECT DISTINCT item_id, array_to_string(ws[i : i + 9], ' ') AS win, ws[i : i + 9] AS win_words, least(len(ws), 10) AS len
           FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)),
     d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
     lens AS (SELECT DISTINCT len FROM g),
     dw AS (SELECT doc_id, i, l.len, array_to_string(ws[i : i + l.len - 1], ' ') AS win
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) x JOIN lens l ON i + l.len - 1 <= len(ws)),
     m AS (SELECT doc_id, i, g.len, item_id FROM dw JOIN g USING (win)),
     h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM m) GROUP BY doc_id),
     n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM m GROUP BY doc_id),
     dt AS (SELECT doc_id, ws[i] AS w, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
     wt AS (SELECT win, o, win_words[o] AS w FROM (SELECT win, win_words, unnest(range(1, len(win_words) + 1)) AS o FROM (SELECT DISTINCT win, win_words FROM g))),
     df AS (SELECT w, count(*) AS df FROM dt GROUP BY w),
     rare AS (SELECT win, w, o FROM (SELECT win, wt.w, o, row_number() OVER (PARTITION BY win ORDER BY coalesce(df, 0), wt.w, o) AS k FROM wt LEFT JOIN df ON wt.w = df.w) WHERE k = 1),
     st AS (SELECT dt.doc_id, rare.win, i - o AS start FROM dt JOIN rare ON dt.w = rare.w),
     nr AS (SELECT st.doc_id, st.win, st.start, count(DISTINCT wt.o) AS met FROM st JOIN wt ON st.win = wt.win
            JOIN dt ON dt.doc_id = st.doc_id AND dt.w = wt.w AND dt.i BETWEEN st.start + wt.o - 1 AND st.start + wt.o + 1 GROUP BY ALL),
     ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nr JOIN g USING (win) WHERE met = len(win_words) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
