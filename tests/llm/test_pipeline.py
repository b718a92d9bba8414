
import corpus_pipeline
from kontrast.llm.decontamination import WINDOW
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_jaccard_join import brute as brute_links
from tests.llm.test_line_dedup import brute as brute_lines


def test_each_stage_on_its_own_input(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = corpus_pipeline.stored(stage(spark, docs, d), "stage")
        after = {r.doc_id: r.text for r in out.collect()}
        if name != "mixing":
            assert out.columns == columns
        if name == "quality_classifier":
            clean = [i for i, _ in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
            bad = [i for i, _ in before if i in labels and (labels[i].toxic or not labels[i].quality)]
            assert sum(i in after for i in clean) > 0.95 * len(clean) and sum(i in after for i in bad) < 0.8 * len(bad)  # 300 labels teach little; test_quality has more
        elif name == "line_dedup":
            assert after == {i: t for i, t, _, gone in brute_lines(before) if not gone or (t or "").strip()}
        elif name == "jaccard_join":
            assert set(after) == {c for _, c in brute_links(before, 5, 80).values()}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in brute_hits(before, bench, WINDOW) if not r[5]}
        else:
            assert set(after) == {i for i, _ in before}
        docs = out


def test_edges_of_each_stage(spark):
    """Nulls, empty texts, repeated rows, rows of one id and an empty table go through each stage."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    passage = spark.read.parquet(f"{d}/benchmark.parquet").first().text
    line = "this very line stands in several documents of the table"
    words = " ".join(f"word{i}" for i in range(60))
    odd = [(None, words), (None, passage), (None, None), (7, None), (7, ""), (8, words + " more"), (8, words + " more"), (9, line + "\nfirst"), (9, line + "\nsecond"), (10, words + " other"), (11, " \n ")]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, rows, d), "stage").collect()
        kept = [(r.doc_id, r.text) for r in out]
        if name == "line_dedup":
            assert sorted(kept, key=str) == sorted([*odd[:8], (9, "second"), *odd[9:]], key=str) or (9, "first") in kept
        elif name == "jaccard_join":  # null ids come last, one of the rows that repeat stays, empty ones are like no other
            assert sorted(kept, key=str) == sorted([(None, passage), (None, None), (7, None), (7, ""), (8, words + " more"), (9, line + "\nfirst"), (9, line + "\nsecond"), (11, " \n ")], key=str)
        elif name == "decontamination":
            assert sorted(kept, key=str) == sorted([x for x in odd if x[1] != passage], key=str)
        elif name == "mixing":
            assert sorted(kept, key=str) == sorted(odd, key=str)
        empty = corpus_pipeline.stored(stage(spark, rows.limit(0), d), "stage")
        assert empty.count() == 0
        if name != "mixing":
            assert empty.columns == docs.columns
