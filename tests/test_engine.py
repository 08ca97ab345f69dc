from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.config import PipelineConfig
from docloom.plans import pipeline, registry, trace
from docloom.sources import clusters, tables
from docloom.streaming import ingest

SMALL = PipelineConfig(target_min_tokens=20, target_max_tokens=60, chunking="simple")
DOCS = "sample_id string, doc_ord int, document_id string, title string, source string, text string, lang string, dataset string"


def small_docs(spark):
    body = " ".join(f"The Grey Company sold {i} boats. Rivers rose {i} % on 12/05/2020." for i in range(12))
    rows = [
        ("s1", 0, "d1", "T", None, body, "en", "multi_news"),
        ("s1", 1, "d2", None, "", body.replace("boats", "ships"), "en", "multi_news"),
        ("s2", 0, "d1", None, None, None, "vi", "vims"),
        ("s3", 0, "d1", None, None, "One line only", None, None),
        (None, 0, "d1", None, None, "no sample", "en", None),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_pipeline_covers_every_sample(spark):
    run = pipeline.run(small_docs(spark), SMALL)
    out = {r["sample_id"]: r for r in run.summaries.collect()}
    assert set(out) == {"s1", "s2", "s3"}
    assert out["s1"]["summary"] and out["s1"]["chunk_count"] > 2
    assert out["s2"]["chunk_count"] == 0 and out["s2"]["community_count"] == 0 and out["s2"]["llm_calls"] == 1
    assert run.communities.count() == run.chunks.count()
    relations = trace.trace(run)
    assert relations["communities"].count() == run.chunks.count()
    assert trace.dot(relations["summary_graph_nodes"], relations["summary_graph_edges"]).count() >= 2
    again = {r["sample_id"]: r["summary"] for r in pipeline.run(small_docs(spark), SMALL).summaries.collect()}
    assert again == {k: v["summary"] for k, v in out.items()}


@pytest.mark.parametrize("change", [{"use_graph": False}, {"dedup_chunks": False}, {"salience": "e1"}, {"salience": "e2a", "dedup_require_shared_phrase": True}])
def test_pipeline_variants(spark, change):
    from dataclasses import replace

    assert pipeline.run(small_docs(spark), replace(SMALL, **change)).summaries.count() == 3


def test_direct_and_score(spark):
    refs = spark.createDataFrame([("s1", 0, "The Grey Company sold boats."), ("s1", 1, None), ("s3", 0, " ")], "sample_id string, ref_idx int, text string")
    rows = {r["sample_id"]: r for r in pipeline.score(pipeline.direct(small_docs(spark), SMALL), refs).collect()}
    assert rows["s1"]["reference_count"] == 1 and rows["s1"]["rouge1"] > 0
    assert rows["s3"]["selected_reference_index"] == -1


def test_vn_mds_reader(spark, tmp_path):
    for c in ("cluster_1", "cluster_2", "cluster_10"):
        (tmp_path / "clusters" / c).mkdir(parents=True)
        (tmp_path / "clusters" / c / "b.body.txt").write_text("Second.")
        (tmp_path / "clusters" / c / "a.body.txt").write_bytes(b" First\xff. ")
        (tmp_path / "clusters" / c / "a.info.txt").write_text("The title\nmore")
        if c != "cluster_2":
            (tmp_path / "clusters" / c / f"{c}.ref1.txt").write_text("Reference")
        (tmp_path / "clusters" / c / f"{c}.ref2.txt").write_text("")
        (tmp_path / "clusters" / c / f"{c}.ref1.tok.txt").write_text("Ref er ence")
    docs, refs = clusters.read_samples(spark, "vn_mds", str(tmp_path))
    rows = docs.orderBy("sample_id", "doc_ord").collect()
    assert [(r["sample_id"], r["document_id"], r["title"], r["text"]) for r in rows][:2] == [("cluster_1", "a", "The title", "First."), ("cluster_1", "b", "", "Second.")]
    assert {r["sample_id"] for r in rows} == {"cluster_1", "cluster_10"} and refs.count() == 2
    assert clusters.read_samples(spark, "vn_mds", str(tmp_path), 1)[0].select("sample_id").distinct().first()[0] == "cluster_1"
    with pytest.raises(ValueError):
        clusters.read_samples(spark, "other", str(tmp_path))


def test_vims_reader(spark, tmp_path):
    d = tmp_path / "original" / "Cluster_1" / "original"
    d.mkdir(parents=True)
    (d / "10.txt").write_text("No headers here")
    (d / "2.txt").write_text("Title: A title\nSource: A paper\nContent: \nLine one\nLine two")
    s = tmp_path / "summary" / "Cluster_1"
    s.mkdir(parents=True)
    (s / "x.gold.txt").write_text("Gold")
    docs, refs = clusters.read_samples(spark, "vims", str(tmp_path))
    rows = docs.orderBy("doc_ord").collect()
    assert [(r["document_id"], r["title"], r["source"], r["text"]) for r in rows] == [("2", "A title", "A paper", "Line one\nLine two"), ("10", "", "", "No headers here")]
    assert refs.first()["text"] == "Gold"


def test_multi_news_reader(spark):
    rows = spark.createDataFrame([(" a ||||| ||||| b ", "s"), ("|||||", " "), ("one", None)], "document string, summary string")
    docs, refs = clusters.read_multi_news(rows)
    assert sorted(r["text"] for r in docs.collect()) == ["a", "b", "one", "|||||"]
    assert refs.count() == 1
    lists = spark.createDataFrame([(["x", "y"], ["s", ""])], "documents array<string>, summaries array<string>")
    docs, refs = clusters.read_multi_news(lists)
    assert docs.count() == 2 and refs.count() == 1


def test_result_files(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("a", 1.0)], "dataset string, rouge1 double"), str(tmp_path / "one"))
    tables.write_csv(spark.createDataFrame([("a", "b\nc")], "dataset string, llm string"), str(tmp_path / "two"))
    both = tables.read_results(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert sorted(both.columns) == ["dataset", "llm", "rouge1"] and both.count() == 2


def test_stream_of_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "One. Two.")], "id int, text string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    q = ingest.per_batch(stream, lambda b: ingest.sentence_stream(b, ["id"]), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


FAST = ["normalize_text", "split_sentences", "tri_segments", "trim_to_budget", "chunk_simple", "duplicate_groups", "knn_edges", "weighted_edges", "pacsum_e2b", "budget_select", "compact_support", "rouge2_words", "aggregate_results"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, sf_dir, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    rows = con.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    assert got == sorted(repr(tuple(r)) for r in rows)


def test_capitalised_phrases_of_all_texts(spark, tmp_path):
    import re
    from collections import Counter

    texts = {
        1: "Then Tower Bridge rose over London. The end of It",
        2: "Ông Nguyễn Văn An đến Đà Nẵng và Huế.",
        3: "“Électricité de France” said the Élysée Palace, Paris",
        4: "東京 Tokyo Tower は高い",
        5: "nothing here — at all",
        6: None,
    }
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["phrase"]): r["n"] for r in registry.QUERIES["capitalised_phrases"](spark, str(tmp_path)).collect()}
    pattern = r"\b(?:[A-Z\u00c0-\u1ef4][\w\u00c0-\u1ef9.-]+(?:\s+|$)){1,5}"
    true = Counter((i, " ".join(m.split()).lower()) for i, t in texts.items() if t for m in re.findall(pattern, t))
    assert got == dict(true) and {i for i, _ in got} == {1, 2, 3, 4}


def test_grid_shares_its_base(spark):
    from docloom.config import GraphWeights

    runs = list(pipeline.run_grid(small_docs(spark), [GraphWeights(0.1, 0.3, 0.6), GraphWeights(0.0, 0.0, 1.0)], SMALL))
    assert [r.config.alpha for r in runs] == [0.1, 0.0] and runs[0].chunks is runs[1].chunks
    assert all(r.summaries.count() == 3 for r in runs)


def test_command_line(spark, tmp_path):
    from docloom import cli

    for c in ("cluster_1", "cluster_2"):
        d = tmp_path / "clusters" / c
        d.mkdir(parents=True)
        (d / "a.body.txt").write_text("Mưa lớn ở Huế. Nước dâng 5 %. Dân rời đi.")
        (d / f"{c}.ref1.txt").write_text("Mưa lớn. Dân rời đi.")
    out, total = str(tmp_path / "out"), str(tmp_path / "total")
    args = ["run", "--dataset", "vn_mds", "--data-root", str(tmp_path), "--output", out, "--aggregate-output", total, "--chunking", "simple", "--env-file", "none"]
    assert cli.main(args) == 0
    rows = tables.read_results(spark, [out])
    assert rows.count() == 2 and float(rows.first()["rouge1"]) > 0
    from docloom.plans.results import COLUMNS

    assert set(rows.columns) == set(COLUMNS) and len(COLUMNS) == 44
    assert float(rows.first()["runtime_seconds"]) > 0 and rows.first()["dedup_sim_threshold"] == "0.88"
    assert cli.main(["aggregate", out, "--output", str(tmp_path / "again")]) == 0
    # runs with different settings aren't averaged together
    other, both = str(tmp_path / "other"), str(tmp_path / "both")
    assert cli.main([*args[:5], "--output", other, "--chunking", "simple", "--env-file", "none", "--dedup-threshold", "0.7", "--semantic-percentile", "40"]) == 0
    assert cli.main(["aggregate", out, other, "--output", both]) == 0
    means = tables.read_results(spark, [both])
    assert {(r["dedup_sim_threshold"], r["n"]) for r in means.collect()} == {("0.88", "2"), ("0.7", "2")}
    direct, failures = str(tmp_path / "direct"), str(tmp_path / "failures")
    assert cli.main([*args[:5], "--direct", "--output", direct, "--failures", failures, "--print-rows", "--env-file", "none"]) == 0
    row = tables.read_results(spark, [direct]).first()
    assert row["run_mode"] == "pure_llm" and row["alpha"] is None and row["embedding_model"] == "none"
    for path in (total, str(tmp_path / "again")):
        assert tables.read_results(spark, [path]).first()["n"] == "2"


def test_bio_tags():
    from docloom.operators.recognise import TaggedRecogniser, decode_bio

    tags = [("Hà", "B-LOC"), ("Nội", "I-LOC"), ("có", "O"), ("x", "I-PER"), ("An", "B-PER"), ("Bình", "B-PER"), ("Ba", "I-ORG"), ("y", None), ("Z", "B-")]
    assert decode_bio(tags) == [("Hà Nội", "loc"), ("An", "per"), ("Bình Ba", "per"), ("Z", "entity")]
    assert decode_bio([]) == []
    assert TaggedRecogniser(lambda t: [(w, "N", "B-X") for w in t.split()]).entities("a b") == [("a", "x"), ("b", "x")]


def test_recognisers_by_language(spark):
    from docloom.operators import phrases
    from docloom.operators.recognise import type_family

    class Upper:
        def entities(self, text):
            return [(w, "person") for w in text.split() if w.isupper()]

    rows = [(1, "vi", "ANNA met Bob Hope on 1999"), (2, "fr", "ANNA met Bob Hope"), (3, "vi", None), (4, None, "Bob Hope")]
    docs = spark.createDataFrame(rows, "id long, lang string, text string")
    got = {tuple(r) for r in phrases.extract(docs, ["id"], "text", "lang", {"vi": Upper}).collect()}
    assert got == {(1, "person", "ANNA"), (1, "date", "1999"), (2, "entity", "ANNA"), (2, "entity", "Bob Hope"), (4, "entity", "Bob Hope")}
    kinds = spark.createDataFrame([(k,) for k in ("PER", "organization", "gpe", "money", "thing")], "k string")
    assert [r[0] for r in kinds.select(type_family(F.col("k"))).collect()] == ["person", "org", "location", "money", "entity"]


def test_row_numbers(spark):
    rows = spark.range(0, 57, 1, 5).withColumnRenamed("id", "x")
    got = clusters.with_row_number(rows, "n").collect()
    assert len(got) == 57 and all(r["n"] == r["x"] for r in got)
    assert clusters.with_row_number(rows.limit(0), "n").count() == 0


def test_direct_trace_and_edge_dot(spark):
    from docloom.plans import trace

    docs = small_docs(spark)
    done, asked = pipeline.direct(docs, SMALL), pipeline.direct_prompts(docs, SMALL)
    out = trace.trace_direct(done, asked)
    assert {r["step_type"] for r in out["summary_steps"].collect()} == {"direct"}
    assert {r["kind"] for r in out["summary_graph_nodes"].collect()} == {"direct_llm", "final"}
    edges = spark.createDataFrame([("s", 'a"b', "c", 0.5, 0.25)], "sample_id string, source string, target string, weight double, position double")
    text = trace.edge_dot(edges).first()["dot"]
    assert '"a\\"b" -- "c" [label="weight=0.500\\nposition=0.250"];' in text
