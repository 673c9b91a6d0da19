"""The corpus pipeline's stages on a small corpus."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_text_operators import DOCS, WORD, some_docs

from contestlab.llm import common, jaccard


def test_stages(spark, tmp_path):
    rows = [r if len(WORD.findall(r[1] or "")) > 40 else (r[0], f"{r[1] or ''} " + " ".join(f"wort{r[0]}x{k}" for k in range(60)), *r[2:]) for r in some_docs(60)]
    (tmp_path / "d").mkdir()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "d/documents.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "d/documents.parquet")), DOCS.replace(" long", "").replace(" string", "").split(", ")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path / "d"))
        out.write.parquet(str(tmp_path / f"{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"{k}"))
        if k < 4:
            assert docs.columns == columns, name
            assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
        if name == "jaccard_join":
            keep = {r.component_id for r in jaccard.near_classes(before).collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(keep)
    assert docs.count() > 0 and {"sequence_id", "offset", "piece"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path / "d")).count() == docs.count()


def test_empty_corpus(spark, tmp_path):
    (tmp_path / "e").mkdir()
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0


def test_odd_rows_and_names(spark, tmp_path):
    """Nulls in any column, repeated rows and keys, and extra columns named like those that the stages make."""
    words = [f"wort{k % 97}x{k % 13}" for k in range(70)]
    rows = [(i, " ".join(words[i:] + [f"ende{i}"] * 3 + words[:i]), "de", f"s{i % 3}") for i in range(40)]
    rows += [rows[3], rows[3], (3, rows[5][1], "de", "s1"), (None, rows[7][1] + " null", "de", None), (None, rows[7][1] + " null", "de", None), (90, None, None, None), (91, "", "de", "s1"), (92, "zu kurz", "de", "s2"), (93, rows[9][1], None, "s0")]
    extra = "size long, repeats long, kept boolean, quality double, __row long, __own string, lang_pred string, n_words long, __once int, bin long, pattern string"
    names = [f.split()[0] for f in extra.split(", ")]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 7, 8, True, 0.5, 9, "own", "xx", 10, 11, 12, "pat") for r in rows], f"{DOCS.replace(', n_chars long', '')}, n_chars long, {extra}")
    out = df
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}")
        stage(spark, out, "").write.parquet(path)
        before, out = out, spark.read.parquet(path)
        if k < 4:
            assert out.columns == df.columns, name
            assert {tuple(r[c] for c in names) for r in out.collect()} <= {(7, 8, True, 0.5, 9, "own", "xx", 10, 11, 12, "pat")}, name
        if name == "quality_rules":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in out.collect()} <= {90, 91, 92}
        if name == "jaccard_join":
            assert out.where("doc_id is null").count() <= 1 and out.groupBy("doc_id", "text").count().where("count > 1").count() == 0
    assert out.count() > 0


def test_texts_that_stay_are_not_shuffled(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(60)] + [(100 + i, " ".join(f"w{i}x{k}" for k in range(30)) + " end") for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    parts = []
    monkeypatch.setattr(jaccard, "by_listing", lambda *a: parts.append(common.by_listing(*a)) or parts[-1])
    kept = jaccard.keep_one(spark.read.parquet(str(tmp_path / "d")))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    hits, rest = parts[0]
    assert "Exchange" not in rest._jdf.queryExecution().executedPlan().toString()
    assert 5 <= hits.count() < 20 and hits.count() + rest.count() == 65


def test_listing_misses_nothing(spark):
    listed = spark.range(0, 30_000, 3).select(F.xxhash64("id").alias("h"))
    hits, rest = common.by_listing(spark.range(60_000).select("id", F.xxhash64("id").alias("h")), listed, "h")
    assert rest.where("id < 30000 and id % 3 = 0").count() == 0 and 10_000 <= hits.count() < 12_000
    assert common.by_listing(listed, listed.limit(0), "h")[0] is None
