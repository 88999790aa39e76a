import corpus_pipeline
from conductlens.llm.toxicity import score_toxicity
from corpus_pipeline import drop_near_duplicates
from test_operators import DOCS, corpus, prose, rows

import random

import brute


def test_stages(spark, tmp_path):
    rng = random.Random(20)
    texts = corpus(21, 60, lines=True)
    toxic = [(2000 + k, prose(rng, 30) + " moron scum " + prose(rng, 5) + " moron") for k in range(60)]
    table = [(i, t, "en", f"src{i % 4}", len(t) if t is not None else None) for i, t in texts + toxic]
    spark.createDataFrame(table, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i >= 2000)) for i, *_ in table]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf_dir = str(tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, apply in corpus_pipeline.STAGES:
        before = rows(docs)
        docs = corpus_pipeline.stage(apply(spark, docs, sf_dir))
        after = rows(docs)
        kept[name] = after
        if name == "toxicity":
            said = {r["doc_id"]: r["predicted"] for r in rows(score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))}
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not said[r["doc_id"]])
            assert sum(r["doc_id"] >= 2000 for r in after) <= 3 and sum(r["doc_id"] < 2000 for r in after) >= len(texts) - 3
        if name == "line_dedup":
            gone, _ = brute.line_copies([(r["doc_id"], r["text"]) for r in before], 5)
            want = {}
            for r in before:
                t = r["text"]
                cut = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[r["doc_id"]])
                if cut == t or (cut or "").strip(" "):
                    want[r["doc_id"]] = cut
            assert {r["doc_id"]: r["text"] for r in after} == want
        if name == "near_dedup":
            groups = brute.near([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in groups.items() if c == i)
        if name == "mixing":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        if name != "sentencepiece":
            assert docs.columns == DOCS_COLUMNS
    assert all(r["round_trip"] for r in kept["sentencepiece"]) and len(kept["sentencepiece"]) == len(kept["mixing"])
    assert docs.columns == corpus_pipeline.run(spark, sf_dir).columns


DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_duplicates_are_dropped_by_row(spark):
    rng = random.Random(31)
    words = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    a, b, c, d = words(), words(), words(), words()
    near = lambda t: " ".join([*t[:-1], "other"])
    texts = [(1, " ".join(a)), (5, near(a)), (5, " ".join(b)), (7, near(b)), (None, near(a)), (None, " ".join(c)), (None, near(c)), (9, " ".join(d))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    left = {(r["doc_id"], r["text"]) for r in rows(drop_near_duplicates(spark, docs, ""))}
    nameless = [t for i, t in left if i is None]
    assert {x for x in left if x[0] is not None} == {(1, " ".join(a)), (5, " ".join(b)), (9, " ".join(d))}
    assert len(nameless) == 1 and nameless[0] in (" ".join(c), near(c))


def _run(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stage(apply(spark, docs, str(folder)))
        yield name, before, docs


def test_clashing_columns_null_ids_and_repeated_rows_go_through(spark, tmp_path):
    """Columns that share a name with the stages' own keep their values; rows without id, repeated rows, null, empty and long texts pass."""
    rng = random.Random(7)
    texts = [(k, prose(rng, 40)) for k in range(30)] + [(None, prose(rng, 30)), (None, prose(rng, 30)), (50, None), (51, ""), (52, prose(rng, 8_000))]
    own = ["_key", "key", "k", "i", "n", "copy", "n_lines", "n_removed", "copies", "others", "_none", "a.b"]
    table = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), *[f"{c} of {i}" for c in own]) for i, t in [*texts, *texts[:4]]]
    columns = ", ".join(f"`{c}` string" for c in own)
    docs = spark.createDataFrame(table, f"doc_id long, text string, lang string, source string, n_chars long, {columns}")
    for name, before, after in _run(spark, tmp_path, docs):
        if name == "sentencepiece":
            assert after.where("not round_trip").count() == 0 and after.count() == before.count() > 0
            continue
        assert after.columns == docs.columns and after.count() > 0
        for r in after.select("doc_id", *[f"`{c}`" for c in own]).collect():
            assert list(r)[1:] == [f"{c} of {r[0]}" for c in own], name
        if name == "near_dedup":
            assert after.count() == after.select("doc_id", "text").distinct().count() == len(texts)


def test_empty_table(spark, tmp_path):
    kept = list(_run(spark, tmp_path, spark.createDataFrame([], DOCS)))
    assert all(after.count() == 0 for _, _, after in kept)
    assert all(after.columns == before.columns for name, before, after in kept if name != "sentencepiece")
