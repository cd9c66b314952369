"""The pipeline's stages against what each must do with its own input."""

import random
from collections import Counter

import corpus_pipeline
from quillgraph.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], sf), "test"))
    raw, good, unique, cut, mixed, packed = seen
    assert all(x.columns == docs.columns for x in seen[:5])
    assert 0 < good.count() < raw.count() and good.exceptAll(raw).count() == 0
    assert unique.exceptAll(good).count() == 0 and unique.count() <= good.count()
    assert unique.select("text").distinct().count() == unique.count()
    assert cut.select("doc_id").exceptAll(unique.select("doc_id")).count() == 0 and cut.count() == unique.count()
    assert mixed.distinct().exceptAll(cut).count() == 0
    assert mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    assert packed.where("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 1024


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and dict(out.dtypes)["doc_id"] == "bigint"


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "test")
    assert docs.count() == 0


ODD = [
    (None, None, None, None, None), (1, None, "en", "a", None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "b", 4),
    (None, "short", "en", None, 5), (None, "other", "en", None, 5), (7, "w " * 60_000, "de", "a", 120_000), (7, "v" * 100_000, "de", "a", 100_000),
]


def test_odd_documents(spark):
    """Null columns, keys that are null or shared, repeated rows, very long texts, columns with clashing names: each stage alone."""
    rng = random.Random(31)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(n))
    clean = [(100 + i, text(rng.randint(60, 200)), rng.choice(("en", None)), rng.choice(("a", "b", None)), None) for i in range(120)]
    lone = [(key, text(80), "en", "a", 9) for key in (None, None, None, 5, 5, 5)]
    again = [(100, clean[0][1], "en", "a", 1)] * 3 + [(None, clean[1][1], "en", "b", 1)]
    rows = [(*r, "x", 1, None) for r in ODD + clean + lone + again]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string, id int, _h string")
    key = lambda r: str(tuple(r))
    stages = dict(corpus_pipeline.STAGES)
    out = {name: sorted(map(key, stage(spark, docs, "").select(docs.columns).collect())) for name, stage in corpus_pipeline.STAGES[:-1]}
    texts = {name: stages[name](spark, docs, "").select("doc_id", "text").collect() for name in ("quality rules", "MinHash near-dedup", "substring dedup")}
    worded = [r for r in rows if r[1] and r[1].split()]
    kept = Counter((r["doc_id"], r["text"]) for r in texts["quality rules"])
    assert all(t and len(t.split()) >= 50 for _, t in kept) and sum(kept[r[:2]] for r in lone) == len(lone)
    kept = Counter((r["doc_id"], r["text"]) for r in texts["MinHash near-dedup"])
    assert set(t for _, t in kept if t and t.split()) == {r[1] for r in worded} and max(n for (_, t), n in kept.items() if t and t.split()) == 1
    assert sum(n for (_, t), n in kept.items() if not (t and t.split())) == len(rows) - len(worded)
    assert len(texts["substring dedup"]) == len(rows)
    mixed = Counter(out["mixing sources"])
    assert set(mixed) <= set(map(key, rows)) and sum(mixed.values()) > 0
    packed = stages["best-fit packing"](spark, docs, "")
    assert packed.where("piece = 0").count() == len(rows)
