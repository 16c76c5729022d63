"""The stages of the corpus pipeline against brute force, on odd inputs, and in a row."""

import random

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from gustline.llm import decontaminate, quality_classifier
from gustline.llm.packing import cuts
from .test_llm import brute_components, brute_pii, ids_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, `a.b` int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents, labels and benchmark, and what each document is."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    good = lambda n=80: " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(n))
    items = [" ".join(word() for _ in range(30)) for _ in range(6)]
    texts, kind = [], {}
    for i in range(400):
        k = ("junk" if i % 5 == 0 else "leak" if i % 29 == 1 else "pii" if i % 31 == 2 else "plain")
        t = " ".join(w + "$$$ |" for w in good().split()) if k == "junk" else good()
        if k == "leak":
            t = good(40) + " " + items[i % 6] + " " + good(40)
        if k == "pii":
            t = t + " mail a.b@c.org from 10.0.0.7"
        kind[i] = k
        texts.append(t)
    for i in (3, 4, 8):  # copies: exact, near, and of a leak
        kind[len(texts)] = "copy"
        texts.append(texts[i] if i != 4 else texts[i].replace(texts[i].split()[70], "zzz", 1))
    rows = [(i, t, None if i % 7 == 0 else "en", "s", len(t), "x", 9, 1) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None, None, None, None), (901, "", "en", "s", 0, "x", 1, 2), (None, texts[3], "en", "s", 1, "x", 1, 3), (6, texts[6], "en", "s", len(texts[6]), "x", 9, 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(k != "junk"), 0) for i, k in kind.items() if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (99, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, kind, items


def docs_of(spark, corpus):
    return spark.read.parquet(f"{corpus[0]}/documents.parquet")


def test_quality(spark, corpus):
    docs = docs_of(spark, corpus)
    out = cp.quality(spark, docs, corpus[0])
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    good = {i for i, k in corpus[1].items() if k != "junk"}
    assert len(good & kept) >= 0.97 * len(good) and not {i for i, k in corpus[1].items() if k == "junk"} & kept  # of a fit on 160 texts
    model = quality_classifier.train(docs, spark.read.parquet(f"{corpus[0]}/labels.parquet"))
    want = [r.doc_id for r in docs.collect() if model.score(np.array([quality_classifier.features(r.text or "")]))[0] >= 0.3]
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(want, key=str)
    assert cp.quality(spark, docs.limit(0), corpus[0]).count() == 0


def test_near_dedup(spark, corpus):
    docs = docs_of(spark, corpus)
    out = cp.near_dedup(spark, docs, corpus[0])
    assert out.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    home = brute_components([x for x in rows if x[0] is not None], 5, 80)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((i for i, _ in rows if i is None or home[i] == i), key=str)
    assert cp.near_dedup(spark, docs.limit(0), corpus[0]).count() == 0


def held(text, item):
    """Whether some stretch of the text, twice the item's length, holds three quarters of it in order: every window tried."""
    t, item = decontaminate.normal_words(text or ""), decontaminate.normal_words(item)
    return any(decontaminate.lcs(item, t[i : i + 2 * len(item)]) >= 0.75 * len(item) for i in range(max(1, len(t) - len(item))))


def test_decontamination(spark, corpus):
    docs = docs_of(spark, corpus)
    out = cp.decontamination(spark, docs, corpus[0])
    assert out.columns == docs.columns
    gone = {r.doc_id for r in docs.collect() if r.doc_id is not None and any(held(r.text, x) for x in corpus[2])}
    assert gone >= {i for i, k in corpus[1].items() if k == "leak"}
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((r.doc_id for r in docs.collect() if r.doc_id not in gone), key=str)
    assert cp.decontamination(spark, docs.limit(0), corpus[0]).count() == 0


def test_pii_and_packing(spark, corpus):
    docs = docs_of(spark, corpus)
    out = cp.pii(spark, docs, corpus[0])
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.where("doc_id is not null").join(docs.select(F.col("doc_id").alias("i"), F.col("text").alias("was")).distinct(), F.col("i") == F.col("doc_id")).collect():
        assert not brute_pii(r.text) and (r.text == r.was) == (not brute_pii(r.was)) and r.n_chars == (None if r.text is None else len(r.text))
    pieces = cp.packing(spark, out, corpus[0]).collect()
    want = [(r.doc_id, *c) for r in out.collect() for c in cuts(len(ids_of(r.text)), 1024)]
    assert sorted(((p.doc_id, p.start, p.length) for p in pieces), key=str) == sorted(want, key=str)
    assert cp.pii(spark, docs.limit(0), corpus[0]).count() == cp.packing(spark, docs.limit(0), corpus[0]).count() == 0


def test_all_stages(spark, corpus):
    out = cp.run(spark, corpus[0])
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    plain = {i for i, k in corpus[1].items() if k in ("plain", "pii")}
    assert len(plain & kept) >= 0.97 * len(plain) and not {i for i, k in corpus[1].items() if k in ("junk", "leak")} & kept
    assert all(kept.isdisjoint(x) or len(kept & x) == 1 for x in ({3, 400}, {4, 401}))


def test_settle_collects_the_garbage_of_executors(spark):
    from types import SimpleNamespace

    from gustline.llm.common import settle

    sc, ran = spark.sparkContext, []
    beans = sc._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans)
    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", defaultParallelism=3, _jvm=SimpleNamespace(System=SimpleNamespace(gc=lambda: None))), range=lambda *a: ran.append(a) or spark.range(*a))
    before = count()
    settle(far)
    assert ran == [(0, 3, 1, 3)] and count() > before
    near = SimpleNamespace(sparkContext=SimpleNamespace(master="local[4]", _jvm=far.sparkContext._jvm), range=far.range)
    settle(near)
    assert len(ran) == 1
