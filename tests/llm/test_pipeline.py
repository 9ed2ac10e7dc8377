"""The pipeline's stages against plain versions of their decisions."""

import random
import sys
from pathlib import Path

import pytest
from conftest import DATA
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from noticeengine.llm import near_texts  # noqa: E402
from noticeengine.session import ship  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    ship(spark)
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1])
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontaminate", "secret_scan", "mix_sources"]


def test_toxic_and_low_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = stages[0].join(labels, "doc_id")
    good = labels.filter("quality = 1 AND toxic = 0").count()
    assert left.filter("quality = 1 AND toxic = 0").count() > 0.85 * good
    assert left.filter("quality = 0").count() < 0.1 * labels.filter("quality = 0").count()


def test_one_of_each_group_stays(stages):
    group = plain.near_groups([(r["doc_id"], r["text"]) for r in stages[0].collect()])
    assert {r["doc_id"] for r in stages[1].collect()} == set(group.values())


def test_leaks_go(spark, stages):
    """A document goes if any run of its words is a window of an item."""
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = plain.ALNUM.findall((r["text"] or "").translate(plain.LOWER))
        windows |= {tuple(own[i : i + 10]) for i in range(max(1, len(own) - 9))} if own else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        own = plain.ALNUM.findall((text or "").translate(plain.LOWER))
        return not any(tuple(own[i : i + n]) in windows for n in sizes for i in range(len(own) - n + 1))

    assert {r["doc_id"] for r in stages[2].collect()} == {r["doc_id"] for r in stages[1].collect() if clean(r["text"])}


def test_secrets_are_hidden(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    none = plain.base_secrets("")
    assert all(plain.base_secrets(r["text"]) == none and r["n_chars"] == len(r["text"]) for r in after.values())
    assert any(r["text"] != before[d]["text"] for d, r in after.items())


def test_mix_meets_its_targets(stages):
    for r in stages[4].groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("aim")).collect():
        assert r["t"] == int(r["aim"])


def test_run_is_its_stages(spark, stages):
    got = pipeline.run(spark, SF).select("doc_id", "taken")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[4].select("doc_id", "taken").collect()))


def test_awkward_rows_pass(spark):
    ship(spark)
    text = " ".join(f"word{i} thing" for i in range(60))
    rows = [(None, None), (1, None), (2, ""), (3, text), (3, text), (4, text + " x"), (5, "short"), (6, "lorem ipsum " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("kept", "spans", "items", "key", "n_words", "tail_prob", "__text"):
        docs = docs.withColumn(name, F.lit(name))
    docs = docs.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for name, f in pipeline.STAGES:
        out = f(spark, docs, str(DATA))
        assert out.count() <= len(rows)
        assert f(spark, docs.limit(0), str(DATA)).count() == 0
    kept = near_texts.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [3, 3, 5, 6]


def test_near_copies_of_many_sizes(spark):
    ship(spark)
    words = [f"w{i * 7919 % 10007}" for i in range(400)]
    docs = []
    for i in range(40):
        own = list(words)
        for j in range(i % 4):
            own[(37 * i + 90 * j) % 400] = f"edit{i}"
        docs.append((i, " ".join(own)))
    docs += [(100 + i, " ".join(f"other{i}x{j}" for j in range(50))) for i in range(20)]
    got = {r["doc_id"] for r in near_texts.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == set(plain.near_groups(docs).values())


def test_near_copies_cut_appended_and_replaced(spark):
    ship(spark)
    rng, docs = random.Random(7), []
    for i in range(80):
        own = [f"v{rng.randrange(5000)}" for _ in range(200)]
        other = [f"v{rng.randrange(5000)}" for _ in range(50)]
        copies = [own, own[: rng.randrange(158, 172)], own + other[: rng.randrange(35, 50)], own[:90] + other[: (n := rng.randrange(12, 22))] + own[90 + n :]]
        rng.shuffle(copies)
        docs += [(4 * i + j, " ".join(c)) for j, c in enumerate(copies)]
    got = {r["doc_id"] for r in near_texts.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == set(plain.near_groups(docs).values())


def test_unlike_texts_stay(spark):
    """Words of two letters in the order in which polynomial hashes modulo a power of two are equal."""
    ship(spark)
    signs = [bin(i).count("1") & 1 for i in range(4096)]
    docs = [(1, "".join("ab"[x] for x in signs)), (2, "".join("ba"[x] for x in signs)), (3, " ".join("ab"[x] for x in signs)), (4, " ".join("ba"[x] for x in signs))]
    got = {r["doc_id"] for r in near_texts.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == set(plain.near_groups(docs).values()) and {1, 2} <= got


def test_ids_of_other_types(spark):
    ship(spark)
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([("a", text), ("b", text), ("c", "other words here")], "doc_id string, text string")
    got = {r["doc_id"] for r in near_texts.keep_one(docs).collect()}
    assert len(got) == 2 and "c" in got
