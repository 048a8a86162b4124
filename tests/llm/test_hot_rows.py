"""Rows that repeat, in running sums, samples and the tables that a run makes."""

from collections import Counter
from threading import Thread

import pytest
from pyspark.sql import functions as F

from tilefabric import tables
from tilefabric.llm import langid, mixing, packing, quality, shared

DOCS = "doc_id long, text string, lang string, source string"


def test_copies_are_one_row_of_the_sums(spark, monkeypatch):
    data = [("a", None, "", 2)] * 10_000 + [("a", k, f"t{k}", k % 5) for k in range(3_000)] + [("b", 1, "x", 1)] * 3
    df = spark.createDataFrame(data, "src string, doc_id long, text_hash string, size int").repartition(6)
    seen = []
    monkeypatch.setattr(shared, "written", lambda t: seen.append(t) or tables.written(t))
    out = shared.running_start(df, ["src"], F.col("size").cast("long"), ["doc_id", "text_hash", "size"], "start", len(data), 50)
    got = sorted((r["src"], r["start"], r["size"]) for r in out.collect() if r["size"])
    assert len(got) == sum(s > 0 for *_, s in data) and out.count() == len(data)
    at = Counter()
    for src, start, size in got:  # the spans stand end to end
        assert start == at[src]
        at[src] += size
    assert Counter((r["src"], r["doc_id"], r["text_hash"], r["size"]) for r in out.collect()) == Counter(data)
    # A task's window sees distinct rows: no bucket of the sums holds the copies.
    buckets = seen[0].withColumn("b", F.pmod(F.xxhash64("doc_id", "text_hash", "size"), F.lit(len(data) // 50 + 1))).groupBy("src", "b").count()
    assert buckets.agg(F.max("count")).first()[0] < 60


def test_mix_and_packing_of_thousands_of_equal_rows(spark):
    docs = spark.createDataFrame([(None, "", "en", "a")] * 6_000 + [(None, "three equal words", "en", "a")] * 6_000 + [(k, f"own words {k}", "en", "b") for k in range(200)], DOCS).repartition(8)
    got = mixing.op1(docs).agg(F.count("*"), F.sum("size"), F.sum("taken"), F.max(F.col("taken") - 3 * F.col("size"))).first()
    assert got[0] == 12_200 and got[1] == 18_600 and abs(got[2] - 18_600) <= 3 * mixing.BLOCK and got[3] <= 0
    packed = packing.op9(docs).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at")).collect()
    assert sum(len(r["at"]) for r in packed) == 12_200
    for r in packed:
        to = 0
        for p in r["at"]:
            assert p["offset"] == to
            to += p["length"]
        assert to == r["n"] <= packing.CAPACITY


def test_one_row_a_million_times_does_not_crowd_out_a_language(spark):
    data = [(1, "the same old text of one language", "en", "a")] * 4_000 + [(k, f"wort {k} auf deutsch und mehr davon", "de", "a") for k in range(300)] + [(10_000 + k, f"some more english words {k}", "en", "a") for k in range(300)]
    model = langid.train(spark.createDataFrame(data, DOCS).repartition(5))
    assert model.languages == ["de", "en"] and len(model.landmarks) == langid.LANDMARKS
    assert len({row.tobytes() for row in model.landmarks}) > 150  # not the same row again and again


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    docs = spark.createDataFrame([(k, "text", f"l{k % 4}", "a") for k in range(100)], DOCS)
    with pytest.raises(ValueError, match="at most 3"):
        langid.train(docs)


def test_passages_are_bounded_before_features(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLED", 120)
    docs = spark.createDataFrame([(k, ("good words here " if k % 2 else "!!! $$$ ### ") * 400, "en", "a") for k in range(60)] + [(61, "short text", "en", "a")] * 50, DOCS).repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(62)], "doc_id long, quality int")
    made = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, many, y: made.append(many) or fit(x, many, y))
    quality.train(docs, labels)
    assert made and 40 <= made[0].sum() <= 120


def test_a_run_drops_its_own_tables_alone(spark):
    df, others = spark.range(3).toDF("x"), []

    def elsewhere():
        others.append(tables.written(df))

    with tables.own_tables() as own:
        tables.written(df)
        t = Thread(target=elsewhere)
        t.start()
        t.join()
        kept = tables.written(df)
        tables.drop_written(spark, own[-1:], own)
    assert len(own) == 2 and others[0].count() == 3 and kept.count() == 3
    assert own[0] not in tables.made(spark) and own[1] in tables.made(spark)
