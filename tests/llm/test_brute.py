"""Scores, draws and the whole pipeline against plain-Python versions; scale, awkward texts and resuming."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tilefabric import tables
from tilefabric.llm import embedding_dedup, exact_dedup, langid, mixing, packing, quality, sharding, simhash, token_output, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))


def rows():
    rng = random.Random(21)
    out = [(k, " ".join(word(rng) for _ in range(rng.randint(1, 900))) + rng.choice(["", " ", "\n"]), "en", ["a", "b", None, "", "c"][k % 5], 1) for k in range(150)]
    out += [(200, None, "en", "a", 1), (201, "", None, "z", 0), (None, "no id", "en", "b", 5), (None, out[3][1], "en", "b", 5), (7, "other text of seven", "en", "c", 1), out[4], out[4]]
    out += [(300 + k, out[9][1], "en", "c", 1) for k in range(20)]
    return out


def test_every_document_is_taken_as_in_plain_python(spark):
    data = rows()
    size, target, docs, passes = brute.mix([(r[0], r[1], r[3]) for r in data])
    want = Counter((r[0], len(w), size[r[3]], round(target[r[3]], 6), sum(hi - lo for p in got.values() for lo, hi in p)) for r, w, got in zip(data, docs, passes, strict=True))
    got = mixing.op1(spark.createDataFrame(data, DOCS).repartition(4)).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == want


def test_many_languages_score_as_in_plain_python(spark):
    rng = random.Random(22)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:02d}": rng.sample(letters, 4) + [chr(0x400 + k)] for k in range(70)}
    data = [(k, "  ".join("".join(rng.choice(abc) for _ in range(5)) for _ in range(20)), lang) for k, (lang, abc) in enumerate(list(own.items()) * 6)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(df, 3, 210)
    assert model.languages == sorted(own) and model.landmarks.shape[0] == 192 and model.weights.shape == (192, 70)
    # The kernel of every text with every landmark, by sets, and the linear map behind it.
    marks = [{b for b in range(langid.BUCKETS) if model.column[b] >= 0 and row[model.column[b]] > 0} for row in model.landmarks]
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    for doc, text, _ in data[::7]:
        grams = brute.spectrum(text)
        k = np.array([len(grams & m) / np.sqrt(len(grams) * len(m)) for m in marks])
        s = k @ model.weights
        assert got[doc]["lang_pred"] == model.languages[int(s.argmax())] and got[doc]["score"] == pytest.approx(np.clip((s.max() + 1) / 2, 0, 1), abs=1e-4)
    assert np.mean([got[d]["lang_pred"] == lang for d, _, lang in data]) > 0.95


def test_kernel_ridge_in_plain_python():
    rng = random.Random(23)
    texts = ["".join(rng.choice("abcdef" if k % 2 else "defghi") for _ in range(40)) for k in range(30)]
    grams = [brute.spectrum(t) for t in texts]
    model = langid.fit(["x", "y"], np.arange(30) % 2, [np.array(sorted(g)) for g in grams], 12)
    assert len(langid.fit(["x", "y"], np.arange(30) % 2, [np.array(sorted(g)) for g in grams], 1).landmarks) == 2
    chosen = range(12)  # languages alternate, so landmarks are the first ones
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    mm = np.array([[kernel(grams[i], grams[j]) for j in chosen] for i in chosen])
    xm = np.array([[kernel(g, grams[j]) for j in chosen] for g in grams])
    values, vectors = np.linalg.eigh(mm)
    root = vectors / np.sqrt(values)
    f = xm @ root
    y = np.where(np.arange(30)[:, None] % 2 == [[0, 1]], 1.0, -1.0)
    alpha = np.linalg.solve(f.T @ f / 15 + langid.RIDGE / 2 * np.eye(12), f.T @ y / 15)
    assert np.allclose(model.scores([np.array(sorted(g)) for g in grams]), f @ alpha, atol=1e-4)


def test_quality_scores_as_in_plain_python(spark):
    rng = random.Random(24)
    text = lambda good: " ".join(word(rng) + ("" if good else rng.choice(["###", "%%", " 1 1 1"])) for _ in range(rng.randint(0, 400)))
    data = [(k, text(k % 3 > 0)) for k in range(120)] + [(500, None), (501, ""), (502, " \t\n"), (503, "é ü \x01 \x7f" * 200), (None, "no id")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(120)], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = {r["doc_id"]: r for r in quality.op5(df, labels).collect()}
    for doc, t in data:
        want = brute.score(model, t)
        assert got[doc]["score"] == pytest.approx(want, abs=1e-4) and (abs(want - 0.3) < 1e-3 or got[doc]["predicted"] == int(want >= 0.3))
    kept = Counter((r["doc_id"], r["text"]) for r in quality.keep_good(df, labels).collect())
    assert kept == Counter((d, t) for d, t in data if brute.score(model, t) >= 0.3) and len(kept) < len(data)


def simhash_print(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    set_in = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=int)
    return sum(int(2 * n > len(h)) << b for b, n in enumerate(set_in))


def test_pipeline_is_its_plain_python_version(spark, tmp_path):
    rng = random.Random(25)
    data = rows()
    data += [(600 + k, " ".join(word(rng) + rng.choice(["###", "%%", "&&"]) for _ in range(rng.randint(30, 300))), "en", "a", 1) for k in range(60)]
    base = data[20][1].split() * 5
    data += [(700, " ".join(base), "en", "a", 1), (701, " ".join([*base[:-1], "other"]), "en", "b", 1)]
    df = spark.createDataFrame(data, DOCS).repartition(5)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(k, 1) for k in range(150)] + [(600 + k, 0) for k in range(60)] + [(None, 1)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = quality.train(spark.read.parquet(str(tmp_path / "documents.parquet")), labels)
    step = [(r[0], r[1], r[3]) for r in data if brute.score(model, r[1]) >= quality.THRESHOLD]
    assert 0 < len(data) - len(step) < 90
    best = {}
    for r in step:  # exact copies: the largest id stays
        have = best.get(r[1] or "")
        best[r[1] or ""] = r if have is None or (r[0] is not None, r[0] or 0) > (have[0] is not None, have[0] or 0) else have
    step = list(best.values())
    prints = [simhash_print(r[1]) for r in step]
    near = list(range(len(step)))
    for i in range(len(step)):  # classes by flooding
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and near[i] != near[j]:
                near = [near[j] if x == near[i] else x for x in near]
    classes = defaultdict(list)
    for c, r in zip(near, step, strict=True):
        classes[c].append(r)
    step = [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()]
    assert len(step) < len(best)
    _, _, docs, passes = brute.mix(step)
    want = Counter()
    for r, words, got in zip(step, docs, passes, strict=True):
        runs = mixing_runs(r[1] or "")
        for taken in got.values():
            whole = sum(hi - lo for lo, hi in taken) == len(words)
            want += brute.cut_pieces(r[0], r[1] if whole else "".join(runs[k] for lo, hi in taken for k in range(lo, hi)))
    before = tables.made(spark)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    loads = Counter()
    for r in out:
        loads[r["sequence_id"]] += r["length"]
    assert max(loads.values()) <= 2048 and len(loads) <= -(-sum(loads.values()) // 2048) + 1
    assert len(tables.made(spark)) == len(before) + 1  # only the result's own table is left


def mixing_runs(text):
    """Words with the white space after them."""
    import re

    return re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def compared(n, d=64):
    """Comparisons a vector of random ones, and the recall of pairs at the threshold."""
    rng = np.random.default_rng(26)
    u = rng.normal(size=(n, d))
    u /= np.linalg.norm(u, axis=1)[:, None]
    at = embedding_dedup.level(n)
    c = embedding_dedup.codes(list(u), at)
    met = 0
    for t in range(at.tables):
        homes, many = np.unique(c[:, t, 0], return_counts=True)
        place = np.minimum(np.searchsorted(homes, c[:, t]), len(homes) - 1)
        met += np.where(homes[place] == c[:, t], many[place], 0).sum() - n
    w = rng.normal(size=(4_000, d))
    w -= (w * u[:4_000]).sum(axis=1)[:, None] * u[:4_000]
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = embedding_dedup.codes(list(0.98 * u[:4_000] + np.sqrt(1 - 0.98**2) * w), at)
    found = (v == c[:4_000, :, :1]).any(axis=(1, 2)) | (c[:4_000] == v[:, :, :1]).any(axis=(1, 2))
    return met / n, found.mean()


def test_comparisons_stay_bounded_as_vectors_grow():
    few, recall_few = compared(10_000)
    many, recall_many = compared(40_000)
    assert many < 1.5 * few and many < 60 and min(recall_few, recall_many) > 0.999
    for n in (10**6, 10**10):  # finer levels keep their recall; random pairs do not meet there at this size
        rng = np.random.default_rng(27)
        u = rng.normal(size=(1_000, 64))
        u /= np.linalg.norm(u, axis=1)[:, None]
        w = rng.normal(size=u.shape)
        w -= (w * u).sum(axis=1)[:, None] * u
        w /= np.linalg.norm(w, axis=1)[:, None]
        a, b = (embedding_dedup.codes(list(x), embedding_dedup.level(n)) for x in (u, 0.981 * u + np.sqrt(1 - 0.981**2) * w))
        assert ((a == b[:, :, :1]).any(axis=(1, 2)) | (b == a[:, :, :1]).any(axis=(1, 2))).mean() > 0.998


def test_embeddings_at_a_finer_level_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MANY", 1)
    rng = np.random.default_rng(28)
    base = rng.normal(size=(150, 32))
    x = np.float32(np.repeat(base, 4, axis=0) + 0.08 * rng.normal(size=(600, 32)) * rng.random((600, 1)))
    extra = "vec_id long, embedding array<float>, label int, cid long, vec string, t int, n int, root string"
    df = spark.createDataFrame([(i, [float(a) for a in v], i % 2, 1, "v", 2, 3, "r") for i, v in enumerate(x)], extra)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.98) & ((np.arange(600)[:, None] - np.arange(600)) % 2 == 0)
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.op3(df).collect()}
    assert got == {i: int(n) for i, n in enumerate(link.sum(axis=1))} and link.sum() > 100


def test_resuming_after_a_lost_block(spark, tmp_path):
    rng = random.Random(29)
    df = spark.createDataFrame([(k, " ".join(word(rng) for _ in range(rng.randint(1, 900)))) for k in range(90)], "doc_id long, text string")
    seqs = tables.written(token_output.sequences(df).withColumn("rid", F.monotonically_increasing_id()))
    n = seqs.count()
    placed = tables.written(token_output.ordered(seqs, n, per_shard=32))
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    token_output.write_blocks(placed, whole, per_block=8, rows=n, per_shard=32)
    spark.read.parquet(whole).where("not (shard = 1 and block = 2)").write.parquet(broken)
    lost = placed.where("shard = 1 and record >= 16 and record < 24")
    token_output.write_blocks(lost, broken, per_block=8, rows=n, per_shard=32, mode="append")
    after = token_output.read_from(spark, broken, 45, 32, 8)
    assert after.first()["block"] == 1 and [tuple(r) for r in after.collect()] == [tuple(r) for r in token_output.read_from(spark, whole, 45, 32, 8).collect()]
    token_output.write_blocks(placed.limit(0), str(tmp_path / "none"), rows=0)
    assert spark.read.schema(after.schema).parquet(str(tmp_path / "none")).count() == 0


def test_shards_are_written_whole_and_own_columns_stay(spark, tmp_path):
    df = spark.createDataFrame([(k % 50, "mine", k) for k in range(400)], "key long, slot string, shard int")
    placed = sharding.place(df, "key")
    assert placed.columns == ["key", "slot", "shard", "slot_", "shard_"]
    assert Counter(tuple(r)[:3] for r in placed.collect()) == Counter(map(tuple, df.collect()))
    sharding.write_shards(df, "key", str(tmp_path / "s"), rows_per_file=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["key"], r["slot"], r["shard"], r["shard_"]) for r in back.collect()) == Counter((r["key"], r["slot"], r["shard"], r["shard_"]) for r in placed.collect())


def test_nested_rules_go_by_their_whole_length(spark):
    rules = [("block", "com", "/en/verylongsegment"), ("allow", "example.com", "/en/"), ("block", "example.com", "/en/x"), ("allow", "b.example.com", ""), ("block", "com", ""), ("allow", "com", "/en/verylong"), ("block", "a.com", "/x"), ("allow", "com", "/x/y"), ("allow", "q.com", "/p"), ("block", "q.com", "/p")]
    urls = ["http://example.com/en/verylongsegment/x", "http://example.com/en/verylong", "http://example.com/en/xy", "http://b.example.com/en", "http://c.com", "http://c.com/en/verylongs", "http://a.com/x/y", "http://q.com/pp", "http://other.org/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    for k, u in enumerate(urls):
        host, path = u[7:].partition("/")[0], "/" * ("/" in u[7:]) + u[7:].partition("/")[2]
        fits = [(len(h + p), len(h), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[k] == (max(fits)[3:] if fits else (None, "allow"))
    with pytest.raises(ValueError, match="rules"):
        url_filter.build(rules, 3)


def test_texts_of_several_megabytes(spark):
    rng = random.Random(30)
    long = " ".join(word(rng) for _ in range(330_000))
    df = spark.createDataFrame([(1, long, "en", "a"), (2, long, "en", "a"), (3, "x" * 1_000_000, "en", "b"), (4, long + " end", "fr", "b"), (5, "short one", "fr", None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 6)], "doc_id long, quality int")
    assert len(long) > 2_000_000
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.op2(df).collect()} == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}
    got = {r["doc_id"]: r for r in simhash.op6(df).collect()}
    assert all(got[k]["fingerprint"] == f"{simhash_print(t):016x}" for k, t in ((1, long), (3, "x" * 1_000_000), (5, "short one"))) and got[2]["component_id"] == 1
    model = quality.train(df, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.op5(df, labels).collect()}
    assert scores[1] == scores[2] == pytest.approx(brute.score(model, long), abs=1e-3) and scores[5] == pytest.approx(brute.score(model, "short one"), abs=1e-3)
    assert langid.op4(df).count() == mixing.op1(df).count() == sharding.op7(df).count() == 5
    want = brute.cut_pieces(1, long)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.op9(df.where("doc_id = 1")).collect()) == want
    raw = np.array([*brute.token_ids(long), token_output.END], "<u2")
    assert Counter((r["piece"], r["ids_crc32"]) for r in token_output.op8(df.where("doc_id = 1")).collect()) == Counter((k, zlib.crc32(raw[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(raw), 2048)))


def test_tables_are_dropped_and_clusters_need_a_folder(spark, tmp_path):
    kept, gone = tables.written(spark.range(3)), tables.written(spark.range(4))
    paths = tables.made(spark)[-2:]
    tables.drop_written(spark, set(tables.made(spark)) - {paths[1]})
    assert kept.count() == 3 and paths[0] in tables.made(spark) and paths[1] not in tables.made(spark)
    with pytest.raises(Exception, match="(?i)not.exist|no such"):
        gone.count()

    class Cluster:
        class conf:
            get = staticmethod(lambda name, other=None: other)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        tables.shared_dir(Cluster)
