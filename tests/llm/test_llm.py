"""The training-data operators against brute force, on small tables with all the awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import brute
import corpus_pipeline
from tilefabric.llm import embedding_dedup, exact_dedup, langid, mixing, packing, quality, shared, sharding, simhash, token_output, url_filter
from tilefabric.llm.tokens import token_ids as own_ids
from tilefabric.tables import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size int"
BIG = 2**60 + 1


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))


def rows():
    rng = random.Random(3)
    out = [(k, " ".join(word(rng) for _ in range(rng.randint(1, 300))), ["en", "fr", None][k % 3], ["a", "b", None, "c"][k % 4], None, 1.0, k) for k in range(60)]
    out += [(100 + k, out[5][1], "en", "a", 3, None, None) for k in range(40)]  # a hot group
    out += [(200, None, None, None, None, None, None), (201, "", "en", "a", 0, None, None), (202, " \t\n", "en", "a", 0, None, None), (BIG, "Ä ß 123 <|endoftext|>", "en", "b", 5, None, None), (None, "no id here", "en", "b", 5, None, None)]
    out += [out[7], out[7]]  # repeated rows
    out += [(300, " ".join(word(rng) for _ in range(20_000)), "en", "a", None, None, None)]
    near = out[9][1].split() * 4
    out += [(400, " ".join(near), "en", "a", None, None, None), (401, " ".join([*near[:-1], "other"]), "en", "a", None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup(docs, empty):
    got = exact_dedup.op2(docs).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[sha(r[1])].append(r[0])
    assert len(got) == len(rows())
    kept = Counter()
    for r in got:
        g = groups[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (max((x for x in g if x is not None), default=None), len(g))
        if r["kept"]:
            kept[r["text_sha256"]] += 1
            assert r["doc_id"] == r["keep_id"]
    assert kept == dict.fromkeys(groups, 1)
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns and Counter(sha(r["text"]) for r in out.collect()) == kept
    assert exact_dedup.op2(empty).count() == exact_dedup.exact_dedup(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.op1(docs).collect()
    size, source = defaultdict(int), {}
    for r in rows():
        size[r[3]] += len((r[1] or "").encode().split())
        source[r[0]] = r[3]
    want, taken = brute.targets(size), defaultdict(int)
    assert len(got) == len(rows())
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.op1(docs).collect()))
    assert mixing.op1(empty).count() == 0
    out = mixing.mixed(docs, 64)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    assert all(abs(words[s] - want[s]) <= 400 + 0.1 * want[s] for s in want)
    assert mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1009, 4096])
def test_feistel_is_a_permutation(spark, n):
    from pyspark.sql import functions as F

    for key in (1, 2):
        got = [r[0] for r in spark.range(n).select(shared.feistel(F.col("id"), F.lit(n).cast("long"), F.lit(key))).collect()]
        assert sorted(got) == list(range(n))
    assert n < 100 or got != list(range(n))


def brute_print(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def linked_classes(items, link):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if link(a, b):
                root[find(a)] = find(b)
    return {x: find(x) for x in items}


def test_simhash(docs, empty):
    got = simhash.op6(docs).collect()
    prints = [(r[0], brute_print(r[1])) for r in rows()]
    cls = linked_classes(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, p in prints:
        if d is not None:
            least[cls[p]] = min(d, least.get(cls[p], d))
    want = Counter((d, f"{p:016x}", least.get(cls[p])) for d, p in prints)
    assert Counter(map(tuple, got)) == want
    kept = [r["doc_id"] for r in simhash.simhash_dedup(docs).collect()]
    assert sorted(map(str, kept)) == sorted({str(least.get(c)) for c in cls.values()})
    assert simhash.op6(empty).count() == simhash.simhash_dedup(empty).count() == 0


def test_simhash_keeps_one_row_of_each_class_whatever_its_id(spark):
    rng = random.Random(12)
    a, b, *texts = (" ".join(word(rng) for _ in range(60)) for _ in range(8))
    data = [(1, a), (5, a), (5, b), (None, b), *[(None, t) for t in texts], (None, texts[0]), (7, texts[1])]
    out = simhash.simhash_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    want = [(1, a), (5, b), (7, texts[1]), *[(None, t) for t in (texts[0], *texts[2:])]]
    assert Counter(map(tuple, out)) == Counter(want)


def test_anchors_cover_every_near_pair():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    row, anchor, excess = simhash.anchors(x.view(np.int64))
    home = dict(zip(row[excess == 0].tolist(), anchor[excess == 0].tolist()))
    assert sorted(home) == list(range(300))
    for k in range(300):
        i, j = rng.choice(64, 2, replace=False)
        y = np.array([x[k] ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j))], np.uint64)
        assert home[k] in simhash.anchors(y.view(np.int64))[1]


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 64))
    vec = [(int(i), [float(x) for x in base[i % 12] + 0.02 * (i % 7) * rng.normal(size=64)], int(i % 12 // 4)) for i in range(240)]
    vec += [(500 + i, vec[3][1], vec[3][2]) for i in range(30)]
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None] + [1.0] * 63, 1), (904, vec[0][1], None), (905, [], 1), (906, [1.0, 0.0], 1), (907, [2.0, 0.0], 1)]
    df = spark.createDataFrame(vec + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.op3(df).collect()}
    x = np.array([np.float32(v[1]) for v in vec], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([v[2] for v in vec])
    links = (x @ x.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(links, False)
    cls = linked_classes(list(range(len(vec))), lambda a, b: links[a, b])
    ids = [v[0] for v in vec]
    least = {c: min(ids[i] for i in cls if cls[i] == c) for c in cls.values()}
    assert {i: got[ids[i]] for i in cls} == {i: (int(links[i].sum()), least[cls[i]], ids[i] == least[cls[i]]) for i in cls}
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904, 905)) and got[906] == (1, 906, True) and got[907] == (1, 906, False)
    assert embedding_dedup.op3(df.limit(0)).count() == 0


def test_crowded_cells_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    df = spark.createDataFrame([(i, [float(x) for x in base + 0.1 * rng.normal(size=64)], 1) for i in range(120)], "vec_id long, embedding array<float>, label int").cache()
    whole = sorted(map(tuple, embedding_dedup.op3(df).collect()))
    monkeypatch.setattr(embedding_dedup, "CROWD", 16)
    assert sorted(map(tuple, embedding_dedup.op3(df).collect())) == whole and sum(r[1] for r in whole) > 500


def test_nearest_lattice_points():
    x = np.random.default_rng(6).normal(size=(200, 8)) * 2
    best = embedding_dedup.decode(x)
    around = best[:, None] + embedding_dedup.NEIGHBOURS
    assert (((x - best) ** 2).sum(1)[:, None] <= ((x[:, None] - around) ** 2).sum(2) + 1e-12).all()
    assert len({tuple(r) for r in embedding_dedup.NEIGHBOURS}) == 240


def test_language(spark, docs, empty):
    rng = random.Random(7)
    alphabet = {"xx": "abcdefg", "yy": "efghijkl"}
    data = [(k, " ".join("".join(rng.choice(alphabet[lang]) for _ in range(5)) for _ in range(30)), lang) for k in range(300) for lang in [("xx", "yy")[k % 2]]]
    df = spark.createDataFrame([*data, (900, None, "xx"), (901, "123 --", "yy"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.op4(df).collect()}
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert all(got[d[0]]["held_out"] for d in held) and sum(r["held_out"] for r in got.values()) == sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in got)
    assert np.mean([got[d[0]]["lang_pred"] == d[2] for d in held]) > 0.95
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.op4(empty).count() == 0 and langid.op4(docs).count() == len(rows())


def test_quality(spark, docs, empty):
    rng = random.Random(8)
    text = lambda good: " ".join(word(rng) + ("" if good else rng.choice(["###", "%%%"])) for _ in range(rng.randint(20, 400)))
    data = [(k, text(k % 4 > 0)) for k in range(400)]
    df = spark.createDataFrame(data + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(400)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.op5(df, labels).collect()}
    held = [k for k in range(400) if got[k]["held_out"]]
    assert held and np.mean([got[k]["predicted"] == int(k % 4 > 0) for k in held]) > 0.95
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.op5(empty, labels).count() == 0
    assert {r["score"] for r in quality.op5(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_quality_learns_from_every_passage(spark, monkeypatch):
    rng = random.Random(13)
    seen = {}
    texts = [" ".join(word(rng) for _ in range(n)) for n in (30_000, 14_000, 3, 1, 200, 900)]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(7)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "fit", lambda x, many, y: seen.update(x=x[0 : int(many.sum())], many=many) or 1.0)
    quality.train(df, labels)
    want = [quality.bags(raw := np.frombuffer((t or "").encode(), np.uint8), np.array([len(raw)]))[0] for k, t in enumerate([*texts, None]) if zlib.crc32(str(k).encode()) % 5]
    assert sum(map(len, want)) > 300 and sorted(seen["many"]) == sorted(map(len, want))
    rows = lambda x: Counter(r.tobytes() for r in x)
    assert rows(seen["x"]) == sum((rows(np.rint(255 * np.clip(x, 0, 1)).astype(np.uint8)) for x in want), Counter())


def test_quality_fits_alike_in_portions(monkeypatch):
    rng = np.random.default_rng(14)
    x, many, y = np.rint(rng.random((90, quality.FEATURES)) * 9), np.array([20, 1, 9] * 3), np.array([0, 1, 0] * 3)
    whole = quality.fit(x, many, y)
    monkeypatch.setattr(quality, "DENSE", 8)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(vars(whole).values(), vars(quality.fit(x, many, y)).values()))


def test_sharding(docs, empty):
    table = sharding.lookup_table()
    counts = Counter(table)
    assert len(counts) == 64 and max(counts.values()) - min(counts.values()) <= 1
    got = sharding.op7(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SIZE
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    assert np.mean([a == b for a, b in zip(table, fewer)]) > 0.9
    assert sharding.op7(empty).count() == 0


def test_packing(docs, empty):
    got = packing.op9(docs).collect()
    texts = defaultdict(list)
    for r in rows():
        texts[r[0]].append(r[1] or "")
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    want, have = Counter(), Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    for d, all_texts in texts.items():
        for t in all_texts:
            want += brute.cut_pieces(d, t)
    assert have == want
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.op9(empty).count() == 0


def test_packing_solver_is_near_optimal():
    rng = random.Random(9)
    for _ in range(200):
        cap = rng.choice([10, 20, 50])
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 10))]
        _, n = packing.solve(Counter(items), cap)

        def fits(k, left, loads):
            if not left:
                return True
            seen = set()
            for i in range(k):
                if loads[i] + left[0] <= cap and loads[i] not in seen:
                    seen.add(loads[i])
                    if fits(k, left[1:], [*loads[:i], loads[i] + left[0], *loads[i + 1 :]]):
                        return True
            return False

        best = next(k for k in range(1, 11) if fits(k, sorted(items, reverse=True), [0] * k))
        assert best <= n <= best + 1
        left = dict(Counter(items))
        fixed = packing.reduce_instance(left, cap)
        rest = [s for s, c in left.items() for _ in range(c)]
        rest_best = next(k for k in range(0, 11) if fits(k, sorted(rest, reverse=True), [0] * k))
        assert sum(t for _, t in fixed) + rest_best == best  # the reduction loses nothing


def test_token_output(spark, docs, empty, tmp_path):
    got = token_output.op8(docs).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    want = Counter()
    for r in rows():
        ids = np.append(brute.token_ids(r[1]), token_output.END).astype("<u2")
        want.update((r[0], k, zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == want
    from pyspark.sql import functions as F

    seqs = written(token_output.sequences(docs).withColumn("rid", F.monotonically_increasing_id()))
    placed = token_output.ordered(seqs, seqs.count(), per_shard=32)
    token_output.write_blocks(placed, str(tmp_path / "out"), per_block=8)
    blocks = token_output.read_from(spark, str(tmp_path / "out"), 40, 32, 8).collect()
    by_slot = {r["slot"]: r for r in placed.collect()}
    assert (blocks[0]["shard"], blocks[0]["block"]) == (1, 1)
    for b in blocks:
        assert zlib.crc32(b["payload"]) == b["crc"] and len(b["payload"]) == b["records"] * 4096
        for k in range(b["records"]):
            r = by_slot[b["shard"] * 32 + b["block"] * 8 + k]
            assert bytes(b["payload"][4096 * k : 4096 * k + 2 * r["length"]]) == bytes(r["ids"]) and b["lengths"][k] == r["length"]
    assert token_output.op8(empty).count() == 0


def test_token_output_digests_the_written_records(spark, monkeypatch):
    rng = random.Random(15)
    data = [(k, " ".join(word(rng) for _ in range(n))) for k, n in enumerate([3_000, 1, 40, 0, 700, 5] * 14)] + [(None, None), (3, "again")]
    paths, write = [], token_output.write_blocks
    monkeypatch.setattr(token_output, "write_blocks", lambda placed, path, **kw: paths.append(path) or write(placed, path, **kw))
    got = {r["slot"]: r for r in token_output.op8(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    blocks = spark.read.parquet(*paths).collect()
    assert sum(b["records"] for b in blocks) == len(got) > 64 and sorted(b["block"] for b in blocks) == list(range(-(-len(got) // 64)))
    want = Counter()
    for d, t in data:
        ids = np.append(brute.token_ids(t), token_output.END).astype("<u2")
        want.update((d, k, ids[a : a + 2048].tobytes()) for k, a in enumerate(range(0, len(ids), 2048)))
    have = Counter()
    for b in blocks:
        for k in range(b["records"]):
            r, raw = got[b["block"] * 64 + k], bytes(b["payload"][4096 * k : 4096 * (k + 1)])
            ids, rest = raw[: 2 * r["length"]], raw[2 * r["length"] :]
            assert rest == np.full(len(rest) // 2, token_output.PAD, "<u2").tobytes() and zlib.crc32(ids) == r["ids_crc32"] and r["offset"] == r["record"] * 4096
            have[r["doc_id"], r["piece"], ids] += 1
    assert have == want


def test_urls(spark):
    urls = [None, "", "nothing", "http://a.EXAMPLE.com/en/71?x#y", "https://example.com/en/8", "ftp://x.com/de/", "http://com/en/", "http://notexample.com/en/7", "http://b.net/de/8", "http://example.net/de/8/9", "http://example.net/de", "http://h.org?/es/", "http://h.org/es/#", "http://h.org//es/", "http://xcom/en/", "a://b://c/en/", "http://x.com:80/en/", "http://x.com./en/1"]
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.op10(df).collect()}
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, "allow")
        assert tuple(got[i])[1:] == (host, path, rule, verdict)
    assert url_filter.op10(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {frozenset(e) for e in edges}
    cls = linked_classes(sorted({x for e in edges for x in e if len(set(e)) > 1}), lambda a, b: frozenset((a, b)) in pairs)
    least = {c: min(x for x in cls if cls[x] == c) for c in cls.values()}
    assert got == {x: least[c] for x, c in cls.items()}


CLASHES = ["sha", "_sha", "rid", "_id", "best", "kept", "keep_id", "fp", "root", "component_id", "src", "src_null", "text_hash", "start", "block", "pass", "_key", "_own_key", "_own_sha", "_own_all", "_own_runs", "_own_text", "_own_size", "_own_score", "h", "_y", "quality", "piece", "length", "number", "ids", "_n", "_w", "_b", "lang_pred", "held_out", "slot", "shard", "_id_", "_row", "_spare", "score_", "part", "record"]


def test_columns_of_clashing_names_stay(spark, docs, empty):
    """Further columns named like the operators' own keep their values, and change no result."""
    from pyspark.sql import functions as F

    extra = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    dealt = [mixing.op1, exact_dedup.op2, langid.op4, lambda d: quality.op5(d, labels), simhash.op6, sharding.op7, token_output.op8, packing.op9]
    for op in dealt:
        assert Counter(map(str, op(extra).collect())) == Counter(map(str, op(docs).collect()))
    for keep in (exact_dedup.exact_dedup, simhash.simhash_dedup, mixing.mixed, lambda d: quality.keep_good(d, labels)):
        out = keep(extra)
        assert out.columns == extra.columns
        assert Counter(map(str, out.select(docs.columns).collect())) == Counter(map(str, keep(docs).collect()))
        assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in out.collect() for c in CLASHES)


def test_pages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/1", "x", "y", "z", "w")], "page_id long, url string, host string, path string, rule string, _f string")
    assert [tuple(r) for r in url_filter.op10(df).collect()] == [(1, "a.com", "/en/1", "com/en/", "block")]


def test_ids_of_long_runs_of_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    for text in ("a" + " " * 1_500_000 + "b", "\n" * 1_200_000, "x <|endoftext|>" + "\t " * 10_000):
        assert own_ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_long_texts_score_in_pieces_as_in_one(monkeypatch):
    rng = np.random.default_rng(11)
    m = quality.fit(rng.random((40, quality.FEATURES)) * 255, np.array([2] * 20), np.array([0, 1] * 10))
    raw = rng.choice(np.frombuffer(b"the quick, brown fox! ", np.uint8), 50_001)
    whole, many = quality.encoded(m, raw, np.array([len(raw)]))
    monkeypatch.setattr(quality, "BYTES", 4 * quality.PASSAGE)
    split, same = quality.encoded(m, raw, np.array([len(raw)]))
    assert many.tolist() == same.tolist() == [98] and np.allclose(whole, split)


def test_portions():
    assert list(shared.portions(np.array([3, 3, 9, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(shared.portions(np.array([], np.int64), 6)) == [] and list(shared.portions(np.array([7]), 6)) == [(0, 1)]
