import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallywright.llm import langid, quality, secrets, topk, warc
from tallywright.llm.scratch import new_path


def crc(n):
    return zlib.crc32(str(n).encode())


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op7_quality(spark, sf).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a fine text. " * 50), (3, "a fine text. " * 50), (None, "x"), (4, "!!!" * 100000)], "doc_id long, text string").withColumn("_score", F.lit("k"))
    labels = spark.createDataFrame([(3, 1), (3, None), (4, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 6
    none = quality.keep_good(docs, labels.limit(0))
    assert none.count() == 6 and quality.keep_good(docs.limit(0), labels).count() == 0
    x, y = quality.isotonic(np.arange(4.0), np.array([0.0, 0.9, 0.1, 1.0]), np.ones(4))
    assert list(x) == [0, 1.5, 3] and (np.diff(y) > 0).all()


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op9_language(spark, sf).collect()
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(rows) == 1000 and np.mean(held) > 0.97 and all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in rows)


def test_language_filters_against_sets(spark):
    """Every learned n-gram is found, in all its languages; others rarely."""
    rows = spark.createDataFrame([("the cat and the hat", "en"), ("le chat et le chapeau", "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    f = langid.learn(rows)
    assert f.langs == ["en", "fr"]
    data = np.frombuffer(b"the cat and the hat", np.uint8)
    codes, bounds = langid.grams(data, np.array([0, len(data)]))
    assert len(codes) == 15
    assert f.shares(codes, bounds)[0, 0] > 0.99 > 0.6 > f.shares(codes, bounds)[0, 1]


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, "12 34 !"), (3, ""), (4, "é"), (None, "the"), (5, "the " * 200000), (5, "the")], "doc_id long, text string").withColumn("score", F.lit(1))
    f = langid.learn(spark.createDataFrame([("the cat", "en"), ("été é", "fr")], "text string, lang string"))
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, f).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "fr"), (None, "en"), (5, "en"), (5, "en")], key=str)
    empty = langid.learn(docs.select("text", F.lit(None).cast("string").alias("lang")))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), f).count() == 0


_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(t):
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return [(a, b, secrets.KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def test_secret_spans_against_plain_patterns(spark, small):
    rng = random.Random(8)
    parts = ["token", "TOKEN", "api_key", "apikey", "pass", "word", "passwd", "=", ": ", " = ", '"', "'", "secret", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", " ", "\n", "deadbeef" * 3, "-", "zz"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for t in texts:
        assert secrets.base_spans(t) == plain_spans(t)
    rows = secrets.op10_secrets(spark, small).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_spans(docs[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, _, k in base) for kind in secrets.KINDS[:3])
        assert set(f"{k}:{a}:{b}" for a, b, k in base) <= set(r["spans"].split(","))


def test_token_efficiency(spark):
    encode = secrets.encoding(None).encode_ordinary
    random_key, uuid, digest = "tG7xQ2vLp9ZkR4mWc8Yb3HsJ", "123e4567-e89b-12d3-a456-426614174000", "9e107d9d372bb6826bd81d3542a419d6"
    for text, n in ((random_key, 1), (uuid, 0), ("internationalization-of-configuration", 0), ("https/www/example/path2/to/page", 0), ("1" * 40, 0), ("theconfigurationoptionsare", 0), (digest.upper(), 0)):
        assert len(secrets.random_spans(f"see {text} here", [], encode)) == n, text
    docs = spark.createDataFrame([(1, f"my key {random_key}, password: hunter22é", 40), (2, None, None), (3, "clean", 5), (None, digest, 32)], "doc_id long, text string, n_chars long").withColumn("base_spans", F.lit(0))
    kept = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert kept[1]["text"] == "my key [SECRET], [SECRET]é" and kept[1]["n_chars"] == len(kept[1]["text"]) and kept[3]["n_chars"] == 5 and kept[2]["text"] is None and kept[None]["text"] == "[SECRET]"
    assert secrets.redact(docs).columns == docs.columns and secrets.scan(docs).count() == 4 and secrets.scan(docs.limit(0)).count() == 0


def test_top_k(spark, small, same_rows):
    same_rows(topk.op3_top_k(spark, small), topk.OP3_SQL)


def test_top_k_edge_cases(spark):
    inf = float("inf")
    rows = [(i, [1.0, 0.5 * (i % 3)]) for i in range(60)] + [(100, None), (101, [1.0, None]), (102, [inf, 1.0]), (None, [1.0, 1.0]), (103, []), (104, [1e12, 1e12]), (105, [1.0, 2.0, 3.0]), (50, [9.0, 9.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)))
    got = topk.search(v.filter("vec_id % 50 = 0"), v, 5, block=1, tile=7).collect()
    best = {}
    for r in got:
        best.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(best) == {0, 50}
    assert [i for _, i, _ in sorted(best[0])][:2] == [104, 50] and [r for r, _, _ in sorted(best[0])] == [1, 2, 3, 4, 5]
    assert all(i != q for q, x in best.items() for _, i, _ in x)
    assert topk.search(v.limit(0), v).count() == 0 and topk.search(v, v.limit(0)).count() == 0


def test_warc(spark, small, same_rows):
    same_rows(warc.op8_warc(spark, small), warc.OP8_SQL)


def test_warc_round_trip(spark):
    big = "x" * 90 + "\r\n\r\nWARC/1.1\r\n" * 30 + "é"
    rows = [(1, "u1", big), (2, "u2", big), (3, None, None), (4, "a\nb", ""), (None, "n", "\r\n\r\n"), (5, "u5", "\r\n\r\n"), (2, "u2b", big), (6, "u", "y" * 99), (7, "u", "y" * 99), (8, "long", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("record_type", F.lit(2))
    for least, revisits in ((100, 2), (50, 3)):
        back = warc.read(spark, warc.deduplicate(pages, new_path(spark, "w"), least)).collect()
        assert len(back) == len(rows) and sum(r["record_type"] == "revisit" for r in back) == revisits
        assert all(r["payload"] == "" and r["refers_to"] in (1, 6) for r in back if r["record_type"] == "revisit")
        texts = {(i, u and u.replace("\n", "%0A")): t or "" for i, u, t in rows}
        assert all(r["payload"] == texts[r["page_id"], r["url"]] for r in back if r["record_type"] == "response")
    assert warc.read(spark, warc.deduplicate(pages.limit(0), new_path(spark, "w"))).count() == 0


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (None, "some text", "en", "src0", 9), (10**6 + 1, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("score", F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources", "best-fit packing"]
    from tallywright.llm.scratch import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, small), "stage")
        assert docs.columns == before.columns and 0 < docs.count() <= 3 * before.count(), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.count() >= docs.count()
    assert corpus_pipeline.run(spark, small).count() > 0


@pytest.mark.parametrize("n", range(4))
def test_empty_table_goes_through_each_stage(spark, small, n):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[n][1](spark, docs, small).count() == 0


def test_keys_with_signs_are_random():
    encode = secrets.encoding(None).encode_ordinary
    for text, n in (("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", 1), ("q83vEjRWeJCrze8/+SNFZ4k=", 1), ("Zk3-Qp9_xV7-Lm2Rt8_Wc4yB", 1), ("hJ9+kQ2/Xz7LmP4vRt8Yb3==", 1), ("qXvZkJwPbTgRmYcNfHdLsQ", 1), ("src/main/java/org/Example/Test2", 0), ("release-2024-01-15-build-42", 0)):
        assert len(secrets.random_spans(f"see {text} here", [], encode)) == n, text


def test_warc_payloads_that_end_in_line_breaks(spark):
    texts = ["abc\r\n", "\r\n", "x\r\n\r\n\r\n", "\r\n\r\n\r\n", "\r", "\n", "a\r", "a\r\n\r", "b\n\r\n", "", "é\r\n\r\n", "last\r\n"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("url", F.lit("u"))
    for parts in (1, len(texts)):
        back = warc.read(spark, warc.deduplicate(pages.repartition(parts, "page_id"), new_path(spark, "w"))).collect()
        assert {r["page_id"]: r["payload"] for r in back} == dict(enumerate(texts)) and len(back) == len(texts)


def test_calibration_never_falls():
    x, y = quality.isotonic(np.array([0.1, 0.5, 0.9]), np.array([0.2, 0.9, 1.0]), np.array([500.0, 1000.0, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
    rng = np.random.default_rng(4)
    for _ in range(200):
        k = int(rng.integers(1, 60))
        x, y = quality.isotonic(np.arange(k) + 0.5, rng.integers(0, 4, k) / 3, rng.integers(1, 900, k).astype(float))
        assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and ((0 < y) & (y < 1)).all()


def test_normal_equations_against_plain_sums(spark):
    rng = np.random.default_rng(6)
    f, y = rng.standard_normal((400, len(quality.FEATURES))), rng.integers(0, 2, 400)
    train = spark.createDataFrame([(row.tolist(), float(t), i % 2) for i, (row, t) in enumerate(zip(f, y))], "f array<double>, y double, half int").repartition(9)
    model = quality.Model(f.mean(0), f.std(0))
    sums = quality._sums(train, model)
    for half in (0, 1):
        z, t = model.map(f[half::2]), y[half::2]
        assert np.allclose(sums[half][0], z.T @ z) and np.allclose(sums[half][1], z.T @ t) and sums[half][2] == 200
    # the cosines' inner products are near the Gaussian kernel
    z = model.map(f)[:, :-1]
    scaled = (f - f.mean(0)) / f.std(0)
    kernel = np.exp(-((scaled[:50, None] - scaled[None, :50]) ** 2).sum(2) / (2 * quality.WIDTH**2))
    assert np.abs(z[:50] @ z[:50].T - kernel).mean() < 0.08


def test_more_languages_than_a_mask_has_bits(spark):
    rng = random.Random(70)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)] for i in range(70)}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    f = langid.learn(spark.createDataFrame([(text(lang, 60), lang) for lang in words], "text string, lang string"))
    assert f.langs == sorted(words) and len(f.masks) == 2
    docs = spark.createDataFrame([(i, text(lang, 9)) for i, lang in enumerate(sorted(words))], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, f).collect()}
    assert sum(got[i] == lang for i, lang in enumerate(sorted(words))) >= 68


def test_shares_against_plain_sets(spark):
    rng = random.Random(71)
    langs = {lang: [" ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(40)) for _ in range(5)] for lang, a in (("x", "abcdefgh"), ("y", "fghijklm"))}
    f = langid.learn(spark.createDataFrame([(t, lang) for lang, ts in langs.items() for t in ts], "text string, lang string"))
    grams = lambda t: [g for i in range(len(t) - 1 + 0) for g in [(" " + t + "   ")[i : i + 4]] if g[1] != " "] + ([(" " + t + "   ")[len(t) - 1 :][:4]] if t else [])
    count = {lang: {} for lang in langs}
    for lang, ts in langs.items():
        for t in ts:
            for g in grams(t):
                count[lang][g] = count[lang].get(g, 0) + 1
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in count.items()}
    own = {lang: {g for g, s in share[lang].items() if s >= langid.SHARE and s >= langid.PART * sum(share[o].get(g, 0) for o in langs) / 2} for lang in langs}
    for t in ("abc fgh ijk", "fghfgh lmlm", langs["x"][0]):
        data = np.frombuffer(t.encode(), np.uint8)
        codes, bounds = langid.grams(data, np.array([0, len(data)]))
        assert len(codes) == len(grams(t))
        for i, lang in enumerate(f.langs):
            plain = sum(g in own[lang] for g in grams(t)) / len(grams(t))
            assert abs(f.shares(codes, bounds)[0, i] - plain) < 0.02


def test_runs_of_any_length_in_linear_time(spark):
    import time

    encode = secrets.encoding(None).encode_ordinary
    start = time.perf_counter()
    for run in ("a" + "B" * 1_000_000, "aB" * 500_000, "A" * 1_000_000 + "b"):
        secrets.mixed(run)
    assert time.perf_counter() - start < 1
    found = [(i * 10, i * 10 + 5, "hex") for i in range(50_000)]
    secrets.random_spans(" ".join(["word"] * 100_000), found, encode)
    assert time.perf_counter() - start < 5
    assert secrets.base_spans("ſecret=abcdefgh toKen=abcdefgh") == [] and len(secrets.base_spans("SeCrEt=abcdefgh")) == 1
    for run, n in (("aBcDe", True), ("abcdE", False), ("ABCde", False), ("aBCd", True), ("abc1", True), ("ABC", False), ("123", False), ("AbCd", True)):
        assert secrets.mixed(run) == n, run
    rows = [(1, "password = hunter22 " + "x" * 300_000)] * 2 + [(2, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"all_spans": F.lit("mine"), "base_spans": F.lit(7), "all_spans_": F.lit("too")})
    got = secrets.scan(docs).collect()
    assert len(got) == 3 and all(r["all_spans__"] == "mine" and r["base_spans_"] == 7 and r["all_spans_"] == "too" for r in got)
    assert sorted(len(r["base_spans"]) for r in got) == [0, 1, 1]


def test_scores_beyond_64_bits_are_the_largest(spark):
    rows = [(0, [1.0, 1e300]), (1, [1.0, 2.0]), (2, [-1.0, 3e17]), (3, [0.0, -3e17]), (50, [2.0, 1e10])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.search(v.filter("vec_id % 50 = 0"), v).collect()}
    whole = {r["vec_id"]: r["v"] for r in v.collect()}
    assert set(got) == {(q, i) for q in (0, 50) for i in whole if i != q}
    for (q, i), s in got.items():
        assert s == max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[i]))))


def test_warc_record_ids_are_unique(spark):
    text = "same payload " * 20
    pages = spark.createDataFrame([(7, "u", text), (7, "u", text), (7, "v", "short"), (7, "v", "short"), (9, "w", text)], "page_id long, url string, html string").repartition(2)
    path = warc.deduplicate(pages, new_path(spark, "w"))
    back = warc.read(spark, path).collect()
    assert len({r["record_id"] for r in back}) == 5 and sorted(r["record_type"] for r in back) == ["response"] * 3 + ["revisit"] * 2
    ids = {r["record_id"] for r in back if r["record_type"] == "response"}
    assert all(r["refers_id"] in ids and r["refers_to"] == 7 for r in back if r["record_type"] == "revisit")
    full = warc.originals(warc.read(spark, path)).collect()
    assert sorted(r["payload_bytes"] for r in full) == [5, 5] + [len(text)] * 3
