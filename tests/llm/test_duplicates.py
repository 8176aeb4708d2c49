import random

from pyspark.sql import functions as F

from tallywright.llm import jaccard, passages, simhash
from tallywright.llm.components import components

from .brute import components as brute_components, repeats, words

DOCS = "doc_id long, text string"


def prose(rng, n):
    return [f"w{rng.randrange(100000)}" for _ in range(n)]


def corpus():
    """Groups of near copies at all distances, chains, copies, shared passages, short texts."""
    rng = random.Random(4)
    rows, common = [], prose(rng, 60)
    for group in range(12):
        base = prose(rng, rng.choice([6, 12, 40, 150, 400]))
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, len(w) // 20, len(w) // 8])):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [f"x{rng.randrange(999)}"], [w[i], "and"]])
            if rng.random() < 0.2:
                w = w + common
            if rng.random() < 0.2:
                base = w  # chains: the next ones are edits of this one
            rows.append(" ".join(w))
    rows += ["", " \t\n", "one", "ONE", "one two", "a b c d", "A b\tc\nd", "a b c d e", "é É", None, " ".join(prose(rng, 30000))]
    return list(enumerate(rows))


def test_components_of_links(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50))
    for a, b in chain:
        assert got.get(a, a) == got.get(b, b) <= min(a, b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join_against_all_pairs(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_on_documents(spark, small, same_rows):
    same_rows(jaccard.op1_ngram_jaccard(spark, small), jaccard.OP1_SQL)


def test_jaccard_edge_cases(spark):
    rows = [(1, "a b c d e f", 5), (1, "a b c d e f", 5), (2, "a b c d e f", 6), (None, "a b c d e f", 7), (3, None, 8), (4, "", 9)]
    docs = spark.createDataFrame(rows, DOCS + ", component_id int").withColumn("token", F.lit(1)).withColumn("_text", F.lit("x"))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["rows"]) for r in jaccard.join(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, 2), (2, 2, 1, 1), (None, 2, None, 1), (3, 0, 3, 1), (4, 0, 4, 1)], key=str)
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in kept.collect()) == [(0, 7), (1, 5), (3, 8), (4, 9)]
    assert jaccard.join(docs.limit(0)).count() == 0 and jaccard.first_of_each(docs.limit(0)).count() == 0


def covered(spans, start, least=50):
    return any(a <= start and start + least <= b for a, b in spans)


def test_passages_against_exact_repeats(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = passages.op2_substring_dedup(spark, small).collect()
    told = {}
    for r in got:
        told.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    for d, starts in repeats(rows).items():
        assert all(covered(told.get(d, []), i) for i in starts)
    texts = {d: words(t) for d, t in rows}
    for r in got:
        assert 0 <= r["start_word"] and r["end_word"] <= len(texts[r["doc_id"]]) and r["end_word"] - r["start_word"] >= 50 and r["similarity"] >= 0.75


def test_planted_passages(spark):
    rng = random.Random(9)
    shared, near = prose(rng, 55), prose(rng, 120)
    changed = list(near)
    changed[30], changed[90] = "other", "words"
    rows = [(i, " ".join(prose(rng, 200) + shared + prose(rng, 100))) for i in range(30)]
    rows += [(100, " ".join(prose(rng, 80) + near)), (101, " ".join(changed + prose(rng, 80))), (102, " ".join(prose(rng, 500)))]
    rows += [(103, " ".join(prose(rng, 30) * 8)), (104, None), (105, ""), (106, rows[5][1]), (None, rows[5][1]), (107, " ".join(shared[:40]))]
    got = passages.passages(spark.createDataFrame(rows, DOCS).withColumn("first", F.lit(0)).repartition(3)).collect()
    ids = {r["doc_id"] for r in got}
    assert ids == {*range(30), 100, 101, 106}
    for i in range(30):
        assert any(r["start_word"] <= 200 and r["end_word"] >= 255 for r in got if r["doc_id"] == i)
    assert passages.passages(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprints(spark):
    rng = random.Random(2)
    base = prose(rng, 300)
    rows = [(i, " ".join(base[:i * 3] + ["x"] + base[i * 3:])) for i in range(8)] + [(50 + i, " ".join(prose(rng, 200))) for i in range(20)] + [(90, rows_) for rows_ in (None, "")] + [(None, "a b"), (91, "é " * 20000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("fingerprint", F.lit(3)).repartition(4)
    out = simhash.edits(docs).collect()
    assert len(out) == len(rows) and {r["doc_id"] for r in out} == {d for d, _ in rows}
    far = [r["near_edited"] for r in out if r["doc_id"] is not None and 50 <= r["doc_id"] < 70]
    assert 0.55 < sum(far) / len(far) < 0.8
    prints = spark.createDataFrame([(r["doc_id"], r["fingerprint"]) for r in out], "doc_id long, fingerprint string")
    distance = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    distinct = {r["fingerprint"] for r in out}
    for radius, blocks in ((7, 8), (12, 16)):
        got = {(r["query"], r["fingerprint"], r["distance"]) for r in simhash.within(prints, prints, radius, blocks).collect()}
        assert got == {(a, b, distance(a, b)) for a in distinct for b in distinct if distance(a, b) <= radius}
    assert simhash.edits(docs.limit(0)).count() == 0


def test_edited_texts(spark, small):
    import hashlib

    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in simhash.op4_simhash(spark, small).collect()}
    for i, (d, t) in enumerate(rows):
        half = len(t) // 2
        edited = t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(t)
        assert got[d]["near_next"] == 1 - bin(int(got[d]["fingerprint"], 16) ^ int(got[rows[(i + 1) % len(rows)][0]]["fingerprint"], 16)).count("1") / 128


def test_passages_with_inserted_and_deleted_words(spark):
    rng = random.Random(12)
    rows = []
    for i in range(40):
        base = prose(rng, rng.choice([80, 90, 200, 400]))
        longer = [w for at, w in enumerate(base) for w in ([f"x{rng.randrange(999)}", w] if at % 40 == 39 else [w])]
        shorter = [w for at, w in enumerate(base) if at % 45 != 40]
        rows += [(3 * i + j, " ".join(prose(rng, 30) + w + prose(rng, 30))) for j, w in enumerate((base, longer, shorter))]
    got = passages.passages(spark.createDataFrame(rows, DOCS)).collect()
    texts = {d: words(t) for d, t in rows}
    pairs = {(r["doc_id"], r["of_doc_id"]) for r in got}
    assert all(a // 3 == b // 3 for a, b in pairs)
    # each copy differs from its base by 0.8 or more: a sample may lose a few
    assert len({a for a, _ in pairs}) >= 0.95 * len(rows)
    for r in got:
        part = texts[r["doc_id"]][r["start_word"] : r["end_word"]]
        assert len(part) >= 50 and 0.75 <= r["similarity"] <= 1
        own = {tuple(part[i : i + 5]) for i in range(len(part) - 4)}
        other = texts[r["of_doc_id"]][r["of_start_word"] :]
        most = max(len(own & s) / len(own | s) for n in range(50, len(other) + 1) for s in [{tuple(other[i : i + 5]) for i in range(n - 4)}])
        assert most >= r["similarity"] - 1e-9


def test_exact_passages_with_a_frequent_phrase(spark):
    rng = random.Random(21)
    phrase, rows = prose(rng, 25), []
    for i in range(150):
        shared = prose(rng, 15) + phrase + prose(rng, 15)
        rows += [(2 * i + j, " ".join(prose(rng, 60) + shared + prose(rng, 60))) for j in (0, 1)]
    told = {}
    for r in passages.passages(spark.createDataFrame(rows, DOCS).repartition(3)).collect():
        told.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    for d, starts in repeats(rows).items():
        assert starts and all(covered(told.get(d, []), i) for i in starts)


def test_recall_of_near_passages_at_the_threshold(spark):
    """Passages of 50 to 60 words whose shingle sets are alike by 0.75 to 0.8: nine in ten are to be met."""
    rng = random.Random(75)
    phrase, rows, asked = prose(rng, 12), [], 0
    while asked < 400:
        own = prose(rng, rng.randrange(38, 49)) + phrase  # the phrase is in every passage
        other = list(own)
        other[rng.randrange(6, len(own) - 18)] = "edit"
        if len(own) > 54:
            other[5] = "more"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (own, other))
        if 0.75 <= len(a & b) / len(a | b) <= 0.8:
            rows += [(2 * asked, " ".join(prose(rng, 60) + own + prose(rng, 60))), (2 * asked + 1, " ".join(prose(rng, 60) + other + prose(rng, 60)))]
            asked += 1
    got = {(r["doc_id"], r["of_doc_id"]) for r in passages.passages(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert all(a // 2 == b // 2 for a, b in got)
    assert sum((2 * i, 2 * i + 1) in got and (2 * i + 1, 2 * i) in got for i in range(asked)) >= 0.9 * asked


def test_passages_of_clashing_ids_and_long_texts(spark):
    rng = random.Random(5)
    shared, line = prose(rng, 70), prose(rng, 9)
    long = prose(rng, 30_000)
    rows = [(1, " ".join(shared + prose(rng, 40))), (1, " ".join(prose(rng, 40) + shared)), (2, " ".join(prose(rng, 90)))]
    rows += [(2, rows[0][1]), (3, " ".join(long + shared)), (4, " ".join(prose(rng, 100) + long[9_000:29_000]))]
    rows += [(5 + i, " ".join(prose(rng, 20) + line * 12 + prose(rng, 20))) for i in range(30)]
    rows += [(50, " ".join(prose(rng, 60)))] * 2  # a repeated row
    got = passages.passages(spark.createDataFrame(rows, DOCS)).collect()
    ids = [r["doc_id"] for r in got]
    assert set(ids) == {1, 2, 3, 4, *range(5, 35), 50}
    assert all(ids.count(5 + i) == 1 for i in range(30))  # one row for a text of repeats, not one for each offset
    assert any(r["doc_id"] == 4 and r["start_word"] == 100 and r["end_word"] >= 20_000 for r in got)
    assert any(r["doc_id"] == 3 and r["start_word"] == 9_000 for r in got)


def test_written_tables_leave_no_shuffle_files(spark):
    import time
    from pathlib import Path

    from tallywright.llm.scratch import written

    name, folder = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", Path(spark.sparkContext.getConf().get("spark.local.dir"))
    before, files = spark.conf.get(name, None), set(folder.rglob("shuffle_*.data"))
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")).join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k"), "counts")
    for _ in range(50):  # executors are told to delete, not waited for
        if not (left := set(folder.rglob("shuffle_*.data")) - files):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(name, None) == before
    assert sum(r["n"] for r in table.collect()) == 1000


def test_fingerprint_against_plain_votes():
    """Each shingle of three words votes with 1 + log(times) on each bit by its hash."""
    import numpy as np
    import pyarrow as pa

    from tallywright.llm.arrays import U64, mix, shingles, word_hashes

    rng = random.Random(44)
    texts = [" ".join(prose(rng, 30) + ["a", "b", "c"] * 7 + prose(rng, rng.randint(0, 50))) for _ in range(5)] + ["one", "", None, "A b a B a b"]
    got = simhash.fingerprints(pa.array(texts))
    for t, row in zip(texts, got):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        hashes, rows, _, _ = word_hashes(raw, np.array([0, len(raw)]))
        values = shingles(hashes, rows, 1, simhash.WIDTH)[0].tolist() if len(hashes) else []
        votes = [0.0] * simhash.BITS
        for v in set(values):
            weight = 1 + np.log(values.count(v))
            for word in range(simhash.BITS // 64):
                h = int(mix(np.array([v], np.uint64) + U64(word * 0x632BE59BD9B4E019))[0])
                for bit in range(64):
                    votes[word * 64 + bit] += weight if h >> (63 - bit) & 1 else -weight
        assert [int(x > 1e-9) for x in votes] == np.unpackbits(row).tolist()
    assert [simhash.blocks_for(n, 3) for n in (1, 2**16, 2**32, 2**33, 2**40)] == [4, 4, 4, 5, 5]


def test_near_passages_of_documents_that_are_no_hubs(spark):
    """Two of the four documents that have a core of 40 words are near each other; the first and the last one are near none."""
    rng, rows = random.Random(31), []
    for i in range(150):
        core, before, after = prose(rng, 40), prose(rng, 6), prose(rng, 7)
        other = [*before[:5], "edit"]
        for j, (a, b) in enumerate(((prose(rng, 6), prose(rng, 7)), (before, after), (other, after), (prose(rng, 6), prose(rng, 7)))):
            rows.append((4 * i + j, " ".join(prose(rng, 40) + a + core + b + prose(rng, 40))))
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    hubs, every = ({(r["doc_id"], r["of_doc_id"]) for r in passages.passages(docs, **how).collect()} for how in ({}, {"all_partners": True}))
    pairs = {(4 * i + j, 4 * i + 3 - j) for i in range(150) for j in (1, 2)}
    assert hubs < every <= pairs, (len(hubs), len(every), len(pairs))
