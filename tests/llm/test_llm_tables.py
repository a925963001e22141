"""Sharding, similarity join, WARC, decontamination, quality rules and the pipeline: against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import decontaminate, ngram_join, quality, sharding, shingles, warc
from codestrata.session import shared_dir

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "s", 0) for i, t in texts], SCHEMA)


# --- sharding ---------------------------------------------------------------------------------------------------------


def test_shards_are_contiguous_balanced_and_gapless(spark):
    rng = random.Random(1)
    texts = [(i, rng.choice([None, "", "é" * rng.randrange(300), "copy" * 30])) for i in range(500)] + [(None, "x"), (7, "dup"), (7, "dup"), (7, "dup")]
    docs = docs_of(spark, texts).withColumn("size", F.lit("clash")).repartition(5)
    got = sharding.shard_by_bytes(docs, 8, ranges=13).toPandas()
    assert len(got) == len(texts) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    sizes = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in texts)
    assert sorted(zip(got["size"], got.text_crc32, strict=True)) == sizes
    by = got.groupby("shard")
    assert (by.slot.apply(lambda s: sorted(s) == list(range(len(s))))).all()
    total = got["size"].sum()
    assert (by["size"].sum() - total / 8).abs().max() <= got["size"].max()
    order = got.sort_values("start_byte")
    assert order.shard.is_monotonic_increasing and order.start_byte.tolist() == (order["size"].cumsum() - order["size"]).tolist()
    ids = order.doc_id.fillna(-1).tolist()
    assert ids == sorted(ids)
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


# --- similarity join --------------------------------------------------------------------------------------------------


def gram_set(text, n=5):
    w = WORDS.findall(text or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_classes(rows, threshold=0.8):
    sets = [(i, gram_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[root(k)].append(sets[k][0])
    name = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return sorted(((sets[k][0], name[root(k)] if sets[k][1] else sets[k][0], links[k]) for k in range(len(sets))), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [2048, 3])
def test_join_equals_brute_force(spark, block):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 40, 150]))]
        rows += [(len(rows) + k, edited(rng, base, rng.choice([0, 0, 1, 2, 6]))) for k in range(8)]
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "one two"), (None, rows[0][1]), (5, rows[5][1])]
    docs = docs_of(spark, rows).withColumn("class_id", F.lit("clash"))
    got = ngram_join.similar_classes(docs, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_classes(rows)
    assert ngram_join.similar_classes(docs.limit(0)).count() == 0


def test_keep_one_keeps_one_row_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(4, base), (2, base + " tail"), (3, "quite another text of its own here"), (9, None), (8, ""), (2, base + " tail")]
    kept = ngram_join.keep_one(docs_of(spark, rows).withColumn("more", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 8, 9] and kept.columns[-1] == "more"


def test_sketch_bytes_of_unrelated_long_texts_differ():
    rng = np.random.default_rng(3)
    for n in (50, 500, 5000, 50_000):
        one, two = (np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(2))
        a, b = (np.frombuffer(ngram_join.low_bytes(ngram_join.signature(x, 120)), np.uint8) for x in (one, two))
        assert (a == b).mean() < 0.1, n


def test_recall_of_pairs_just_over_the_threshold():
    """Shares of planted pairs of a similarity of 0.80 to 0.83 that share a band, and whose bytes agree enough."""
    rng, bands, met, let = np.random.default_rng(5), ngram_join.bands_for(0.8, 5, 0.9999), [], []
    for k in range(300):
        n = int(rng.integers(40, 2000))
        shared = rng.integers(0, 2**64, n, dtype=np.uint64)
        own = int(n * 0.245 / 2)
        one, two = (np.unique(np.concatenate([shared, rng.integers(0, 2**64, own, dtype=np.uint64)])) for _ in range(2))
        assert 0.8 <= len(np.intersect1d(one, two)) / len(np.union1d(one, two)) < 0.84
        a, b = (ngram_join.signature(x, bands * 5) for x in (one, two))
        met.append((a.reshape(bands, 5) == b.reshape(bands, 5)).all(axis=1).any())
        x, y = (np.frombuffer(ngram_join.low_bytes(s), np.uint8) for s in (a, b))
        let.append((x == y).mean() >= 0.75 * 0.8)
    assert np.mean(met) >= 0.99 and np.mean(let) >= 0.99


def test_join_of_long_repeated_and_clashing_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, long, "a"), (2, long + " end", "b"), (3, long, "c"), (3, long, "c"), (4, "x" * 2_000_000, "d"), (5, " ".join(f"v{i}" for i in range(40_000)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("key", F.lit(1)).withColumn("_text_hash", F.lit(2)).withColumn("id", F.lit(3))
    got = sorted(tuple(r) for r in ngram_join.similar_classes(docs).collect())
    assert got == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (3, 1, 3), (4, 4, 0), (5, 5, 0)]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]


def test_bands_reach_the_recall():
    bands = ngram_join.bands_for(0.8, 5, 0.9999)
    assert 1 - (1 - 0.8**5) ** bands >= 0.9999 > 1 - (1 - 0.8**5) ** (bands - 1)


def test_word_hashes_are_those_of_the_words():
    old = shingles.PIECE
    try:
        for piece in (old, 7):
            shingles.PIECE = piece
            text = " a bb\tbb  a\nça ça x" * 3
            hashes, words = shingles.word_hashes(text.encode()), WORDS.findall(text)
            assert len(hashes) == len(words)
            assert all((hashes[i] == hashes[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    finally:
        shingles.PIECE = old
    assert len(shingles.word_hashes(b"")) == 0 and len(shingles.ngram_hashes(shingles.word_hashes(b"a b"), 5)) == 1


# --- archives ---------------------------------------------------------------------------------------------------------


def test_warc_round_trip_and_revisits(spark):
    long = "é" * 700
    rows = [(1, "u", "a" * 1000), (2, "u", "a" * 1000), (3, "u\r\nX: y", None), (4, None, long), (None, "u", long), (5, "u", "a" * 999), (6, "u", "a" * 999), (2, "u", "a" * 1000), (7, "", ""), (8, "x", "WARC/1.1\r\n\r\n0\r\n\r\n" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.round_trip(pages, shared_dir(spark), segment_chars=100, chunk_chars=33).collect()
    expect = Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == expect and all(r.complete for r in got)
    role = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert role == [(0, "revisit", 4), (1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None)]
    assert max(r.n_segments for r in got) > 10
    assert warc.round_trip(pages.limit(0), shared_dir(spark)).count() == 0


def test_warc_reassembly_reports_what_is_broken(spark, tmp_path):
    def record(kind, rid, body, **more):
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *[f"WARC-{k.replace('_', '-')}: {v}" for k, v in more.items()], f"Content-Length: {len(body)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    cut = [block[:20], block[20:40], block[40:]]
    parts = [
        record("continuation", "c3", cut[2], Segment_Origin_ID="good", Segment_Number=3, Segment_Total_Length=len(block)),
        record("response", "good", cut[0], Segment_Number=1),
        record("continuation", "c2", cut[1], Segment_Origin_ID="good", Segment_Number=2),
        record("response", "gap", cut[0], Segment_Number=1),
        record("continuation", "g3", cut[2], Segment_Origin_ID="gap", Segment_Number=3, Segment_Total_Length=len(block)),
        record("response", "short", cut[0], Segment_Number=1),
        record("continuation", "s2", cut[1], Segment_Origin_ID="short", Segment_Number=2, Segment_Total_Length=99),
        record("response", "frame", block.replace(b"5\r\nhello", b"6\r\nhello")),
        record("continuation", "lost", cut[1], Segment_Origin_ID="nowhere", Segment_Number=2, Segment_Total_Length=20),
        record("warcinfo", "info", b"x: y\r\n"),
        record("response", "plain", b"HTTP/1.1 200 OK\r\n\r\nhello"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    got = {r.record_id: r for r in warc.read_warc(spark, tmp_path.as_uri()).collect()}
    assert bytes(got["good"].payload) == b"hello" == bytes(got["plain"].payload) and got["good"].n_segments == 3
    assert {k for k, r in got.items() if not r.complete} == {"gap", "short", "frame", "nowhere"}
    assert all(got[k].payload is None for k in ("gap", "short", "frame", "nowhere"))


def test_dechunk():
    assert warc.dechunk(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"3\r\nab\r\n0\r\n\r\n", b"3\r\nabc0\r\n\r\n"):
        assert warc.dechunk(bad) is None


# --- decontamination --------------------------------------------------------------------------------------------------


def plain_alignment(a, b, match=2, mismatch=-1, gap=-1):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if x == y else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_textbook():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (np.array([rng.randrange(5) for _ in range(rng.randrange(1, 14))], np.uint64) for _ in range(2))
        score, first, last = decontaminate.align(a, b, decontaminate.Rules())
        assert score == plain_alignment(a.tolist(), b.tolist())
        if score:
            assert plain_alignment(a.tolist(), b[first : last + 1].tolist()) == score


def test_leaks_whole_edited_and_none(spark):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(30)]
    items = [[rng.choice(common) if k % 3 == 0 else f"item{n}w{k}" for k in range(30)] for n in range(5)]
    filler = lambda n: [rng.choice(common) for _ in range(n)]
    texts = {i: filler(80) for i in range(40)}
    texts[40] = filler(50) + items[0] + filler(50)
    texts[41] = filler(20) + edited(rng, items[1], 4).split() + filler(20)
    texts[42] = filler(20) + items[2][:8] + filler(60)  # too little of it
    texts[43] = [w.upper() + "," for w in items[3]]
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(50, None), (51, "")] + [(100 + k, " ".join(texts[40])) for k in range(60)]
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(items)] + [(98, None), (99, "  ")], "item_id long, text string")
    docs = docs_of(spark, rows).withColumn("item_id", F.lit("clash"))
    for size in (16_000_000, 400):  # one block, and several
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs, bench, block_bytes=size).collect()}
        assert set(got) == {(40, 0), (41, 1), (43, 3)} | {(100 + k, 0) for k in range(60)}
        assert got[40, 0] == 1 and 0.5 <= got[41, 1] < 1
    kept = decontaminate.drop_leaks(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in got} and kept.columns == docs.columns
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), bench).count() == 0


# --- quality ----------------------------------------------------------------------------------------------------------


def base_counts(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def test_quality_counts_by_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a", "f \x0b f\x0cf", "é|é #\n \né|é #\n", "a b c d e a b c d e", "x " * 40, "a b c d\n" * 9, " wide "]
    texts += ["".join(rng.choice(["a", "b", "cd", " ", "  ", "\n", "\x0b", "$", "ö"]) for _ in range(rng.randrange(400))) for _ in range(120)]
    texts.append(" ".join(f"w{i % 2500}" for i in range(6000)))
    docs = docs_of(spark, list(enumerate(texts)), {1: None, 2: "xx"}).withColumn("kept_by", F.lit("clash"))
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t), repr(t)
        assert not (r.base_failed and r.kept)
    assert quality.quality_report(docs.limit(0)).count() == 0


def test_quality_distances_by_brute_force(spark):
    common = "the of and to a in is it for on".split()
    rng = random.Random(9)
    make = lambda odd: " ".join(rng.choice(common) if rng.random() > odd else f"w{rng.randrange(10**6):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(160))
    texts = [make(0.5) for _ in range(60)] + [make(1.0), "| ".join(make(0.5).split()), make(0.5).replace("w", "###")]
    docs = docs_of(spark, list(enumerate(texts)))
    rules = quality.Rules(common_share=0.02)
    got = {r.doc_id: r for r in quality.quality_report(docs, rules=rules).collect()}

    def histogram(text, words):
        plain = [w.lower() for w in WORDS.findall(text)]
        return [sum(p == w for p in plain) for w in words] + [sum(p not in words for p in plain)]

    every = Counter(w.lower() for t in texts for w in WORDS.findall(t))
    words = sorted(w for w, n in every.items() if n >= 0.02 * sum(every.values()))

    def share(x):
        return np.array(x, float) / sum(x)

    q = share([every[w] for w in words] + [sum(n for w, n in every.items() if w not in words)])

    def distance(p, q):
        m = (p + q) / 2
        part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return np.sqrt((part(p) + part(q)) / 2)

    for i, t in enumerate(texts):
        assert got[i].word_distance == pytest.approx(distance(share(histogram(t, words)), q), abs=1e-6)
    clean = max(got[i].class_distance for i in range(60))
    assert all(got[i].kept for i in range(60)) and not got[60].kept and min(got[61].class_distance, got[62].class_distance) > 1.5 * clean
    kept = quality.keep_good(docs.withColumn("more", F.lit(2)), rules=rules)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept} and kept.columns[-1] == "more"


def test_quality_words_of_null_and_rare_languages(spark):
    common = "the of and to a in is it for on".split()
    rng = random.Random(10)
    letters = str.maketrans("0123456789", "ghijklmnop")
    junk = lambda: " ".join(f"w{rng.randrange(10**6):x}".translate(letters) for _ in range(160))
    prose = lambda: " ".join(rng.choice(common) if rng.random() > 0.5 else f"w{rng.randrange(10**6):x}".translate(letters) for _ in range(160))
    rows = [(i, prose(), "en") for i in range(60)] + [(60, junk(), None), (61, junk(), "rare"), (62, prose(), None), (63, prose(), "rare"), (64, junk(), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_report(docs, rules=quality.Rules(least_share=0.1, max_class_distance=1.0)).collect()}
    assert all(r.word_distance is not None for r in got.values())
    assert not any(got[i].kept for i in (60, 61, 64)) and all(got[i].kept for i in [*range(60), 62, 63])


@pytest.mark.parametrize("window", [1, 2, 3, 4, 6, 9])
def test_quality_windows_of_other_widths(spark, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]
    got = {r.doc_id: r.n_repeat_words for r in quality.quality_report(docs_of(spark, list(enumerate(texts))), rules=quality.Rules(window=window)).collect()}
    for i, t in enumerate(texts):
        words = t.split()
        seen = Counter(tuple(words[k : k + window]) for k in range(len(words) - window + 1))
        assert got[i] == len({j for k in range(len(words) - window + 1) if seen[tuple(words[k : k + window])] > 1 for j in range(k, k + window)}), t


def test_quality_of_long_repeated_and_clashing_rows(spark):
    long = "\n".join(f"l{i % 900} " + " ".join(f"w{i * 7 + k}" for k in range(9)) for i in range(30_000))
    rows = [(1, long, "en", 5, "a"), (1, long, "en", 5, "b"), (2, "x" * 3_000_000, None, 5, "c"), (None, "one two", "de", 5, None), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, row string")
    got = quality.quality_report(docs).collect()
    n, chars, symbols, dup, repeats, failed = base_counts(long)
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got if r.doc_id == 1] == [(n, chars, symbols, dup, repeats, failed)] * 2
    assert sorted(r.word_chars for r in got if r.doc_id != 1) == [0, 6, 3_000_000]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.row for r in kept.collect()} <= {"a", "b"}
    with pytest.raises(ValueError, match="n_words"):
        quality.judge(docs)
    with pytest.raises(ValueError, match="200"):
        quality.Rules(common_share=0.001)


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            seen.append({r.doc_id: r.text for r in docs.collect()})
            assert seen[-1].items() <= seen[-2].items()
    bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not any(base_counts(t)[5] for t in seen[2].values())
    groups = defaultdict(list)
    for i, name, _ in brute_classes(list(seen[2].items())):
        groups[name].append(i)
    assert set(seen[3]) == {min(ids) for ids in groups.values()}
    leaks = {i for i, t in seen[3].items() if any(b in t for b in bench)}
    assert leaks and not leaks & set(seen[4])
    last = docs.collect()
    assert {r.doc_id for r in last} == set(seen[4]) and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
    assert corpus_pipeline.run(spark, folder).count() == len(last)


def test_pipeline_stages_pass_any_columns_nulls_and_repeats(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, None, "xx", "s", None), (-3, "12 34", None, None, 5), (-3, "12 34", None, None, 5)], docs.schema)
    clash = ["n_words", "kept", "score", "lang_pred", "_text_hash", "row", "language", "text_hash", "key", "id", "words", "classes", "held_out", "a.b"]
    docs = docs.unionByName(odd)
    for c in clash:
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert 0 < len(rows) < docs.count(), name
        assert all(r["score"] == "score" and r["a.b"] == "a.b" for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
