"""Token counts, piece codec, language and toxicity models, language-model scores: against libraries and brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codestrata.llm import language_id, lm_scoring, piece_codec, token_counts, toxicity

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n\n", "a", "'s", "don't", "é", "　", "\x85", "<|endoftext|>", "<|endo", "½ 1", "▁", "  ▁ x", "<0x41>", "</s>", "不\n不", "\x00", "🙂" * 3, "A" * 5000, "x" * 400 + " y" * 400]


def mixed(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice([*ODD[:-2], " ", chr(rng.choice([0x558, 0x10940, 0x300, rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)]))]) for _ in range(rng.randrange(14)))


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    with open(BYTE, "rb") as f:
        counter = token_counts.MergeCounter(f.read())
    for text in [*ODD, *mixed(1500, 1)]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_piece_codec_equals_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    with open(PIECE, "rb") as f:
        codec = piece_codec.PieceCodec(f.read())
    rng = random.Random(3)
    for text in [*ODD, *mixed(1500, 2)]:
        ids = library.encode(text)
        assert codec.encode(text) == ids, repr(text)
        assert codec.decode(ids) == library.decode(ids)
        assert codec.digest(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))
        assert codec.encode_fast(text).tolist() == ids
        some = [rng.choice([rng.randrange(32000), rng.randrange(259)]) for _ in range(6)]
        assert codec.decode(some) == library.decode(some)


def frame(spark, rows, schema="doc_id long, text string, lang string, n_tokens string"):
    """Documents with a further column whose name clashes with a result's."""
    return spark.createDataFrame(rows, schema)


def test_counts_and_digests_over_odd_tables(spark):
    rows = [(i, t, None, "clash") for i, t in enumerate(ODD)] + [(None, None, None, None), (3, "twice", None, ""), (3, "twice", None, "")]
    docs = frame(spark, rows)
    got = token_counts.count_tokens(docs, BYTE).collect()
    assert len(got) == len(rows)
    null = next(r for r in got if r.doc_id is None)
    assert (null.n_bytes, null.n_tokens, null.over_limit) == (0, 0, False)
    assert next(r for r in got if r.doc_id == len(ODD) - 2).over_limit is True
    assert token_counts.count_tokens(docs.limit(0), BYTE).count() == 0
    got = piece_codec.piece_digests(docs, PIECE).collect()
    assert next(r for r in got if r.doc_id is None).n_tokens == 0 and len(got) == len(rows)
    back = piece_codec.decode_ids(piece_codec.encode_texts(docs, PIECE), PIECE)
    assert back.filter("decoded = coalesce(text, '')").count() == len(rows) - 2  # a literal space sign decodes to a space
    assert piece_codec.encode_checked(docs.limit(0), PIECE).count() == 0


def sample(spark, folder="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_language_id_on_held_out_rows(spark):
    docs = sample(spark)
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang == held.lang_pred).mean() > 0.99
    assert got.score.between(0, 1).all()
    fold = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id}
    assert all(fold[i] == h for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_language_id_edges(spark):
    base = [(i, w, lang, None) for i, (w, lang) in enumerate([("der die das und", "de"), ("the and of that", "en")] * 40)]
    docs = frame(spark, [*base, (900, None, "de", None), (901, "123 !?", "en", None), (902, "", None, None), (None, "the the", "en", None), (903, "字" * 30, None, None), (904, "½ ²", None, None)])
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 904))
    assert got[None].held_out is False and got[None].lang_pred == "en" and got[903].lang_pred in ("de", "en")
    assert {r.lang_pred for r in language_id.identify(frame(spark, [(1, "abc", None, None)])).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_rare_languages_are_learnt_and_too_many_are_an_error(spark):
    # One of 20,001 labelled rows: under the share of 1e-4 that was needed before.
    docs = spark.range(20_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 5, "qqq xxx").otherwise("aa bb").alias("text"), F.when(F.col("id") == 5, "rare").otherwise("usual").alias("lang"))
    model = language_id.fit(docs, F.lit(True))
    assert model.languages == ["rare", "usual"]
    with pytest.raises(ValueError, match="2 languages"):
        language_id.fit(docs, F.lit(True), settings=language_id.Settings(max_languages=1))


def test_language_predictions_by_brute_force(spark):
    docs = sample(spark, "/root/testdata/sf0.001")
    model = language_id.fit(docs, F.col("doc_id") % 2 == 0)
    rows = docs.collect()
    counted = [r for r in rows if r.doc_id % 2 == 0 and r.text is not None and r.lang is not None]

    def grams(text):
        """Hash of each n-gram of each word between its marks, by the letter."""
        out = []
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            w = f"<{w}>"
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    total = sum(ord(c) * int(language_id._STEPS[k]) for k, c in enumerate(w[i : i + n])) % 2**64
                    mixed = ((total ^ (total >> 29)) * 0x9E3779B97F4A7C15 + n) % 2**64
                    out.append(mixed >> (64 - language_id.BITS))
        return out

    some = rng_rows = [r for r in rows if r.text][:25]
    there = Counter(g for r in counted for g in {*grams(r.text)})
    for g in {g for r in some for g in grams(r.text)}:
        assert model.idf[g] == pytest.approx(math.log((1 + len(counted)) / (1 + there[g])) + 1)
    for r in rng_rows:
        own = Counter(grams(r.text))
        logits = model.bias.astype(float).copy()
        for g, n in own.items():
            logits += model.scale * n / max(1, sum(own.values())) * model.idf[g] * model.weights[g]
        logits /= model.temperature
        odds = np.exp(logits - logits.max())
        lang, score = model.predict(r.text)
        if any(c.isalpha() for c in r.text):
            assert lang == model.languages[int(odds.argmax())] and score == pytest.approx(odds.max() / odds.sum(), rel=1e-3)


def test_language_of_long_repeated_and_clashing_rows(spark):
    base = [(i, w, lang, 0.5) for i, (w, lang) in enumerate([("der die das und", "de"), ("the and of that", "en")] * 40)]
    docs = spark.createDataFrame([*base, (900, "the of and " * 100_000, None, 0.5), (901, "the of", None, 0.5), (901, "the of", None, 0.5), (902, "x" * 2_000_000, None, 0.5)], "doc_id long, text string, lang string, score double")
    got = language_id.identify(docs.withColumn("held_out", F.lit(1))).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got if r.doc_id in (900, 901)} == {"en"}
    assert len({r.score for r in got if r.doc_id == 901}) == 1


def test_language_grams_match_a_plain_count():
    words = language_id.words_of("Der Bär, a bé! zz")
    plain = sum(len(f"<{w}>") - n + 1 for w in words for n in range(1, 5) if len(f"<{w}>") >= n)
    grams, counts = language_id.gram_counts("Der Bär, a bé! zz")
    assert counts.sum() == plain and len(grams) == len(set(grams.tolist()))
    many = language_id.WORDS_AT_ONCE
    words = ["ab", "c"] * many
    assert sum(map(len, language_id.grams_of(words))) == many * (4 + 3 + 2 + 1 + 3 + 2 + 1)


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(1200):
        words = rng.sample(plain, 12)
        kind = i % 4
        if kind == 1:
            words.append("insult")
        if kind in (2, 3):
            words.append("grouping")
        if kind == 3:
            words.append("mocking")
        if i % 8 == 0:
            words.append("mocking")  # harmless alone
        rng.shuffle(words)
        rows.append((i, " ".join(words), None, None))
        labels.append((i, int(kind in (1, 3))))
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, known).join(known, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97 and got.score.between(0, 1).all()


def test_toxicity_pairs_among_very_many_terms():
    """Label 1 where just one of two terms occurs: neither says anything alone, and there are 6,000 others."""
    rng = np.random.default_rng(1)

    def some(n):
        for _ in range(n):
            there = rng.random(2) < 0.5
            terms = {*(rng.choice(6000, 60, replace=False) + 10).tolist(), *np.flatnonzero(there).tolist()}
            yield int(there[0] != there[1]), np.array(sorted(terms), np.int32)

    rows, held = list(some(4000)), list(some(1000))
    machine = toxicity.train(rows, 0.5, toxicity.Settings())
    place = {int(n): i for i, n in enumerate(machine.names)}
    raw = lambda t: machine.raw(np.array([place[x] for x in t.tolist() if x in place], np.int64))
    assert np.mean([(raw(t) >= 0) == y for y, t in held]) > 0.93
    again = toxicity.train(rows[::-1], 0.5, toxicity.Settings())
    assert (again.names == machine.names).all() and (again.weights == machine.weights).all()


def test_toxicity_scores_by_brute_force():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)] + ["Ünï", "a1", "longish", "longish2"]
    slots = np.array(sorted({t for w in words[:200] for t in toxicity.word_terms(w.lower())}))
    machine = toxicity.Machine(slots, -0.3, np.random.default_rng(0).normal(0, 0.1, len(slots)), np.random.default_rng(1).normal(0, 0.1, (len(slots), 3)))
    for _ in range(50):
        text = "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(rng.randrange(60)))
        parts = {w for w in re.split(r"[\W_]+", text.lower()) if w}
        terms = {t for w in parts for x in {w, *([w[:4] + "-"] if len(w) > 4 else []), *([w[:5] + "-"] if len(w) > 5 else [])} for t in [zlib.crc32(x.encode()) % toxicity.HASHES]}
        known = [int(np.flatnonzero(slots == t)[0]) for t in terms if t in slots]
        raw = machine.bias + sum(machine.weights[i] for i in known) + sum(machine.vectors[i] @ machine.vectors[j] for i in known for j in known if i < j)
        assert machine.score(text) == pytest.approx(1 / (1 + math.exp(-raw)))


def test_toxicity_of_real_labels_and_odd_rows(spark):
    docs = sample(spark, "/root/testdata/sf0.1").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    odd = spark.createDataFrame([(-1, "word " * 300_000), (-2, "same text"), (-3, "same text"), (-2, "same text"), (None, None)], docs.schema)
    got = toxicity.score_toxicity(docs.unionByName(odd).withColumn("score", F.lit(1.0)).withColumn("held_out", F.lit(1)), labels).toPandas()
    assert len(got) == docs.count() + 5 and got.columns.tolist() == ["doc_id", "held_out", "score", "predicted"]
    assert got[got.doc_id.isin([-2, -3])].score.nunique() == 1 and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(labels.toPandas().dropna(subset=["toxic"]), on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.97


def test_toxicity_edges(spark):
    docs = frame(spark, [(1, None, None, None), (2, "", None, None), (None, "x", None, None), (3, "a b", None, None)])
    none = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, none)
    assert got.count() == 4 and all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_lm_base_scores_by_brute_force_and_model_is_better(spark):
    docs = sample(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "The the unseen-word"), (10_000, None), (10_001, "A\x0bB  a"), (10_001, "A\x0bB  a")], docs.schema)
    docs = docs.unionByName(extra)
    got = lm_scoring.score_documents(docs, settings=lm_scoring.Settings(head_share=1e-3)).toPandas()
    rows = docs.toPandas()
    words = re.compile(r"[^\x20\x09-\x0D]+")
    tokens = [(i, [*words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in zip(rows.doc_id, rows.text, strict=True)]
    counts = Counter(t for i, ts in tokens if i == i and i is not None and zlib.crc32(str(int(i)).encode()) % 10 for t in ts)
    n, v = sum(counts.values()), len(counts)
    expect = sorted((len(ts), sum(counts[t] > 0 for t in ts), round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6)) for _, ts in tokens)
    assert np.array(sorted(zip(got.n_tokens, got.n_known, got.base_score.round(6), strict=True))) == pytest.approx(np.array(expect), abs=1e-5)
    assert (got.train_tokens == n).all()
    seen = got[~got.held_out]
    assert seen.score.sum() > seen.base_score.sum()


def lm_network(settings, counts=(4, 9, 8, 7, 6, 5, 4, 3, 2)):
    """A network over a small vocabulary, its first words output words and the others in tails."""
    words = np.array([lm_scoring.END, *range(11, 10 + len(counts))], np.uint64)
    counts, tails = np.array(counts), np.arange(len(words)) % 4
    mass, kinds = np.bincount(tails, counts, lm_scoring.TAILS), np.bincount(tails, minlength=lm_scoring.TAILS)
    return lm_scoring.Network(lm_scoring.Vocabulary(words, counts, tails, mass, kinds.astype(float), int(counts.sum()), len(words), settings), settings)


def test_lm_trains_on_all_training_documents(spark):
    docs = spark.createDataFrame([(k, "tick tock " * 60) for k in range(24)], "doc_id long, text string")
    whole = lm_scoring.score_documents(docs).toPandas()
    assert whole.score.sum() > 0.8 * whole.base_score.sum()
    net, _, encoded = lm_scoring.fit(docs, F.lit(True), F.lit(False), id_col="doc_id", text_col="text", settings=lm_scoring.Settings(rounds=3))
    assert net.updates > 0 and encoded.filter("round >= 0").count() == 24 and encoded.select("round").distinct().count() == 3


def test_lm_scores_do_not_depend_on_the_layout(spark):
    docs = spark.createDataFrame(sample(spark).select("doc_id", "text").orderBy("doc_id").limit(400).collect(), "doc_id long, text string")
    settings = lm_scoring.Settings(shard_tokens=20_000, rounds=2, least_updates=30)
    first, bits = None, []
    for parts in (1, 4, 16, 64):
        got = lm_scoring.score_documents(docs.repartition(parts, F.rand(parts)), settings=settings).toPandas().sort_values("doc_id", ignore_index=True)
        held = got[got.held_out]
        bits.append(-held.score.sum() / held.n_tokens.sum() / math.log10(2))
        first = got if first is None else first
        assert got.score.to_numpy() == pytest.approx(first.score.to_numpy(), rel=1e-3)
    assert max(bits) - min(bits) < 0.001
    base = first[first.held_out]
    assert bits[0] < -base.base_score.sum() / base.n_tokens.sum() / math.log10(2) - 0.3


def test_lm_tokens_equal_a_plain_split():
    texts = [None, "", "A b", "b", " x\ty ", "É" * 3, "long " * 50, "n" * 300, ""]
    plain = [[w.encode().lower() if w.isascii() else w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    import pyarrow as pa

    names, ends = {}, set()
    old = lm_scoring.PIECE
    try:
        for piece in (old, 40):
            lm_scoring.PIECE = piece
            for array in (pa.array(texts), pa.array(["skipped", *texts]).slice(1)):
                seen = 0
                for at, words, tails, begins in lm_scoring.tokens(array):
                    assert at == seen
                    for k in range(len(begins) - 1):
                        own, tail = words[begins[k] : begins[k + 1]], tails[begins[k] : begins[k + 1]]
                        assert len(own) == len(plain[at + k]) + 1 and own[-1] == lm_scoring.END and tail[-1] == 0
                        for w, h, t in zip(plain[at + k], own.tolist(), tail.tolist(), strict=False):
                            assert names.setdefault(w, (h, t)) == (h, t)
                            assert t == ((w[-1] * 31 + (w[-2] if len(w) > 1 else 32) * 7) % lm_scoring.TAILS)
                    seen += len(begins) - 1
                assert seen == len(texts)
    finally:
        lm_scoring.PIECE = old
    assert len({h for h, _ in names.values()}) == len(names) and not ends


def test_lm_look_up_equals_a_dictionary():
    rng = np.random.default_rng(0)
    words = np.unique(np.append(rng.integers(0, 2**63, 3000, dtype=np.uint64), np.array([0, 1, 2, 2**40, 2**41], np.uint64)))
    v = lm_scoring.Vocabulary(words, np.ones(len(words), int), np.zeros(len(words), int), np.zeros(lm_scoring.TAILS), np.zeros(lm_scoring.TAILS), 1, 1, lm_scoring.Settings(vocabulary=5))
    asked = np.concatenate([rng.permutation(words), rng.integers(0, 2**63, 500, dtype=np.uint64)])
    place = {int(w): i for i, w in enumerate(v.words)}
    assert v.look_up(asked).tolist() == [place.get(int(w), -1) for w in asked]


def test_lm_distribution_sums_to_one_and_documents_are_scored_apart():
    settings = lm_scoring.Settings(vocabulary=6, window=3, score_streams=2)
    net = lm_network(settings)
    every = np.arange(len(net.vocabulary.label))
    state = np.random.default_rng(0).normal(0, 1, (1, settings.hidden)).astype(np.float32)
    assert np.exp(net.output(np.repeat(state, len(every), 0), every)[0]).sum() == pytest.approx(1, abs=1e-4)
    end = net.vocabulary.end
    a, b, c, d = [i for i in every.tolist() if i != end][:4]
    docs = [[a, b, c, d, 8, a, end], [end], [c, a, a, 8, end], [a] * 10 + [end], [a] * 10 + [end]]

    def alone(doc):
        """Token by token, with nothing packed."""
        h, last, total = np.zeros((1, settings.hidden), np.float32), end, 0.0
        for t in doc:
            h = net.step((net.p["embed"][[last]] @ net.p["wx"]) + net.p["b"], h)[0]
            total, last = total + float(net.output(h, np.array([t]))[0][0]), t
        return total

    flat, begins = np.concatenate(docs).astype(np.int32), np.cumsum([0, *map(len, docs)])
    assert net.score(flat, begins) == pytest.approx([alone(d) for d in docs], rel=1e-4)


def test_lm_gradients_match_differences():
    settings = lm_scoring.Settings(vocabulary=5, hidden=4, embedding=3)
    net = lm_network(settings)
    net.flat[:] = net.flat.astype(np.float32) + np.random.default_rng(2).normal(0, 0.3, len(net.flat)).astype(np.float32)
    end = net.vocabulary.end
    given = np.array([[end, 1, 2], [3, end, 1], [2, 4, end], [1, 7, 5]], np.int32)
    wanted = np.array([[3, end, 1], [2, 4, end], [1, 7, 5], [9, 2, 3]], np.int32)
    there = np.ones((4, 3), bool)
    there[3, 2] = False
    gradient, state = np.zeros_like(net.flat), np.random.default_rng(1).normal(0, 0.5, (3, 4)).astype(np.float32)
    net.gradient(given, wanted, there, state, net.views(gradient))
    names = {k: np.full(x.shape, i) for i, (k, x) in enumerate(net.p.items())}
    kinds = np.concatenate([x.ravel() for x in names.values()])
    scratch = np.zeros_like(net.flat)
    for kind, name in enumerate(names):  # the largest entries of every parameter, those of the recurrent part among them
        for at in sorted(np.flatnonzero(kinds == kind), key=lambda i: -abs(gradient[i]))[:6]:
            keep, loss = net.flat[at], []
            for step in (1e-2, -1e-2):
                net.flat[at] = keep + step
                loss.append(net.gradient(given, wanted, there, state, net.views(scratch))[0])
            net.flat[at] = keep
            assert gradient[at] == pytest.approx((loss[0] - loss[1]) / 2e-2, rel=2e-2, abs=3e-3), name


def test_lm_scores_long_repeated_and_clashing_rows(spark):
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    rows = [(1, long, 0.5, True), (1, long, 0.5, True), (2, "a b", None, None), (3, "a b", None, None), (None, None, None, None), (4, "x" * 3_000_000, None, None), (5, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean")
    got = lm_scoring.score_documents(docs).toPandas()
    assert sorted(got.n_tokens) == [1, 1, 2, 3, 3, 60_001, 60_001] and np.isfinite(got.score).all()
    by = got.groupby("n_tokens").score
    assert (by.max() - by.min()).abs().max() < 1e-2 and got.columns.tolist()[:2] == ["doc_id", "held_out"]


def test_lm_without_training_rows(spark):
    docs = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    row = lm_scoring.score_documents(docs).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score == row.base_score == pytest.approx(0)
    assert lm_scoring.score_documents(docs.limit(0)).count() == 0
    assert docs.select(F.lit(1)).count() == 1
