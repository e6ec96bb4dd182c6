"""Core operators on small fixtures: known answers, brute force, nulls, empties, ties, copies."""

import itertools
import math
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import backoff, classify, continuations, corpus, generate, morphology, ngrams, ranges, skew, smoothing, subword, tagging, vectors
from lexispark.sources.tables import latest_once, latest_once_wide

DOCS = [(1, ["a", "b"]), (2, []), (3, ["a"]), (4, ["a", "b", "c", "a"]), (7, ["c"]), (250_000, ["a", "b", "c"])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, toks array<string>")


def test_corpus_ngrams_cross_borders(spark, docs):
    flat = [t for _, ts in DOCS for t in ts]
    want = Counter(tuple(flat[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(flat) - n + 1))
    got = ngrams.ngram_counts(docs, "id", "toks", [1, 2, 3, 4], "corpus").collect()
    assert {tuple(r.gram): r.cnt for r in got} == dict(want)
    small = ngrams.crossing(docs, "id", "toks", [2, 3, 4], part_rows=2).collect()
    assert Counter(tuple(r.gram) for r in small) == want - Counter(tuple(ts[i : i + n]) for _, ts in DOCS for n in (1, 2, 3, 4) for i in range(len(ts) - n + 1))
    inside = ngrams.ngram_counts(docs, "id", "toks", [2], "row").collect()
    assert {tuple(r.gram): r.cnt for r in inside} == {("a", "b"): 3, ("b", "c"): 2, ("c", "a"): 1}
    with pytest.raises(ValueError):
        ngrams.ngram_counts(docs, "id", "toks", [2], "page")
    assert ngrams.ngram_counts(docs.where("false"), "id", "toks", [1, 2], "corpus").count() == 0


def test_smoothing_and_scores(spark, docs):
    counts = ngrams.ngram_counts(docs, "id", "toks", [1, 2], "row")
    p = {(tuple(r.gram), r.method): r.p for r in smoothing.additive(counts, 0.5).collect()}
    assert math.isclose(p[("a",), "add_one"], (5 + 1) / (11 + 3)) and math.isclose(p[("a",), "add_k"], 5.5 / 12.5) and math.isclose(p[("a",), "token_type"], 1 / 3)
    model = smoothing.select_model(smoothing.additive(counts), 2, "add_one").select("n", "gram", "p")
    value = {"log_p": F.coalesce("p", F.lit(1e-10))}
    scores = {(r.id, r.n): r for r in smoothing.score_sentences(docs, "id", "toks", model, [2], value).collect()}
    assert set(scores) == {(1, 2), (3, 2), (4, 2), (7, 2), (250_000, 2)} and scores[4, 2].grams == 3  # the one without tokens is no sentence
    assert scores[3, 2].log_p is None and scores[3, 2].grams == 0 and all(r.token_count == len(dict(DOCS)[i]) for (i, _), r in scores.items())
    short = {r.id: r.log_p for r in smoothing.score_sentences(docs, "id", "toks", model, [2], value, short=1e-10).collect()}
    assert math.isclose(short[3], math.log(1e-10)) and math.isclose(short[1], scores[1, 2].log_p)
    report = {r.n: r for r in smoothing.summary_report(counts).collect()}
    assert report[1].tokens == 11 and report[1].total_unique_ngrams == 3 and report[2].vocab_size == 3 and report[2].techniques == "add_one, add_k, token_type"
    for bad in ((5, "add_one"), (2, "other")):
        with pytest.raises(ValueError):
            smoothing.select_model(smoothing.additive(counts), *bad)


def test_ranges_hold_for_random_keys(spark):
    rng = random.Random(3)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(20_000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    bounds = ranges.range_bounds(df, "k", 500)
    sizes = [r["count"] for r in df.select(ranges.range_part(F.col("k"), bounds).alias("p")).groupBy("p").count().collect()]
    assert len(sizes) == 40 and max(sizes) <= 2 * len(keys) / len(sizes)
    # the work itself: no task of the ordered windows holds more than twice the mean
    placed = ranges.ranked(df.withColumn("p", ranges.range_part(F.col("k"), ranges.range_bounds(df, "k", 100))), "p", [F.col("k")], "place")
    assert [r.k for r in placed.orderBy("place").collect()] == sorted(keys) and placed.agg(F.max("place")).first()[0] == len(keys)
    tasks = [r["count"] for r in placed.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    assert max(tasks) <= 2 * len(keys) / len(tasks)
    assert ranges.range_bounds(df.where("false"), "k") == [] and ranges.range_bounds(df.select(F.lit(None).cast("long").alias("k")), "k") == []


def test_ordered_operators_on_random_keys(spark):
    rng = random.Random(5)
    docs = [(rng.randrange(-(2**63), 2**63), [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 4))]) for _ in range(700)]
    df = spark.createDataFrame(docs, "id long, toks array<string>")
    docs.sort()
    flat = [t for _, ts in docs for t in ts]
    got = ngrams.within(df, "toks", [1, 2, 3, 4]).unionByName(ngrams.crossing(df, "id", "toks", [1, 2, 3, 4], part_rows=50)).collect()
    assert Counter(tuple(r.gram) for r in got) == Counter(tuple(flat[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(flat) - n + 1))
    ids = {r.term: r.term_id for r in vectors.first_seen_vocabulary(df, "id", "toks", part_rows=50).collect()}
    assert sorted(ids, key=ids.get) == list(dict.fromkeys(flat)) and sorted(ids.values()) == list(range(len(ids)))
    folds = {r.id: r.fold for r in classify.k_folds(df, "id", 3, part_rows=50).collect()}
    assert [folds[i] for i, _ in docs] == [min(j // (700 // 3), 2) for j in range(700)]


def test_perplexity_and_comparison(spark):
    scores = spark.createDataFrame([("1", -10.0), ("1", -20.0), ("1", -800.0), ("1", None), ("2", -12.0), ("mixed", -12.0), ("3", -800.0)], "model string, log_p double")
    rows = {r.model: r for r in smoothing.compare_models(smoothing.perplexity(scores, "model")).collect()}
    assert (rows["1"].sentences, rows["1"].valid, rows["1"].avg_log_p) == (4, 2, -15.0) and math.isclose(rows["1"].perplexity, math.exp(15), rel_tol=1e-6)
    assert rows["3"].valid == 0 and rows["3"].avg_log_p is None and rows["3"].perplexity is None
    assert {r.best for r in rows.values()} == {"2"} and math.isclose(rows["mixed"].improvement, 0.0, abs_tol=1e-9) and rows["1"].improvement is None
    assert smoothing.perplexity(scores.where("false"), "model").count() == 0


def test_good_turing(spark):
    grams = [("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 4)]
    counts = spark.createDataFrame([(1, [g], c) for g, c in grams], "n int, gram array<string>, cnt long")
    model, unseen = smoothing.good_turing(counts)
    p = {r.gram[0]: r.p for r in model.collect()}
    assert math.isclose(p["a"], (2 * 1 / 3) / 9) and math.isclose(p["d"], 2 / 9) and math.isclose(p["e"], 4 / 9)
    u = unseen.first()
    assert math.isclose(u.c_zero, 3 / 5) and math.isclose(u.p_unseen, 3 / 5)
    table = smoothing.good_turing_table(counts).orderBy("cnt").collect()
    assert [r.cnt for r in table] == [0, 1, 2, 4] and table[0].nc is None


def test_em_weights(spark):
    quads = spark.createDataFrame([(0.9, 0.1, 0.1, 0.1), (0.8, 0.1, 0.1, 0.2), (0.0, 0.0, 0.0, 0.0)], "p1 double, p2 double, p3 double, p4 double")
    trail = smoothing.optimise_lambdas(quads, 30)
    assert all(math.isclose(sum(w), 1) for w in trail) and trail[-1][0] > 0.999
    assert smoothing.optimise_lambdas(quads.where("false"), 2)[-1] == (0.25,) * 4
    assert smoothing.lambda_analysis((1.0, 0.0, 0.0, 0.0))["strongest"] == 1


def test_kneser_ney_discount_of_a_known_corpus(spark):
    rows = [(1, [f"a{i}"], 1) for i in range(470)] + [(1, [f"b{i}"], 2) for i in range(103)]
    d = backoff.kn_discounts(spark.createDataFrame(rows, "n int, gram array<string>, cnt long")).first().d
    assert math.isclose(d, 0.6952662721893491)


def python_model(kind, docs):
    flat = [t for _, ts in docs for t in ts]
    c = {n: Counter(tuple(flat[i : i + n]) for i in range(len(flat) - n + 1)) for n in (1, 2, 3)}
    probs, alpha = {}, {}
    if kind == "katz":
        total = sum(c[1].values())
        probs.update({g: k / total for g, k in c[1].items()})
        for n in (2, 3):
            nc = Counter(c[n].values())
            d = {g: (k if k > 5 else (k + 1) * nc[k + 1] / nc[k] if nc[k + 1] else max(k - 0.5, 0)) for g, k in c[n].items()}
            for h in {g[:-1] for g in d}:
                s = sum(v for g, v in d.items() if g[:-1] == h)
                probs.update({g: v / s for g, v in d.items() if g[:-1] == h})
                alpha[h] = 0.0
    else:
        cont = Counter(g[1] for g in c[2])
        probs.update({(w,): k / sum(cont.values()) for w, k in cont.items()})
        for n in (2, 3):
            n1, n2 = (sum(1 for v in c[n].values() if v == k) for k in (1, 2))
            d = max(0.5, min(0.95, n1 / (n1 + 2 * n2))) if n1 and n2 else 0.75
            for h in {g[:-1] for g in c[n]}:
                of = {g: v for g, v in c[n].items() if g[:-1] == h}
                probs.update({g: max(v - d, 0) / sum(of.values()) for g, v in of.items()})
                alpha[h] = d * len(of) / sum(of.values())
    v = len(c[1])

    def score(g):
        g = g[-3:]
        if g in probs:
            return probs[g]
        return 1 / (1000 * v) if len(g) == 1 else alpha.get(g[:-1], 1.0) * score(g[1:])

    return score, sorted({g[0] for g in c[1]})


def best_text(score, vocab, depth):
    """The likeliest ended text of at most ``depth`` steps, all texts tried."""
    ended = []
    for n in range(depth):
        for text in itertools.product(vocab, repeat=n):
            p = 0.0
            for i, w in enumerate([*text, "</s>"]):
                context = text[max(0, i - 2) : i]
                p += math.log(score((*context, w)) / sum(score((*context, x)) for x in [*vocab, "</s>"]))
            ended.append((-p, list(text)))
    return min(ended)[1]


@pytest.mark.parametrize("kind", ["katz", "kn"])
def test_backoff_and_generation_against_python(spark, docs, kind):
    counts = ngrams.ngram_counts(docs, "id", "toks", [1, 2, 3], "corpus")
    model, alphas = backoff.katz_model(counts) if kind == "katz" else backoff.kn_model(counts)
    score, vocab = python_model(kind, DOCS)
    asked = [list(g) for n in (1, 2, 3, 4) for g in itertools.product(["a", "b", "z"], repeat=n)]
    rows = backoff.backoff_score(spark.createDataFrame([(g,) for g in asked], "gram array<string>"), "gram", model, alphas, 3, 3).collect()
    assert len(rows) == len(asked)
    for r in rows:
        assert math.isclose(r.p, score(tuple(r.gram)), abs_tol=1e-12), r.gram
    words = spark.createDataFrame([(w,) for w in vocab], "word string")
    text, context = [], ()
    for _ in range(5):
        options = {w: score((*context, w)) for w in [*vocab, "</s>"]}
        ranked = sorted(options, key=lambda w: (-options[w], w))
        if ranked[0] == "</s>" and len(text) >= 3:
            break
        word = next(w for w in ranked if w != "</s>")
        text.append(word)
        context = tuple(text[-2:])
    got = generate.greedy(words, model, alphas, 3, 3, max_length=5)
    assert len(got) == len(text)
    if kind == "kn":
        assert got == text
        assert generate.beam(words, model, alphas, 3, 3, max_length=3, width=50) == best_text(score, vocab, 3)
    p = {r.word: r.p for r in generate.next_word_probs([("a",)], words, model, alphas, 3, 3).collect()}
    assert math.isclose(sum(p.values()), 1) and set(p) == {*vocab, "</s>"}
    assert generate.copies(spark, ["x", "y"], 3).count() == 3


def test_pmi_and_vectors(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "z"), ("b", "b")], "w1 string, w2 string")
    ones = spark.createDataFrame([("a", 4), ("b", 4)], "word string, cnt long")
    twos = spark.createDataFrame([("a", "b", 2), ("b", "a", 2)], "w1 string, w2 string, cnt long")
    got = {(r.w1, r.w2): r.pmi for r in vectors.bigram_pmi(pairs, ones, twos).collect()}
    assert math.isclose(got["a", "b"], math.log((2 / 4) / (4 / 8 * 4 / 8))) and got["a", "z"] is None and got["b", "b"] is None
    docs = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0), (2, "x", 1.0), (3, "z", 1.0), (4, "x", 2.0)], "id long, term string, value double")
    n = vectors.cosine_neighbours(docs.where("id = 1"), docs, k=2, exclude_self=True).orderBy("place").collect()
    assert [(r.neighbour, r.score) for r in n] == [(2, 0.707107), (4, 0.707107)]
    filled = vectors.cosine_neighbours(docs.where("id = 3"), docs, k=3, fill=docs.select("id").distinct()).orderBy("place").collect()
    assert [r.neighbour for r in filled] == [3, 1, 2]
    count = lambda d: d.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    s = vectors.similarity_statistics(docs, docs, count(docs), count(docs)).first()
    assert math.isclose(s.max, 1.0, rel_tol=1e-6) and s.min == 0.0
    vocab = spark.createDataFrame([(5, ["q", "b"]), (1, ["b", "a", "b"]), (20_000, ["z"])], "id long, toks array<string>")
    assert {r.term: r.term_id for r in vectors.first_seen_vocabulary(vocab, "id", "toks").collect()} == {"b": 0, "a": 1, "q": 2, "z": 3}


MESSAGES = [
    ("Check out https://example.com for more info!", "Inform"), ("Order 3 items, get 1 free! Limited offer!!!", "Promo"), ("Your package #12345 will arrive tomorrow.", "Inform"),
    ("Win $1000 now, visit http://winbig.com!!!", "Promo"), ("Meeting at 3pm, don't forget to bring the files.", "Reminder"), ("Exclusive deal for you: buy 2, get 1 free!!!", "Promo"),
    ("Download the report from https://reports.com.", "Inform"), ("The meeting is starting in 10 minutes.", "Reminder"), ("Reminder: submit your timesheet by 5pm today.", "Reminder"),
]


def test_naive_bayes_known_scores(spark):
    train = classify.message_features(spark.createDataFrame([(i, *m) for i, m in enumerate(MESSAGES)] + [(99, None, None)], "id long, text string, label string"), "text")
    test = classify.message_features(spark.createDataFrame([(1, "You will get an exclusive offer in the meeting!")], "id long, text string"), "text")
    counts = classify.feature_counts(train, "label", F.col("bigrams"))
    assert counts.select("feature").distinct().count() == 70
    assert {r.label: r.t for r in counts.groupBy("label").agg(F.sum("cnt").alias("t")).collect()} == {"Inform": 17, "Promo": 31, "Reminder": 29}
    scores = {r.label: r.score for r in classify.nb_scores(test, "id", F.col("bigrams"), counts, classify.class_counts(train, "label"), 0.3, True, False).collect()}
    for label, want in {"Inform": -47.1578, "Promo": -50.5155, "Reminder": -50.7331}.items():
        assert abs(scores[label] - want) < 1e-4
    best = classify.best_label(classify.nb_scores(test, "id", F.col("bigrams"), counts, classify.class_counts(train, "label"), 0.3, True, False), "id")
    assert best.first().predicted == "Inform"


def test_splits_and_report(spark):
    df = spark.range(1003).withColumnRenamed("id", "doc_id")
    parts = Counter(r.part for r in classify.split_by_ratio(df, "doc_id").collect())
    assert parts == {"train": 802, "val": 100, "test": 101}
    assert Counter(r.part for r in classify.split_by_count(df, "doc_id", 50).collect()) == {"train": 903, "val": 50, "test": 50}
    folds = {r.doc_id: r.fold for r in classify.k_folds(df, "doc_id", 3).collect()}
    assert [folds[0], folds[333], folds[334], folds[1002]] == [0, 0, 1, 2]
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "t string, p string")
    r = classify.classification_report(rows, "t", "p").first()
    assert (r.accuracy, r.macro_precision, r.macro_recall, r.macro_f1) == (0.5, 0.75, 0.5, 0.583333)


def test_viterbi_matches_one_sentence_at_a_time():
    """Side by side, with many tags and few seen steps, against every previous tag tried; ties go to the smaller tag."""
    rng = np.random.default_rng(2)
    tags = [f"t{i:02}" for i in range(12)]
    seen = [(tags[a], tags[b], int(n)) for a, b, n in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.integers(1, 9, 40))]
    seen = list({(a, b): (a, b, n) for a, b, n in seen}.values()) + [("<START>", "t03", 4), ("t05", "<END>", 2)]
    totals = {t: 30 for t in tags} | {"<START>": 4}
    moves = tagging.Moves(tags, totals, seen, 14)
    count = {(a, b): n for a, b, n in seen}
    step = lambda a, b: math.log((count.get((a, b), 0) + 1) / (totals[a] + 14))
    sizes = [3, 1, 7, 2, 7, 1]
    scores = np.log(rng.random((sum(sizes), 12)))
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    got = tagging.viterbi(scores, begin, moves)
    for low, n in zip(begin, sizes):
        layer = {t: step("<START>", t) + scores[low, i] for i, t in enumerate(tags)}
        for k in range(1, n):
            layer = {t: max(layer[p] + step(p, t) for p in tags) + scores[low + k, i] for i, t in enumerate(tags)}
        path = [tags[i] for i in got[low : low + n]]
        score = sum(step(a, b) + scores[low + k, tags.index(b)] for k, (a, b) in enumerate(zip(["<START>", *path], path)))
        assert math.isclose(score, max(layer.values()))
    assert len(tagging.viterbi(np.zeros((0, 12)), np.zeros(0, dtype=np.int64), moves)) == 0
    flat = tagging.Moves(["a", "b"], {}, [], 4)
    assert list(tagging.viterbi(np.zeros((3, 2)), np.array([0]), flat)) == [0, 0, 0]


def test_viterbi_against_all_paths(spark):
    random.seed(3)
    rows = [(i, [random.choice("uvwxyz") for _ in range(n)], n) for i, n in enumerate([1, 2, 3, 4, 3, 2, 4])]
    tagged = spark.createDataFrame([(i, w, [random.choice(["N", "V", "A"]) for _ in w]) for i, w, _ in rows], "id long, words array<string>, tags array<string>")
    moves, seen = tagging.hmm_transitions(tagged), tagging.hmm_emissions(tagged)
    totals = {r.tag: r.total for r in tagging.tag_counts(moves, seen).collect()}
    t, e = Counter({(r.prev, r.tag): r.cnt for r in moves.collect()}), Counter({(r.tag, r.word): r.cnt for r in seen.collect()})
    tags, vocab = ["A", "N", "V"], len({w for _, w in e})
    asked = [(1, ["u", "q", "v"]), (2, ["x"]), (3, ["z", "z", "y", "u"])]
    got = tagging.decode(spark.createDataFrame([*asked, (4, [])], "id long, words array<string>"), "id", "words", moves, seen).collect()
    for i, words in asked:

        def score(path, words=words):
            s, prev = 0.0, tagging.START
            for tag, w in zip(path, words):
                s += math.log((t[prev, tag] + 1) / (totals[prev] + 5)) + math.log((e[tag, w] + 1) / (totals[tag] + vocab))
                prev = tag
            return s

        path = [r.tag for r in sorted(got, key=lambda r: r.pos) if r.id == i]
        assert math.isclose(score(path), max(score(p) for p in itertools.product(tags, repeat=len(words))))
    assert not [r for r in got if r.id == 4]
    assert totals[tagging.START] == 7


def regex_joined(symbols, pair):
    """The pair joined by rewriting the symbols as one string."""
    marked = "\x00" + "\x00\x00".join(symbols) + "\x00"
    return marked.replace(f"\x00{pair[0]}\x00\x00{pair[1]}\x00", f"\x00{pair[0]}{pair[1]}\x00").strip("\x00").split("\x00\x00")


def test_long_words_count(spark):
    """No word is too long: a frequent one of 50 characters wins the merges, and long runs have all their pieces and tries."""
    long = "".join(chr(ord("a") + i % 26) for i in range(50))
    words = spark.createDataFrame([(long, 1000), ("ab", 1), ("q" * 70, 2)], "word string, freq long")
    merges = subword.bpe_train(words, 49)
    assert {r.word: r.pieces for r in subword.bpe_encode(words, merges).collect()}[long] == [long]
    pieces = {}
    for r in subword.word_pieces(words).collect():
        pieces.setdefault(r.word, []).append(r.piece)
    for w, got in pieces.items():
        want = {("##" if i else "") + w[i:j] for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        assert len(got) == len(set(got)) and set(got) == want
    scores = {r.piece: r.score for r in subword.piece_scores(words).collect()}
    assert scores[long] == 1000 / 50 and scores["##" + long[1:]] == 1000 / 49 and scores["ab"] == 1001 / 2 and set(scores) == set().union(*pieces.values())
    counts = morphology.word_counts(spark.createDataFrame([("x" * 100,), ("y" * 100 + "a",), ("y" * 100 + "b",)], "w string"), "w")
    assert counts.count() == 3
    split = {r.word: r.split_at for r in morphology.best_split(counts, 2).collect()}
    assert split == {"y" * 100 + "a": 100, "y" * 100 + "b": 100}


def test_subwords(spark):
    texts = ["low lower lowest", "new newer newest low", "क्या यह नया है", None, ""]
    words = subword.word_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    freqs = {r.word: r.freq for r in words.collect()}
    merges = subword.bpe_train(words, 8)
    learnt = [(r.left, r.right) for r in merges.orderBy("rank").collect()]

    def naive(n):
        splits, out = {w: list(w) for w in freqs}, []
        while len(out) < n:
            stats = Counter()
            for w, s in splits.items():
                for p in zip(s, s[1:]):
                    stats[p] += freqs[w]
            if not stats:
                break
            best = min(stats, key=lambda p: (-stats[p], p))
            out.append(best)
            splits = {w: regex_joined(s, best) for w, s in splits.items()}
        return out, splits

    want, splits = naive(8)
    assert learnt == want
    encoded = {r.word: r.pieces for r in subword.bpe_encode(words, merges).collect()}
    assert encoded == splits and all("".join(p) == w for w, p in encoded.items())
    assert subword.learn_merges({"ab": 1}, 10) == [("a", "b", 1)]
    scores = {r.piece: r.score for r in subword.piece_scores(words).collect()}
    assert math.isclose(scores["lo"], sum(f for w, f in freqs.items() if "lo" in w) / 2) and math.isclose(scores["##we"], sum(f for w, f in freqs.items() if "we" in w) / 2)
    vocab = subword.wordpiece_vocab(words, 40)
    pieces = {r.piece for r in vocab.collect()}
    assert len(pieces) == 40 and "[UNK]" in pieces
    new = spark.createDataFrame([("lowx",), ("Q",)], "word string")
    got = {r.word: r.pieces for r in subword.wordpiece_encode(new, vocab).collect()}
    assert got["Q"] == ["[UNK]"] and got["lowx"][-1] == "[UNK]"


def test_trie_split_against_python(spark):
    random.seed(4)
    words = ["".join(random.choice("abcd") for _ in range(random.randrange(1, 6))) for _ in range(400)]
    counts = morphology.word_counts(spark.createDataFrame([(w,) for w in [*words, "", "x" * 100]], "w string"), "w")
    c = Counter(p for w in words for p in (w[:i] for i in range(1, len(w) + 1)))
    want = {}
    for w in set(words):
        best = None
        for i in range(1, len(w) + 1):
            kids = [v for p, v in c.items() if len(p) == i + 1 and p.startswith(w[:i])]
            if len(kids) >= 3:
                s = round((1 - max(kids) / c[w[:i]]) * len(kids), 9)
                if s > 0 and (best is None or (s, i) > best[:2]):
                    best = (s, i, c[w[:i]])
        if best:
            want[w] = (best[1], best[0], best[2])
    got = {r.word: (r.split_at, r.score, r.support) for r in morphology.best_split(counts, 3).collect()}
    assert got == want
    with pytest.raises(ValueError):
        morphology.stem_words(counts, "middle")


def test_corpus_statistics_of_nothing(spark):
    from lexispark.functions.text import blank_tokens, sentence_split

    df = spark.createDataFrame([(None,), ("",)], "text string")
    r = corpus.corpus_stats(df, sentence_split(F.col("text")), blank_tokens).first()
    assert tuple(r) == (0, 0, 0, 0, 0.0, 0.0)


def test_deliveries_count_once(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = [(1, "old", t(1), 0), (1, "new", t(2), 0), (2, "x", t(1), 0), (None, "n", t(1), 0), (None, "n", t(1), 0), (None, "m", t(1), 0), (3, "b", t(1), 0), (3, "a", t(1), 0)]
    df = spark.createDataFrame(rows, "id long, v string, at timestamp, n int")
    for f in (latest_once, latest_once_wide):
        assert sorted((str(r.id), r.v) for r in f(df, ["id"], ["at"]).collect()) == [("1", "new"), ("2", "x"), ("3", "b"), ("None", "m"), ("None", "n")]
        assert f(df.where("false"), ["id"], ["at"]).count() == 0


def test_skewed_joins(spark):
    left = spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("a")).withColumn("k", F.when(F.col("a") % 3 == 0, 0).otherwise(F.col("k")))
    right = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("b"))
    plain = left.join(right, "k").agg(F.count(F.lit(1)), F.sum(F.col("a") * F.col("b"))).first()
    salted = skew.salted_join(left, right, ["k"], "b", rows_per_salt=100, parts=50).agg(F.count(F.lit(1)), F.sum(F.col("a") * F.col("b"))).first()
    assert tuple(plain) == tuple(salted)
    values = left.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("a").alias("m"))
    assert skew.lookup_join(left, values, "k", "w").count() == 2000
    assert skew.hot_keys(values, "k", "w", parts=2).count() <= 2


def test_blocks_do_not_change_neighbours(spark):
    """Small blocks against one block against all pairs; ties, fill, alignment, self and empty sides."""
    rng = random.Random(4)
    cell = [(i, f"t{rng.randrange(25)}", float(rng.randint(1, 3))) for i in range(60) for _ in range(4)]
    rows = {(i, t): v for i, t, v in cell}
    rows |= {(60 + k, t): v for (i, t), v in list(rows.items()) if i == 7 for k in range(3)}  # copies: ties
    df = spark.createDataFrame([(i, t, v) for (i, t), v in rows.items()], "id long, term string, value double")
    asked = df.where("id % 5 = 0").unionByName(spark.createDataFrame([(1000, "unknown", 1.0)], "id long, term string, value double"))

    def brute(base_terms=None, itself=False):
        docs = {}
        for r in df.collect():
            if base_terms is None or r.term in base_terms:
                docs.setdefault(r.id, {})[r.term] = r.value
        norm = {i: math.sqrt(sum(v * v for v in d.values()) + 1e-12) for i, d in docs.items()}
        out = set()
        for q in (i for i in docs if i % 5 == 0):
            near = [(-round(sum(v * docs[b].get(t, 0) for t, v in docs[q].items()) / norm[q] / norm[b], 6), b) for b in docs if docs[q].keys() & docs[b].keys() and not (itself and b == q)]
            out |= {(q, b, -s, k + 1) for k, (s, b) in enumerate(sorted(near)[:5])}
        return out

    for entries in (30, 10**6):
        got = {(r.query, r.neighbour, r.score, r.place) for r in vectors.cosine_neighbours(asked, df, exclude_self=True, block_entries=entries).collect()}
        assert got == brute(itself=True)
        some = {f"t{i}" for i in range(12)}
        vocabulary = spark.createDataFrame([(t,) for t in some], "term string")
        got = {(r.query, r.neighbour, r.score, r.place) for r in vectors.cosine_neighbours(asked, df, align=True, vocabulary=vocabulary, block_entries=entries).collect()}
        assert got == brute(base_terms=some)
        filled = vectors.cosine_neighbours(asked, df, fill=df.select("id").distinct(), asked=asked.select("id"), block_entries=entries).collect()
        assert Counter(r.query for r in filled) == {q: 5 for q in [*{i for i, _ in rows if i % 5 == 0}, 1000]}
        assert [(r.neighbour, r.score) for r in sorted(filled, key=lambda r: r.place) if r.query == 1000] == [(i, 0.0) for i in range(5)]
        k = vectors.similarity_moments(asked, df, block_entries=entries).first()
        assert k.k == sum(1 for q in {i for i, _ in rows if i % 5 == 0} for b in {i for i, _ in rows} if {t for i, t in rows if i == q} & {t for i, t in rows if i == b})
    none = df.where("false")
    assert vectors.cosine_neighbours(none, df).count() == 0 and vectors.cosine_neighbours(df, none).count() == 0
    assert vectors.similarity_moments(none, none).first().k == 0


def test_hot_keys_are_parted(spark):
    """A key with two thirds of the rows is spread; arrays, several keys, nulls and left joins keep their rows."""
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", i % 2) for i in range(3000)] + [(-1, None, 0), (-2, "absent", 1)], "id long, k string, side int")
    values = spark.createDataFrame([("hot", 0, 1000, 5), ("hot", 1, 1000, 6), *[(f"k{i}", i % 2, 1, i) for i in range(0, 3000, 3)]], "k string, side int, w long, v long")
    got = {r.id: r.v for r in skew.lookup_join(rows, values, ["k", "side"], "w", "left").collect()}
    assert got == {i: (5 + i % 2 if i % 3 else i) for i in range(3000)} | {-1: None, -2: None}
    assert skew.lookup_join(rows, values, ["k", "side"], "w").count() == 3000
    salts = {(r.k, r.side): r["__salts"] for r in skew.salts_of(values, ["k", "side"], "w").collect()}
    assert salts == {("hot", 0): 334, ("hot", 1): 334}
    arrays = skew.lookup_join(rows.select("id", F.array("k", F.lit("x")).alias("g")), spark.createDataFrame([(["hot", "x"], 9, 1)], "g array<string>, w long, v long"), "g", "w")
    assert arrays.count() == 2000


def test_stored_tables(spark, tmp_path):
    from lexispark import session

    kept = session.stored(spark.range(5))
    assert kept.count() == 5 and session.drop_stored(spark) >= 1 and session.drop_stored(spark) == 0

    class Elsewhere:
        """A session on a cluster that names no shared folder."""

        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere)


def test_core_operators_on_nothing(spark):
    """Empty tables, null arrays and extra columns with names used inside."""
    docs = spark.createDataFrame([], "id long, toks array<string>, gram int, n int, cnt int")
    counts = ngrams.ngram_counts(docs, "id", "toks", [1, 2, 3, 4], "corpus")
    assert ngrams.mle(counts).count() == 0 and smoothing.additive(counts).count() == 0
    model, unseen = smoothing.good_turing(counts)
    assert model.count() == 0 and unseen.count() == 0
    for made in (backoff.katz_model(counts), backoff.kn_model(counts)):
        assert made[0].count() == 0 and made[1].count() == 0
        asked = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "gram array<string>")
        rows = {tuple(r.gram or ()): r.p for r in backoff.backoff_score(asked, "gram", *made, 0, 2).collect()}
        assert rows[("a", "b")] == 1.0 and rows[()] is None
    words = subword.word_frequencies(spark.createDataFrame([], "text string, word int"), "text")
    assert subword.bpe_train(words, 5).count() == 0 and subword.wordpiece_vocab(words, 5).count() == 1
    tagged = spark.createDataFrame([], "id long, words array<string>, tags array<string>")
    assert tagging.hmm_transitions(tagged).count() == 0
    assert classify.split_by_ratio(spark.range(0).withColumnRenamed("id", "doc_id"), "doc_id").count() == 0
    assert morphology.best_split(morphology.word_counts(spark.createDataFrame([], "w string, cnt int"), "w")).count() == 0
    nulls = spark.createDataFrame([(1, None, 5), (2, ["a"], 6)], "id long, toks array<string>, len int")
    assert vectors.term_frequency(nulls, "id", "toks").count() == 1
    assert ngrams.ngram_counts(nulls, "id", "toks", [1, 2], "corpus").count() == 1


def test_bpe_to_the_end_against_full_scans():
    random.seed(5)
    freqs = {"".join(random.choice("abc") for _ in range(random.randint(1, 9))): random.randint(1, 4) for _ in range(120)}
    splits, want = {w: list(w) for w in freqs}, []
    while True:
        stats = Counter()
        for w, s in splits.items():
            for p in zip(s, s[1:]):
                stats[p] += freqs[w]
        if not stats:
            break
        best = min(stats, key=lambda p: (-stats[p], p))
        want.append((*best, stats[best]))
        splits = {w: regex_joined(s, best) for w, s in splits.items()}
    assert subword.learn_merges(freqs, 10**6) == want
    short = subword.learn_merges(freqs, 10**6, vocab_size=50)
    assert 3 + len({a + b for a, b, _ in short}) == 50 and short == want[: len(short)]


def test_bpe_queries_train_as_long_as_the_reference():
    from lexispark.plans import subwords

    assert (subwords.MERGES, subwords.VOCAB) == (32_000, 32_000)


def test_generation_queries_are_as_long_as_the_reference(spark, monkeypatch):
    from lexispark.plans import language_models

    text = lambda kind, max_n, max_length=15, **_: [kind] * max_length
    monkeypatch.setattr(language_models, "_model", lambda spark, d, kind: (kind,))
    monkeypatch.setattr(generate, "greedy", text)
    monkeypatch.setattr(generate, "beam", text)
    for f in (language_models.greedy_generate, language_models.beam_generate):
        assert Counter((r.model, r.word) for r in f(spark, "").collect()) == {("katz", "katz"): 15, ("kn", "kn"): 15}


def test_next_merges_are_those_of_one_at_a_time():
    sizes = []
    for seed in range(40):
        random.seed(seed)
        freqs = {"".join(random.choice("abcdefgh"[: 2 + seed % 7]) for _ in range(random.randint(1, 9))): random.choice([1, 1, 2, 3, 50]) for _ in range(60)} | {c * (seed % 13): 40 + seed for c in "ax"}
        splits, got, want = {w: list(w) for w in freqs}, [], subword.learn_merges(freqs, 10**6)
        while True:
            stats = Counter()
            for w, s in splits.items():
                for p in zip(s, s[1:]):
                    stats[p] += freqs[w]
            best = sorted(((*p, n) for p, n in stats.items()), key=lambda p: (-p[2], p[:2]))
            top = random.choice([1, 5, 1000])
            batch = subword._next_merges(best[:top], len(best) < top)
            if not batch:
                break
            sizes.append(len(batch))
            for left, right, n in batch:
                splits = {w: regex_joined(s, (left, right)) for w, s in splits.items()}
            got += batch
        assert got == want
    assert max(sizes) > 3


def test_bpe_counts_all_types_beyond_the_driver(spark):
    freqs = {"a" * 60: 9, "low": 5, "lower": 3, "newest": 3, "widest": 2, "q": 1, "xy" * 30: 2}
    words = spark.createDataFrame(list(freqs.items()), "word string, freq long")
    want = subword.learn_merges(freqs, 14)
    assert ("a", "a", 9 * 59) == want[0]
    for limits in ({}, {"max_types": 2}, {"max_types": 2, "top": 3, "fold": 5}):
        rows = subword.bpe_train(words, 14, **limits).orderBy("rank").collect()
        assert [(r.left, r.right, r.freq) for r in rows] == want
    rows = subword.bpe_train(words, 14, max_types=2, vocab_size=20).collect()
    assert len(rows) == len(subword.learn_merges(freqs, 14, vocab_size=20)) < 14


def test_alignment_uses_the_whole_query_side(spark):
    base = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0), (2, "x", 1.0), (2, "z", 2.0)], "id long, term string, value double")
    held = spark.createDataFrame([(50, "x", 1.0), (51, "y", 3.0)], "id long, term string, value double")
    got = vectors.cosine_neighbours(held.where("id % 50 = 0"), base, align=True, vocabulary=held.select("term")).orderBy("place").collect()
    assert [(r.query, r.neighbour, r.score) for r in got] == [(50, 2, 1.0), (50, 1, 0.707107)]


@pytest.mark.parametrize("top_words", [1, 1000])
@pytest.mark.parametrize("kind", ["katz", "kn"])
def test_generation_from_counts_gives_the_models_words(spark, docs, monkeypatch, kind, top_words):
    monkeypatch.setattr(continuations, "TOP_WORDS", top_words)
    docs = docs.unionByName(spark.createDataFrame([(None, ["c", "b"]), (None, ["c", "b", "c", "b", "a"])], docs.schema))
    table = continuations.continuation_table(docs, "id", "toks")
    words = continuations.word_table(table)
    counts = ngrams.ngram_counts(docs, "id", "toks", [1, 2, 3, 4], "corpus")
    listed = lambda df: sorted((r.n, tuple(r.gram), r.cnt) for r in df.collect())
    assert listed(continuations.ngram_table(table, words)) == listed(counts)
    made = (words.select("word"), *(backoff.katz_model(counts) if kind == "katz" else backoff.kn_model(counts)), words.count())
    asked = [(), ("a",), ("b", "a"), ("z", "a", "b"), ("z",)]
    source, undecided = continuations.Continuations(table, words, kind), []
    got = source.best(asked, 3, lambda cs: undecided.extend(cs) or generate._best(cs, 3, *made, 4))
    want = generate._best(asked, 3, *made, 4)
    assert bool(undecided) == (top_words == 1)
    for c in asked:
        positive = [(w, p) for w, p in want[c] if p > 0]
        assert [w for w, p in got[c] if p > 0] == [w for w, _ in positive]
        assert all(math.isclose(p, q, rel_tol=1e-9) for (_, p), (_, q) in zip(got[c], positive))


def test_generation_queries_make_no_model(spark, docs, monkeypatch):
    from lexispark.plans import language_models

    def refuse(*_, **__):
        raise AssertionError("a model of all n-grams was made")

    monkeypatch.setattr(backoff, "katz_model", refuse)
    monkeypatch.setattr(backoff, "kn_model", refuse)
    monkeypatch.setattr(language_models, "passages", lambda spark, d: docs.select(F.col("id").alias("sent_id"), F.lit("train").alias("split_name"), "toks"))
    monkeypatch.setattr(language_models, "table", lambda spark, d, name: docs.select(F.col("id").alias("sent_id")))
    assert {(r.model, r.method) for r in language_models.generated_copies(spark, "").collect()} == {(m, h) for m in ("katz", "kn") for h in ("greedy", "beam_search")}


def test_continuations_are_stored_in_small_pages(docs, monkeypatch):
    asked = {}
    monkeypatch.setattr(continuations, "stored", lambda df, **options: asked.update(options) or df)
    continuations.continuation_table(docs, "id", "toks")
    assert asked == {"parquet.page.row.count.limit": "1000"}
