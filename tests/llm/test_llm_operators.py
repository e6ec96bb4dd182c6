"""Each operator against brute force and on edge cases: nulls, empty and long texts, ties, copies, empty tables, extra columns."""

import math
import random
import unicodedata
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from lexispark.llm import cooccur, distinctive, leakage, lookalike, neighbours, overlap, packing, repetition, sentences, topn, vectors, wordkernel
from lexispark.llm.queries import QUERIES

NOW = datetime(2024, 1, 1)


def plain_words(text):
    """The words of a text the slow way."""
    table = wordkernel.char_table()
    text = "".join(c for c in text or "" if table[ord(c)] != 1)
    text = unicodedata.normalize("NFC", text)
    for a, b in lookalike.alike_sequences():
        if a.isalpha() or len(a) == 2:
            text = text.replace(a, b)
    return "".join(chr(table[ord(c)]) if table[ord(c)] > 1 else " " for c in text).split()


# -- 1 ---------------------------------------------------------------------------------------------
def cut(text):
    s = sentences.sentence_spans(text)
    return [text[a:b] for a, b in zip(s[::2], s[1::2])]


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []), ("", []), (" \n\t ", []),
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("Dr. Rao paid Rs. 5.50 at 9 a.m. near St. Anne. He left at 9 a.m. The end", ["Dr. Rao paid Rs. 5.50 at 9 a.m. near St. Anne.", "He left at 9 a.m.", "The end"]),
        ("See www.a.example or v2.3.4 No. 5. No. Never", ["See www.a.example or v2.3.4 No. 5.", "No.", "Never"]),
        ("K. B. Rao (p. 28) came... and went... Then slept?!", ["K. B. Rao (p. 28) came... and went...", "Then slept?!"]),
        ("“Go. Now!” shouted Ann. “Stay.” He stayed.", ["“Go. Now!” shouted Ann.", "“Stay.”", "He stayed."]),
        ('He said, "Come in." She did.', ['He said, "Come in."', "She did."]),
        ("वह आया।वह गया॥ क्या?", ["वह आया।", "वह गया॥", "क्या?"]),
        ("डॉ. राव क्र. 5 पर 3.5 कि.मी. चले| फिर रुके।", ["डॉ. राव क्र. 5 पर 3.5 कि.मी. चले|", "फिर रुके।"]),
        ("उस ने “आओ। बैठो।” कहकर बुलाया। वह आया।", ["उस ने “आओ। बैठो।” कहकर बुलाया।", "वह आया।"]),
        ("राम ने कहा, “आओ। बैठो।” वह आया।", ["राम ने कहा, “आओ। बैठो।”", "वह आया।"]),
        ("今日は「良い。」と言った。はい！", ["今日は「良い。」と言った。", "はい！"]),
        ("ฝนตก 5 วัน แล้วหยุด", ["ฝนตก 5 วัน", "แล้วหยุด"]),
        ("کیا؟ ہاں۔", ["کیا؟", "ہاں۔"]),
        ("no end\nnext line\r\n last ", ["no end", "next line", "last"]),
        ("an “open quote. Next one.", ["an “open quote.", "Next one."]),
        ("1. First item. Second", ["1. First item.", "Second"]),
    ],
)
def test_sentences(text, want):
    assert cut(text) == want


def test_sentences_within_a_run_without_blanks():
    texts = ["गेली.गेलेत.मग", "私" * 80 + ".次", "गेली." * 3 + "मग"]
    assert [len(sentences.sentence_spans(t)) // 2 for t in texts] == [3, 2, 4]
    for plain in ("www." + "a" * 80 + ".com", "a" * 80 + ".b" * 50, "3.14.15"):
        assert len(sentences.sentence_spans(plain)) // 2 == 1


def test_sentences_long_and_table(spark):
    long = "ab. " * 200_000
    assert len(sentences.sentence_spans(long)) // 2 in (1, 200_000)
    rows = [(1, "A b. C d.", NOW, 7), (1, "A b. C d.", datetime(2024, 1, 2), 8), (2, None, NOW, 1), (3, "", NOW, 1)]
    df = spark.createDataFrame(rows, "sent_id long, sentence string, ingested_at timestamp, __key int")
    got = sorted(map(tuple, sentences.sentences(df, "sent_id", "sentence", "ingested_at").collect()))
    assert got == [(1, 0, 4), (1, 5, 9)]
    assert sentences.sentences(df.where("false"), "sent_id", "sentence", "ingested_at").count() == 0


def test_nested_list_levels(spark):
    assert cut("1. a) One two. Three.") == ["1. a) One two.", "Three."]
    assert cut("2. b. Lower marker. Next.") == ["2. b. Lower marker.", "Next."]
    assert cut("- 1. (i) Deep. Out.") == ["- 1. (i) Deep.", "Out."]
    text = "1. One\n  a) in\n  b) in\n    - deep\n  c) in\n2. Two\nplain\n  a) again"
    levels, seen = sentences._ListLevels(), []
    for line in text.split("\n"):
        sentences._line_spans(line, 0, len(line), [], levels)
        seen.append([style for _, style in levels.stack])
    one, letter, dash = "number.", "letter)", "bullet-"
    assert seen == [[one], [one, letter], [one, letter], [one, letter, dash], [one, letter], [one], [], [letter]] and levels.depth == 3
    unkeyed = spark.createDataFrame([(None, "A. b", NOW), (None, "C d. E f.", NOW), (None, "C d. E f.", NOW), (1, "X y.", NOW)], "sent_id long, sentence string, ingested_at timestamp")
    got = sentences.sentences(unkeyed, "sent_id", "sentence", "ingested_at").collect()
    assert Counter(r.sent_id for r in got) == {None: 3, 1: 1}


# -- 2 ---------------------------------------------------------------------------------------------
def test_many_giant_baskets(spark):
    """Equal giant baskets collapse; as many as make a pair count are enumerated like all others."""
    big = [f"g{i}" for i in range(600)]
    rows = [(r, w) for r in range(9) for w in big] + [(100 + r, w) for r in range(4000) for w in (f"o{r % 50}", f"o{(r + 1) % 50}")]
    df = spark.createDataFrame(rows, "rec long, w string")
    members = cooccur.baskets(df, "rec", ["w"])
    kinds = cooccur.collapsed(members).collect()
    assert [(r.n, r.weight) for r in kinds if r.n > 2] == [(600, 9)] and sum(r.weight for r in kinds) == 4009
    got = cooccur.pair_scores(df, "rec", ["w"], 9, 2.0)
    pairs = {(r.word_lo, r.word_hi): r.n_both for r in got.collect()}
    assert {p for p in pairs if p[0][0] == "g"} == {(a, b) for a in big for b in big if a < b} and set(pairs.values()) == {9, 80}


@pytest.mark.parametrize("giant", [512, 100, 4])
def test_pairs_against_brute_force(spark, monkeypatch, giant):
    monkeypatch.setattr(cooccur, "GIANT", giant)
    random.seed(1)
    words = [f"w{i}" for i in range(60)]
    rows, sets = [], {}
    for r in range(300):
        base = random.sample(words, 4) + (["x", "y"] if r % 15 == 0 else []) + ["stop"]
        if r % 50 == 0:
            base += [f"big{i}" for i in range(150)]
        sets[r] = set(base)
        rows += [(r, a, b, 1) for a, b in zip(base, [*base[1:], None])]
    rows += rows[:20] + [(None, "x", "y", 1), (999, None, None, 1)]
    sets[999] = set()
    df = spark.createDataFrame(rows, "rec_id long, word1 string, word2 string, item int")
    n = len(sets)
    c = Counter(w for s in sets.values() for w in s)
    p = Counter((a, b) for s in sets.values() for a in s for b in s if a < b)
    for least, pmi in ((8, 2.0), (2, 0.5)):
        want = {k for k, v in p.items() if v >= least and math.log(v * n / (c[k[0]] * c[k[1]])) >= pmi}
        got = cooccur.pair_scores(df, "rec_id", ["word1", "word2"], least, pmi)
        assert {(r.word_lo, r.word_hi) for r in got.collect()} == want
    assert cooccur.pair_scores(df.where("false"), "rec_id", ["word1", "word2"]).count() == 0


# -- 3 ---------------------------------------------------------------------------------------------
def test_top_n_against_brute_force(spark):
    random.seed(2)
    rows = [(random.choice(["a", "b", None, "hot", "hot", "hot"]), random.choice(["c", "d"]), f"i{random.randrange(40)}", random.choice([0.1, 0.2, 0.5, None, float("nan")]), 1) for _ in range(3000)]
    rows.append(("a", "c", None, 0.9, 1))
    df = spark.createDataFrame(rows, "w1 string, w2 string, w3 string, p double, n int").repartition(6)
    best = {}
    for a, b, c, p, _ in rows:
        if c is not None and p is not None and not math.isnan(p):
            best[a, b, c] = max(p, best.get((a, b, c), -1))
    groups = {}
    for (a, b, c), p in best.items():
        groups.setdefault((a, b), []).append((-p, c))
    want = sorted((str(a), b, c, -p) for (a, b), g in groups.items() for p, c in sorted(g)[:3])
    got = topn.top_n_per_group(df, ["w1", "w2"], "w3", "p", 3)
    assert sorted((str(r.w1), r.w2, r.w3, r.p) for r in got.collect()) == want
    assert topn.top_n_per_group(df, ["w1", "w2"], "w3", "p", 0).count() == 0
    assert topn.top_n_per_group(df.where("false"), ["w1"], "w3", "p", 3).count() == 0


# -- 4, and reading blocks -------------------------------------------------------------------------
BLOCK = "block_id long, split_name string, source string, first_vec long, n_rows int, data array<float>, indices array<int>, indptr array<int>, loaded_at timestamp, vec int"


def random_blocks(seed=3, blocks=30):
    rng = np.random.default_rng(seed)
    rows, made = [], []
    for b in range(blocks):
        data, indices, ptr = [], [], [5]
        for i in range(5):
            if made and rng.random() < 0.4:
                v = dict(made[rng.integers(len(made))])
                if rng.random() < 0.6:
                    v[int(rng.integers(400))] = float(np.float32(rng.random()))
            else:
                v = {int(c): float(np.float32(rng.random() + 0.1)) for c in rng.choice(400, size=int(rng.integers(0, 9)), replace=False)}
            made.append(v)
            for c, x in v.items():
                data.append(x)
                indices.append(c)
            data += [float("nan"), 0.0]
            indices += [7, 8]
            ptr.append(5 + len(data))
        rows.append((b, ["train", "val", "test"][b % 3], f"s{b % 2}", b * 5, 5, data, indices, ptr, NOW, 1))
    return rows, made


def brute_neighbours(made, k=5, least=0.6):
    out = set()
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in made]
    for a, v in enumerate(made):
        near = []
        for b, w in enumerate(made):
            if a != b and norm[a] and norm[b]:
                s = round(sum(x * w.get(c, 0.0) for c, x in v.items()) / norm[a] / norm[b], 6)
                if s >= least:
                    near.append((-s, b))
        out |= {(a, b) for _, b in sorted(near)[:k]}
    return out


def test_neighbours_against_brute_force(spark):
    rows, made = random_blocks()
    rows.append(rows[0])
    rows.append((None, "train", "s", None, 3, None, None, None, NOW, 1))
    got = neighbours.nearest_vectors(vectors.vectors(spark.createDataFrame(rows, BLOCK)))
    assert {(r.vec, r.near) for r in got.collect()} == brute_neighbours(made)


def test_neighbours_of_copies_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 8)
    rows, made = random_blocks(seed=4, blocks=20)
    copies = [(100 + i, "train", "s", 1000 + i, 1, [2.0, 1.0], [1, 2], [0, 2], NOW, 1) for i in range(40)]
    got = neighbours.nearest_vectors(vectors.vectors(spark.createDataFrame(rows + copies, BLOCK)))
    pairs = {(r.vec, r.near) for r in got.collect()}
    assert {p for p in pairs if p[0] >= 1000} == {(1000 + i, j) for i in range(40) for j in [x for x in range(1000, 1006) if x != 1000 + i][:5]}
    assert {p for p in pairs if p[0] < 1000 and p[1] < 1000} <= brute_neighbours(made)
    empty = spark.createDataFrame([], BLOCK)
    assert neighbours.nearest_vectors(vectors.vectors(empty)).count() == 0


def test_neighbours_of_vectors_sent_again_otherwise(spark, tmp_path):
    """Of several deliveries the last counts, also where it is another vector, empty, or a block of fewer rows."""
    rows, made = random_blocks(seed=6, blocks=16)
    later = NOW + timedelta(days=1)
    again = [rows[b] for b in (1, 4, 9, 12)]
    others = [rows[b] for b in (2, 7, 0, 3)]
    changed = [(a[0], a[1], a[2], a[3], 5, o[5], o[6], o[7], later, 1) for a, o in zip(again, others)]
    for a, o in zip(again, others):
        for i in range(5):
            made[a[3] + i] = made[o[3] + i]
    changed.append((6, "train", "s0", 30, 5, [], [], [0] * 6, later, 1))
    made[30:35] = [{}] * 5
    got = neighbours.nearest_vectors(vectors.vectors(spark.createDataFrame(changed + rows, BLOCK)))
    want = brute_neighbours(made)
    assert {(r.vec, r.near) for r in got.collect()} == want
    shorter = (*rows[10][:4], 2, *rows[10][5:8], later, 1)
    made[52:55] = [{}] * 3
    spark.createDataFrame([*changed, shorter, *rows], BLOCK).write.parquet(str(tmp_path / "bonus.parquet"))
    found = {(r.vec_lo, r.vec_hi) for r in QUERIES["p4_found"](spark, str(tmp_path)).collect()}
    left = brute_neighbours(made)
    assert left != want and found == {(min(p), max(p)) for p in left}


# -- 5 ---------------------------------------------------------------------------------------------
def test_distinctive_terms(spark):
    rows = [(1, "a b\u00a0a\u3000c"), (2, "a"), (3, None), (4, "  "), (5, "b\u200bb d d"), (6, "a d")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "id long, t string, df int").withColumn("w", distinctive.white_space_words("t"))
    texts = {i: [w for w in (t or "").replace("\u00a0", " ").replace("\u3000", " ").split(" ") if w] for i, t in rows}
    n = sum(1 for w in texts.values() if w)
    dfs = Counter(t for w in texts.values() for t in set(w))
    corpus = distinctive.word_corpus(df, "w")
    assert {r.term: r.df for r in corpus.collect()} == dict(dfs)
    size = distinctive.collection_size(df.select(distinctive.F.size(distinctive.white_space_words("t")).alias("size")))
    got = distinctive.distinctive_terms(distinctive.word_entries(df, "id", "w"), corpus, size, 2, scoring="idf").collect()
    want = set()
    for i, w in texts.items():
        s = sorted((-(k / len(w)) * (math.log((n + 1) / (dfs[t] + 1)) + 1), t) for t, k in Counter(w).items())
        want |= {(i, t) for _, t in s[:2]}
    assert {(r.rec_id, r.term) for r in got} == want
    kl = distinctive.distinctive_terms(distinctive.word_entries(df, "id", "w"), corpus, size, 1, mu=2.0, min_df=2).collect()
    cf = Counter(t for w in texts.values() for t in w)
    mass = sum(cf.values())
    for r in kl:
        w = texts[r.rec_id]
        score = {}
        for t, k in Counter(w).items():
            if dfs[t] >= 2:
                q = cf[t] / mass
                p = (k + 2.0 * q) / (len(w) + 2.0)
                score[t] = p * math.log(p / q)
        assert math.isclose(r.score, max(score.values())) and math.isclose(score[r.term], r.score)
    with pytest.raises(ValueError):
        distinctive.distinctive_terms(distinctive.word_entries(df, "id", "w"), corpus, size, 1, scoring="x")


# -- 6 ---------------------------------------------------------------------------------------------
APP = "sent_id long, sentence string, split_name string, source string, ingested_at timestamp, cid int"


def test_overlaps_against_brute_force(spark):
    random.seed(5)
    vocab = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(400):
        if texts and random.random() < 0.4:
            w = list(random.choice(texts))
            if random.random() < 0.7 and w:
                w[random.randrange(len(w))] = random.choice(vocab)
        else:
            w = random.choices(vocab, k=random.randrange(0, 12))
        texts.append(w)
    split = lambda i: ["train", "train", "val", "test"][i % 4]
    rows = [(i, "  ".join(w).upper() if i % 5 == 0 else "\u200b, ".join(w), split(i), "s", NOW, 1) for i, w in enumerate(texts)]
    rows += rows[:10] + [(900, None, "train", "s", NOW, 1), (901, "w1 w2", None, "s", NOW, 1)]
    app = spark.createDataFrame(rows, APP)
    pairs, members = overlap.split_overlaps(overlap.sentence_terms(app))
    got = {(r.id_lo, r.id_hi) for r in overlap.record_pairs(pairs, members).collect()}
    sets = [frozenset(w) for w in texts]
    want = {
        (min(i, j), max(i, j)) for i in range(400) for j in range(400)
        if split(i) == "train" and split(j) != "train" and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7
    }
    assert got == want
    report = overlap.overlap_report(pairs, members).collect()
    assert sum(r.links for r in report) == len(want)
    empty = overlap.split_overlaps(overlap.sentence_terms(app.where("false")))
    assert overlap.record_pairs(*empty).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------
SAME = [
    ("क़लम", "क़लम"), ("Ｔｅｓｔ", "Test"), ("café", "café"), ("Тeѕt", "Test"), ("a\u200bb", "ab"),
    ("a\u00a0b", "a\u3000b"), ("a\u2009b", "a b"), ("\u202fab ", "ab"), ("आम", "अाम"), ("दुःख", "दु:ख"),
    ("राम।", "राम|"), ("पा\u200dनी", "पानी"), ("a\ufe0eb", "ab"), ("और", "अौर"),
]
DIFFERENT = [("A", "a"), ("१२", "12"), ("m²", "m2"), ("resume", "résumé"), ("र्\u200dया", "र्या"), ("ab", "a b"), ("l", "1")]


def test_weighted_overlaps_against_brute_force(spark):
    rng = random.Random(6)
    made = []
    for i in range(120):
        v = {rng.randrange(300): rng.choice([0.25, 0.5, 1.0, 3.0]) for _ in range(rng.randrange(1, 12))}
        made.append(v)
        if i % 3 == 0:  # a near copy: other weights, one entry more
            made.append({**{c: w * rng.choice([1.0, 1.1]) for c, w in v.items()}, rng.randrange(300): 0.25})
        if i % 10 == 0:
            made.append(dict(v))
    rows = [(i, rng.choice(["train", "train", "val", "test", None]), "s", NOW, [int(c) for c in sorted(v)], [v[c] for c in sorted(v)]) for i, v in enumerate(made)] + [(900, "val", None, NOW, [], [])]
    df = spark.createDataFrame(rows, "vec long, split_name string, source string, loaded_at timestamp, cols array<int>, vals array<double>")
    pairs, members = overlap.weighted_overlaps(df, 0.9)
    got = {r.id: r.links for r in overlap.linked_records(pairs, members).collect()}

    def cosine(a, b):
        return sum(w * b.get(c, 0) for c, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))

    train = [v for v, r in zip(made, rows) if r[1] == "train"]
    want = {r[0]: sum(cosine(v, t) >= 0.9 - 1e-9 for t in train) for v, r in zip(made, rows) if r[1] in ("val", "test")}
    assert got == want and sum(want.values()) > 10
    assert overlap.linked_records(*overlap.weighted_overlaps(df.where("false"))).count() == 0


@pytest.mark.parametrize(
    "a, b", [("ﬁne", "fine"), ("ﺍﺏ", "اب"), ("𝐀b", "Ab"), ("ｶﾞ", "ガ"), ("Ⅷ", "VIII"), ("օ", "o"), ("ɑ", "a"), ("ᴏ", "o"), ("ꓮ", "A"), ("Ꭺ", "A"), ("⼀", "一"), ("x\u00a0y", "x y")]
)
def test_compatibility_forms_print_alike(a, b):
    assert lookalike.skeleton(a) == lookalike.skeleton(b)


@pytest.mark.parametrize("a, b", [("x²", "x2"), ("①", "1"), ("½", "1/2"), ("ſ", "s"), ("ϑ", "θ"), ("१", "1"), ("A", "a"), ("é", "e"), ("ı", "i"), ("№", "No"), ("ㄱㅏ", "가"), ("㎞", "km")])
def test_forms_that_stay_apart(a, b):
    assert lookalike.skeleton(a) != lookalike.skeleton(b)


def test_same_print():
    for a, b in SAME:
        assert a != b
        assert lookalike.skeleton(a) == lookalike.skeleton(b), (a, b)
    for a, b in DIFFERENT:
        assert lookalike.skeleton(a) != lookalike.skeleton(b), (a, b)


def test_canonical_forms_and_pairs(spark):
    rows = [(x, 1) for pair in SAME + DIFFERENT for x in pair] + [(None, 1), ("", 1), ("  ", 1), ("Test", 2)]
    df = spark.createDataFrame(rows, "token string, canonical2 int")
    forms = lookalike.canonical_forms(df, "token")
    got = {r.token: r.canonical for r in forms.collect()}
    for a, b in SAME:
        assert got[a] == got[b]
    for a, b in DIFFERENT:
        assert got[a] != got[b]
    pairs = {(r.form_lo, r.form_hi) for r in lookalike.same_print_pairs(forms, "token").collect()}
    assert all((min(a, b), max(a, b)) in pairs for a, b in SAME)
    assert lookalike.canonical_forms(df.where("false"), "token").count() == 0


def test_viterbi_prefers_one_script():
    model = lookalike.ScriptModel(dict(Counter(p for w in ("test", "toast", "тест", "рост") for p in lookalike.bigram_symbols(w))))
    assert lookalike.canonical("tоаѕt", model) == "toast"


# -- 8 ---------------------------------------------------------------------------------------------
def test_levels_against_definition():
    random.seed(6)
    levels, boxes = packing.Levels(20), {}
    for _ in range(300):
        size = random.randrange(1, 21)
        count = Counter(v for v in boxes.values() if v < 20)
        best = None
        for h in [0, *count]:
            if h + size <= 20:
                new = count.copy()
                if h:
                    new[h] -= 1
                if h + size < 20:
                    new[h + size] += 1
                cost = sum(v * v for v in new.values())
                if best is None or (cost, -h) < best:
                    best = (cost, -h)
        box, level = levels.place(size)
        assert level == -best[1]
        assert boxes.get(box, 0) == level
        boxes[box] = level + size
    assert max(boxes.values()) <= 20


def test_packing_keeps_every_token(spark):
    rows = [(i, "word " * (i * 7 % 900), 1) for i in range(60)] + [(100, None, 1), (101, "", 1), (102, "long text " * 3000, 1), (5, "same key", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    placed = packing.pack_texts(df, "doc_id", "text", per_task=20).collect()
    counts = {r.doc_id: r.n for r in packing.token_counts(df, "doc_id", "text").groupBy("doc_id").agg(packing.F.sum("n_tokens").alias("n")).collect()}
    got = Counter()
    fill = Counter()
    for r in placed:
        got[r.doc_id] += r.n_tokens
        if r.container_id is not None:
            fill[r.container_id] += r.n_tokens
        assert r.n_tokens <= 2048 and (r.n_tokens > 0) == (r.container_id is not None)
    assert {k: got[k] for k in counts} == counts
    assert max(fill.values()) <= 2048
    whole = {r.doc_id for r in placed if r.piece > 0}
    assert whole == {102}
    assert packing.pack_texts(df.where("false"), "doc_id", "text").count() == 0


# -- 9 ---------------------------------------------------------------------------------------------
def test_contained_items_against_brute_force(spark):
    random.seed(7)
    word = lambda: f"t{random.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(random.randrange(8, 40))), "x") for i in range(30)]
    docs = []
    for d in range(120):
        w = [word() for _ in range(random.randrange(0, 200))]
        if d % 3 == 0:
            src = random.choice(items)[1].split()
            a = random.randrange(len(src))
            w[len(w) // 2 : len(w) // 2] = src[a : a + random.randrange(5, 30)]
        docs.append((d, ("\u200b. ".join(w)).upper(), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (0, docs[0][1], "x")]
    grams = {}
    for i, t, _ in items:
        w = plain_words(t)
        for j in range(len(w) - 11):
            grams.setdefault(tuple(w[j : j + 12]), set()).add(i)
    want = set()
    for d, t, _ in docs:
        w = plain_words(t)
        for j in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[j : j + 12]), ())}
    dd = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    ii = spark.createDataFrame([*items, (99, None, "x")], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in leakage.contained_items(dd, "doc_id", "text", ii, "item_id", "text").collect()} == want
    assert leakage.contained_items(dd, "doc_id", "text", ii.where("false"), "item_id", "text").count() == 0
    assert leakage.contained_items(dd.where("false"), "doc_id", "text", ii, "item_id", "text").count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_contained_items_beyond_the_table(spark, monkeypatch, bits):
    """A table of bits far too small for the windows sends more on, and finds the same; boilerplate of many items and texts is a hot window."""
    monkeypatch.setattr(leakage, "MOST_BITS", bits)
    common = " ".join(f"c{j}" for j in range(12))
    items = [(i, " ".join(f"a{i}x{j}" for j in range(14)) + (" " + common if i % 3 == 0 else "")) for i in range(30)]
    ii = spark.createDataFrame(items, "id long, text string")
    got = {(r.id, r.item_id): (r.windows_found, r.item_windows) for r in leakage.contained_items(ii, "id", "text", ii, "id", "text").collect()}
    plain = {(i, i): (3, 3) for i in range(30) if i % 3}
    assert got == plain | {(i, k): (15, 15) if i == k else (1, 15) for i in range(0, 30, 3) for k in range(0, 30, 3)}
    docs = spark.createDataFrame([(i, f"z{i} {common} y") for i in range(2000)], "id long, text string")
    assert leakage.contained_items(docs, "id", "text", ii, "id", "text").count() == 2000 * 10


def test_short_items(spark):
    """Items of 5 to 11 words are size classes of their own, found only whole."""
    items = spark.createDataFrame([(n, " ".join(f"s{n}w{j}" for j in range(n))) for n in (3, 5, 8, 11, 12)], "item long, text string")
    docs = spark.createDataFrame([(n, "x " + " ".join(f"s{n}w{j}" for j in range(k)) + " y") for n, k in ((3, 3), (5, 5), (8, 7), (11, 11), (12, 12))], "doc long, text string")
    assert {(r.doc, r.item) for r in leakage.contained_items(docs, "doc", "text", items, "item", "text", short=True).collect()} == {(5, 5), (11, 11), (12, 12)}
    assert {(r.doc, r.item) for r in leakage.contained_items(docs, "doc", "text", items, "item", "text").collect()} == {(12, 12)}


# -- 10 --------------------------------------------------------------------------------------------
def brute_share(text, run=8):
    w, seen = plain_words(text), {}
    mark = [False] * len(w)
    for j in range(len(w) - run + 1):
        k = tuple(w[j : j + run])
        if k in seen:
            mark[j : j + run] = [True] * run
        seen.setdefault(k, j)
    return sum(mark), len(w)


def test_repetition_against_brute_force(spark):
    random.seed(8)
    texts = [" ".join(random.choices(["a", "b", "c", "dd", "e"], k=random.randrange(0, 60))) for _ in range(150)]
    texts += ["spam eggs " * 50, "one two three four five six seven eight " * 2, "", None, "x " * 100_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, votes int")
    got = {r.doc_id: r for r in repetition.repetition(df, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        rep, n = brute_share(t)
        assert (got[i].repeated_words, got[i].n_words) == (rep, n), t
        assert math.isclose(got[i].repeated_share, rep / n if n else 0.0)
        assert 0 <= got[i].posterior <= 1
    assert got[150].posterior > 0.9
    assert repetition.repetition(df.where("false"), "doc_id", "text").count() == 0


def test_votes_learn_accuracies():
    random.seed(9)
    counts = Counter()
    for _ in range(5000):
        bad = random.random() < 0.2
        digits = [0 if random.random() < 0.2 else (2 if bad == (random.random() < 0.9) else 1) for _ in repetition.RULES]
        counts[sum(d * 3 ** (4 - j) for j, d in enumerate(digits))] += 1
    fitted = repetition.fit_votes(counts)
    all_bad, all_clean = sum(2 * 3**j for j in range(5)), sum(3**j for j in range(5))
    assert fitted[all_bad] > 0.99 and fitted[all_clean] < 0.01
    assert 0.1 < fitted[0] < 0.3
    assert set(repetition.fit_votes({})) == set(range(243))


def test_posteriors_against_brute_force(spark):
    """The same model fitted document by document, from the figures, without vote patterns."""
    rng = random.Random(8)
    docs = []
    for d in range(160):
        w = [f"v{rng.randrange(60)}" for _ in range(rng.randrange(5, 80))]
        if d % 4 == 0:
            w = (w[:12] or ["a"]) * rng.randrange(2, 6)
        docs.append((d, "\n".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6))))
    docs += [(900, None), (901, "")]
    got = {r.id: r for r in repetition.repetition(spark.createDataFrame(docs, "id long, text string"), "id", "text").collect()}
    votes = {}
    for i, r in got.items():
        figures = [r.repeated_share, r.triple_share, r.top_word_share, r.line_share, r.poor_vocabulary]
        votes[i] = [0 if r.n_words < repetition.LEAST_WORDS else 1 if x >= bad else -1 if x <= clean else 0 for x, (clean, bad) in zip(figures, repetition.RULES.values())]
    prior, good, evil = 0.2, [0.8] * 5, [0.8] * 5

    def belief(v):
        bad, clean = prior, 1 - prior
        for j, x in enumerate(v):
            if x:
                bad *= evil[j] if x > 0 else 1 - evil[j]
                clean *= good[j] if x < 0 else 1 - good[j]
        return bad / (bad + clean)

    for _ in range(50):
        q = {i: belief(v) for i, v in votes.items()}
        prior = min(0.5, max(1e-4, sum(q.values()) / len(q)))
        told = lambda j, right: min(0.999, max(0.5, right))
        evil = [told(j, (0.8 + sum(q[i] for i in votes if votes[i][j] > 0)) / (1 + sum(q[i] for i in votes if votes[i][j]))) for j in range(5)]
        good = [told(j, (0.8 + sum(1 - q[i] for i in votes if votes[i][j] < 0)) / (1 + sum(1 - q[i] for i in votes if votes[i][j]))) for j in range(5)]
    for i, r in got.items():
        assert math.isclose(r.posterior, belief(votes[i]), rel_tol=1e-9, abs_tol=1e-12)
    assert got[900].n_words == 0 and math.isclose(got[900].posterior, prior)
    exact = {r.id: (r.n_words, r.repeated_words) for r in repetition.repeated_shares(spark.createDataFrame(docs, "id long, text string"), "id", "text").collect()}
    assert exact == {i: (r.n_words, r.repeated_words) for i, r in got.items()}


def test_word_kernel():
    w = wordkernel.words(["Ａb, AB!", "", "café café", "दु:ख a\u200bb"])
    assert list(w.doc) == [0, 0, 2, 2, 3, 3, 3]
    assert w.hash[0] == w.hash[1] == w.hash[6] and w.hash[2] == w.hash[3]
    assert w.text(0, 2) == "ab ab"


def test_words_of_compatibility_forms():
    a, b = wordkernel.words(["ﬁne ｶﾞ ﺍﺏ 𝐀x Ⅷ ｆｕｌｌ １２"]), wordkernel.words(["fine ガ اب ax viii full 12"])
    assert list(a.hash) == list(b.hash) and len(a.hash) == 7
    assert list(wordkernel.words(["x² y"]).hash) != list(wordkernel.words(["x2 y"]).hash)


def test_quotations_of_uncased_scripts():
    assert cut("‘तो आला? मग?’ असा सवाल केला. दुसरे.") == ["‘तो आला? मग?’ असा सवाल केला.", "दुसरे."]
    assert cut("ते म्हणाले, “आला. गेला.” या गावात.") == ["ते म्हणाले, “आला. गेला.”", "या गावात."]
    assert cut("8 कि.\u200bमी. चाल. मग.") == ["8 कि.\u200bमी. चाल.", "मग."]
    assert cut("他说：「好。」她走了。") == ["他说：「好。」", "她走了。"]


def test_very_long_texts(spark):
    words = [f"t{i}" for i in range(60_000)]
    long = " ".join(words)
    docs = spark.createDataFrame([(1, long), (2, "short one"), (3, None)], "id long, text string")
    items = spark.createDataFrame([(9, " ".join(words[30_000:30_020]))], "item long, text string")
    assert [(r.id, r.item) for r in leakage.contained_items(docs, "id", "text", items, "item", "text").collect()] == [(1, 9)]
    size = distinctive.collection_size(docs.select(distinctive.F.size(distinctive.white_space_words("text")).alias("size")))
    words_of = docs.withColumn("w", distinctive.white_space_words("text"))
    best = distinctive.distinctive_terms(distinctive.word_entries(words_of, "id", "w"), distinctive.word_corpus(words_of, "w"), size, 1, scoring="idf").collect()
    assert {(r.rec_id, r.term) for r in best} == {(1, "t0"), (2, "one")}
    rows = [(1, long, "train", "s", NOW, 0), (2, long + " more", "val", None, NOW, 0), (3, "x", "val", "s", None, 0)]
    pairs, members = overlap.split_overlaps(overlap.sentence_terms(spark.createDataFrame(rows, APP)))
    assert [(r.id_lo, r.id_hi, r.source) for r in overlap.record_pairs(pairs, members).collect()] == [(1, 2, None)]
    token = "क" * 50_000
    forms = lookalike.canonical_forms(spark.createDataFrame([(token,), (token + "\u200b",)], "t string"), "t")
    assert lookalike.same_print_pairs(forms, "t").count() == 1
    placed = packing.pack_texts(docs, "id", "text").where("id = 1").agg(packing.F.sum("n_tokens").alias("n"), packing.F.count("piece").alias("k")).first()
    assert placed.k == -(-placed.n // 2048)


def test_hot_groups_hold_together(spark):
    """A third of the rows in one record, group or class of copies."""
    rows = [(0, f"w{i % 50}", f"w{(i + 1) % 50}") for i in range(3000)] + [(1 + i // 3, f"w{i % 50}", None) for i in range(6000)]
    df = spark.createDataFrame(rows, "rec long, a string, b string")
    assert cooccur.pair_scores(df, "rec", ["a", "b"], 1, -50.0).count() > 0
    app = [(i, "same text here", "train" if i % 2 else "test", "s", NOW, 0) for i in range(400)] + [(1000 + i, f"other {i}", "train", "s", NOW, 0) for i in range(800)]
    pairs, members = overlap.split_overlaps(overlap.sentence_terms(spark.createDataFrame(app, APP)))
    assert pairs.count() == 1 and overlap.record_pairs(pairs, members).count() == 200 * 200
    report = overlap.overlap_report(pairs, members).first()
    assert (report.records, report.overlapping, report.exact, report.links) == (200, 200, 200, 40_000)
