"""Every core query without SQL against a plain Python version on the whole smallest tables."""

import functools
import math
import random
from collections import Counter

import regex
from conftest import data, duck

from lexispark.functions import text as T
from lexispark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
# The word tokeniser's alternatives in Python's notation.
WORDS = regex.compile(
    r"https?://\S+|www\.\S+|\S+@\S+\.\S+|\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b|\b\d+(?:\.\d+)?\b|[\u0900-\u097F]+|[\u0A80-\u0AFF]+|[\u0980-\u09FF]+|[\u0B80-\u0BFF]+"
    r"|[\u0C00-\u0C7F]+|[\u0C80-\u0CFF]+|[\u0D00-\u0D7F]+|[\u0A00-\u0A7F]+|[\u0B00-\u0B7F]+|[\u0600-\u06FF]+|[a-zA-Z]+|[।॥!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
)
SUBWORDS = regex.compile(r"[\u0900-\u097F]+|[a-zA-Z]+|\p{Nd}+|[^\p{L}\p{N}_\s\p{Z}]")


def rows(spark, name):
    return QUERIES[name](spark, data()).collect()


@functools.cache
def documents():
    return duck(data()).execute("SELECT doc_id, text FROM documents").fetchall()


@functools.cache
def sentences():
    return [(d, [s for s in (x.strip(T.EDGE_BLANKS) for x in regex.split(r"[.!?।॥][ \t\n\x0b\f\r]*", (t or "").strip(T.EDGE_BLANKS))) if s]) for d, t in documents()]


@functools.cache
def passages():
    """sent_id -> (split, tokens) of the passages as delivered last."""
    kept = {}
    for i, s, split, at in duck(data()).execute("SELECT sent_id, sentence, split_name, ingested_at FROM application").fetchall():
        if i not in kept or kept[i][2] < at:
            kept[i] = (split, [x for x in regex.split(r"[ \t\n\x0b\f\r]+", s or "") if x], at)
    return dict(sorted(kept.items()))


def test_all_queries_without_sql_are_listed():
    here = {name.removeprefix("test_") for name in globals() if name.startswith("test_")}
    assert set(QUERIES) - set(SQL) <= here, set(QUERIES) - set(SQL) - here


def test_word_tokens(spark):
    want = sorted((d, i, j, t) for d, ss in sentences() for i, s in enumerate(ss) for j, t in enumerate(WORDS.findall(s)))
    assert sorted((r.doc_id, r.sent_idx, r.tok_idx, r.token) for r in rows(spark, "word_tokens")) == want


def test_corpus_stats_words(spark):
    kept = [[w for w in (WORDS.findall(s) for s in ss) if w] for _, ss in sentences()]
    kept = [ss for ss in kept if ss]
    words = [w for ss in kept for s in ss for w in s]
    r = rows(spark, "corpus_stats_words")[0]
    n = sum(map(len, kept))
    assert (r.paragraphs, r.sentences, r.words, r.unique_words) == (len(kept), n, len(words), len(set(words)))
    assert math.isclose(r.avg_sentence_length, len(words) / n, abs_tol=1e-6) and math.isclose(r.type_token_ratio, len(set(words)) / len(words), abs_tol=1e-6)


def test_dfa_test_words(spark):
    got = rows(spark, "dfa_test_words")
    for r in got:
        assert r.accepted == bool(regex.fullmatch("[a-z]+|[A-Z][a-z]*", r.word)) == r.category.startswith("valid"), r
    assert Counter(r.category for r in got) == {**dict.fromkeys(T.WORD_CATEGORIES, 5), "leading_space": 2, "empty": 1, "all_uppercase": 2}
    assert T.sample_words(2) == [w for w in T.sample_words(5) if w in T.sample_words(2)] and T.sample_words(seed=1) != T.sample_words(seed=2)


def test_plural_fst_edges(spark):
    got = rows(spark, "plural_fst_edges")
    assert Counter(r.diagram for r in got) == {"detailed": 18, "simplified": 10, "english": 13}
    for name, start, accept in (("detailed", "START", "ACCEPT"), ("simplified", "q0", "q5"), ("english", "q0", "q6")):
        edges = [(r.source, r.target) for r in got if r.diagram == name]
        seen = {start}
        for _ in edges:
            seen |= {b for a, b in edges if a in seen}
        assert accept in seen and seen >= {a for a, _ in edges}


def test_memory_monitor(spark):
    got = {r.place: r for r in rows(spark, "memory_monitor")}
    assert got["driver python"].used_mb > 1 and 0 < got["driver heap"].used_mb <= got["driver heap"].limit_mb and any(p.startswith("storage") for p in got)


@functools.cache
def word_types():
    return Counter(w.lower() for _, t in documents() for w in SUBWORDS.findall(t or ""))


def joined(symbols, pair):
    out = []
    for s in symbols:
        if out and (out[-1], s) == pair:
            out[-1] = (out[-1] + s,)  # closed: not joined again in this pass
        else:
            out.append(s)
    return [s[0] if isinstance(s, tuple) else s for s in out]


def encoded(word, ranks):
    """Merges in rank order, each over the whole word."""
    symbols, done = list(word), -1
    while ready := {ranks[p]: p for p in zip(symbols, symbols[1:]) if ranks.get(p, -1) > done}:
        done = min(ready)
        symbols = joined(symbols, ready[done])
    return symbols


def test_bpe_train(spark):
    """The first 60 merges by counting all pairs anew; the rest by what a merge must leave."""
    got = sorted(rows(spark, "bpe_train"), key=lambda r: r.rank)
    splits = {w: list(w) for w in word_types()}
    for r in got[:60]:
        stats = Counter()
        for w, s in splits.items():
            for p in zip(s, s[1:]):
                stats[p] += word_types()[w]
        best = min(stats, key=lambda p: (-stats[p], p))
        assert ((r.left, r.right), r.freq) == (best, stats[best])
        splits = {w: joined(s, best) for w, s in splits.items()}
    assert all(a.freq >= b.freq for a, b in zip(got, got[1:])) and [r.rank for r in got] == list(range(len(got)))
    ranks = {(r.left, r.right): r.rank for r in got}
    some = random.Random(1).sample(sorted(word_types()), 150)
    assert all(encoded(w, ranks) == [w] for w in some)  # nothing is left to merge, below 32,000 symbols


def test_bpe_encode(spark):
    ranks = {(r.left, r.right): r.rank for r in rows(spark, "bpe_train")}
    short = {p: k for p, k in ranks.items() if k < 300}
    from lexispark.operators import subword

    docs = spark.createDataFrame(documents(), "doc_id long, text string")
    table = spark.createDataFrame([(k, *p) for p, k in short.items()], "rank int, left string, right string")
    size = {w: len(encoded(w, short)) for w in word_types()}
    want = {d: (len(ws), sum(size[w.lower()] for w in ws)) for d, t in documents() if (ws := SUBWORDS.findall(t or ""))}
    assert {r.doc_id: (r.words, r.tokens) for r in subword.bpe_token_counts(docs, "doc_id", "text", table).collect()} == want
    whole = {r.doc_id: (r.words, r.tokens) for r in rows(spark, "bpe_encode")}
    assert whole.keys() == want.keys() and all(w == want[d][0] and w <= t <= want[d][1] for d, (w, t) in whole.items())


def test_wordpiece_encode(spark):
    vocab = {r.piece for r in rows(spark, "wordpiece_vocab")}

    def encode(word):
        out, low = [], 0
        while low < len(word):
            high = next((h for h in range(len(word), low, -1) if ("##" if low else "") + word[low:h] in vocab), None)
            out.append(("##" if low else "") + word[low:high] if high else "[UNK]")
            low = high or low + 1
        return " ".join(out)

    assert {r.word: r.pieces for r in rows(spark, "wordpiece_encode")} == {w: encode(w) for w in word_types()}


def shape(w):
    for tag, rule in (("NUM", "[0-9]"), ("DEV", "[\u0900-\u097f]+$"), ("CAP", "[A-Z]"), ("LOW", "[a-z]+$")):
        if regex.match(rule, w):
            return tag
    return "OTH"


class Tagger:
    def __init__(self, train):
        self.move, self.emit, self.total = Counter(), Counter(), Counter()
        for words in train:
            tags = [shape(w) for w in words]
            for a, b in zip(["<START>", *tags], [*tags, "<END>"]):
                self.move[a, b] += 1
                self.total[a] += 1
            for t, w in zip(tags, words):
                self.emit[t, w] += 1
                self.total[t] += 1
        self.states = len({t for p in self.move for t in p})
        self.tags = sorted({t for p in self.move for t in p} - {"<START>", "<END>"})
        self.vocab = len({w for _, w in self.emit})

    def step(self, a, b):
        return math.log((self.move[a, b] + 1) / (self.total[a] + self.states))

    def word(self, t, w):
        return math.log((self.emit[t, w] + 1) / (self.total[t] + self.vocab))

    def score(self, words, tags):
        return sum(self.step(a, b) + self.word(b, w) for a, b, w in zip(["<START>", *tags], tags, words))

    def best(self, words):
        paths = {t: (self.step("<START>", t) + self.word(t, words[0]), (t,)) for t in self.tags}
        for w in words[1:]:
            paths = {t: max(((s + self.step(p, t) + self.word(t, w), (*path, t)) for p, (s, path) in paths.items()), key=lambda x: x[0]) for t in self.tags}
        return max(paths.values(), key=lambda x: x[0])


def test_viterbi_decode(spark):
    tagger = Tagger([w for s, w, _ in passages().values() if s == "train" and w])
    got = {}
    for r in rows(spark, "viterbi_decode"):
        got.setdefault(r.sent_id, []).append((r.pos, r.word, r.tag))
    held = {i: w for i, (s, w, _) in passages().items() if s == "test" and w}
    assert got.keys() == held.keys()
    for i, words in held.items():
        path = sorted(got[i])
        assert [w for _, w, _ in path] == words
        assert math.isclose(tagger.score(words, [t for _, _, t in path]), tagger.best(words)[0], rel_tol=1e-9)


def test_tagger_cross_validation(spark):
    train = [w for s, w, _ in passages().values() if s == "train" and w]
    size = len(train) // 3
    reports = []
    for k in range(3):
        low, high = k * size, (k + 1) * size if k < 2 else len(train)
        tagger = Tagger(train[:low] + train[high:])
        pairs = Counter((shape(w), t) for words in train[low:high] for w, t in zip(words, tagger.best(words)[1]))
        truth, guess = Counter(), Counter()
        for (a, b), n in pairs.items():
            truth[a] += n
            guess[b] += n
        p = {t: pairs[t, t] / guess[t] if guess[t] else 0.0 for t in truth}
        r = {t: pairs[t, t] / truth[t] for t in truth}
        f = [2 * p[t] * r[t] / (p[t] + r[t]) if p[t] + r[t] else 0.0 for t in truth]
        reports.append((sum(pairs[t, t] for t in truth) / sum(truth.values()), sum(p.values()) / len(p), sum(r.values()) / len(r), sum(f) / len(f)))
    got = rows(spark, "tagger_cross_validation")[0]
    want = [sum(x) / 3 for x in zip(*reports)]
    assert all(math.isclose(a, b, abs_tol=2e-3) for a, b in zip((got.accuracy, got.macro_precision, got.macro_recall, got.macro_f1), want)), (got, want)


class BackOff:
    """Scores by plain recursion over the train split as one text."""

    def __init__(self, kind):
        flat = [w for s, ws, _ in passages().values() if s == "train" for w in ws]
        c = {n: Counter(tuple(flat[i : i + n]) for i in range(len(flat) - n + 1)) for n in (1, 2, 3, 4)}
        self.p, self.alpha, self.vocab = {}, {}, sorted(w for (w,) in c[1])
        ones = c[1] if kind == "katz" else Counter((g[1],) for g in c[2])
        self.p.update({g: k / sum(ones.values()) for g, k in ones.items()})
        for n in (2, 3, 4):
            nc, mass, kinds = Counter(c[n].values()), Counter(), Counter()
            cut = max(0.5, min(0.95, nc[1] / (nc[1] + 2 * nc[2]))) if nc[1] and nc[2] else 0.75
            low = {g: k if k > 5 else (k + 1) * nc[k + 1] / nc[k] if nc[k + 1] else max(k - 0.5, 0) for g, k in c[n].items()} if kind == "katz" else c[n]
            for g, k in low.items():
                mass[g[:-1]] += k
                kinds[g[:-1]] += 1
            for g, k in low.items():
                self.p[g] = (k if kind == "katz" else max(k - cut, 0)) / mass[g[:-1]]
            self.alpha.update({h: 0.0 if kind == "katz" else cut * kinds[h] / m for h, m in mass.items()})

    def score(self, g):
        if g in self.p:
            return self.p[g]
        return 1 / (1000 * len(self.vocab)) if len(g) == 1 else self.alpha.get(g[:-1], 1.0) * self.score(g[1:])

    @functools.cache
    def following(self, context):
        p = {w: self.score((*context, w)) for w in [*self.vocab, "</s>"]}
        total = sum(p.values())
        return sorted(((x / total if total else 1 / len(p), w) for w, x in p.items()), key=lambda x: (-x[0], x[1]))


def text_of(spark, name, kind):
    return [r.word for r in sorted(rows(spark, name), key=lambda r: r.pos) if r.model == kind]


@functools.cache
def greedy_of(kind):
    model, out = BackOff(kind), []
    while len(out) < 15:
        ranked = [w for _, w in model.following(tuple(out[-3:])) if w != "<s>"]
        if ranked[0] == "</s>" and len(out) >= 3:
            break
        out.append(next(w for w in ranked if w != "</s>"))
    return out


def test_greedy_generate(spark):
    for kind in ("katz", "kn"):
        assert text_of(spark, "greedy_generate", kind) == greedy_of(kind)


def test_generated_copies(spark):
    got = rows(spark, "generated_copies")
    assert Counter((r.model, r.method) for r in got) == {(m, h): 100 for m in ("katz", "kn") for h in ("greedy", "beam_search")}
    for kind in ("katz", "kn"):
        mine = [r for r in got if (r.model, r.method) == (kind, "greedy")]
        assert sorted(r.number for r in mine) == list(range(100)) and {r.sentence for r in mine} == {" ".join(greedy_of(kind))}
        assert {r.sentence for r in got if (r.model, r.method) == (kind, "beam_search")} == {" ".join(beam_of(kind)[1])}


@functools.cache
def beam_of(kind):
    """(score, text) of the best text; unfinished ones only where none ended."""
    model, live, ended = BackOff(kind), [(0.0, [])], []
    for _ in range(15):
        grown = []
        for s, text in live:
            for p, w in model.following(tuple(text[-3:]))[:20]:
                if p > 0:
                    (ended if w == "</s>" else grown).append((s + math.log(p), text if w == "</s>" else [*text, w]))
        live = sorted(grown, key=lambda x: (-x[0], x[1]))[:20]
        if not live:
            break
    return min(ended or live, key=lambda x: (-x[0], x[1]))


def test_beam_generate(spark):
    for kind in ("katz", "kn"):
        assert text_of(spark, "beam_generate", kind) == beam_of(kind)[1]
