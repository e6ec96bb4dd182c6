"""Every pN_ query without SQL against a plain Python version, on the whole smallest tables with production parameters."""

import math
import sys
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from conftest import data, duck  # noqa: E402

from lexispark.llm import lookalike, packing, sentences  # noqa: E402
from lexispark.llm.queries import QUERIES, SQL  # noqa: E402


def rows(spark, name):
    return QUERIES[name](spark, data()).collect()


def fetched(sql):
    return duck(data()).execute(sql).fetchall()


def latest(found):
    """Of (key, moment, ...) rows the last per key."""
    out = {}
    for r in found:
        if r[0] not in out or out[r[0]][1] < r[1]:
            out[r[0]] = r
    return out


def folded(text):
    """Words as problems 6, 9 and 10 see them, character by character."""
    out, word = [], ""
    for ch in lookalike.skeleton(text or "").casefold().replace("‍", "").replace("‌", ""):
        ch = lookalike.skeleton(ch).casefold() or ch
        if unicodedata.category(ch[0])[0] in "LM" or unicodedata.category(ch[0]) == "Nd":
            word += ch
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def test_all_queries_without_sql_are_listed():
    here = {name.removeprefix("test_") for name in globals() if name.startswith("test_")}
    assert set(QUERIES) - set(SQL) <= here, set(QUERIES) - set(SQL) - here


def passages():
    return latest(fetched("SELECT sent_id, ingested_at, sentence, lang, split_name, source FROM application"))


def test_p1_found(spark):
    """Sentences lie in order, cover all but blanks, end at line breaks, and are those of the automaton on the text alone."""
    spans = defaultdict(list)
    for r in rows(spark, "p1_found"):
        spans[r.sent_id].append((r.start_char, r.end_char))
    for i, (_, _, text, *_) in passages().items():
        own = sorted(spans.get(i, []))
        flat = sentences.sentence_spans(text)
        assert own == list(zip(flat[::2], flat[1::2]))
        kept = "".join(text[a:b] for a, b in own) if text else ""
        assert "".join(kept.split()) == "".join((text or "").split())
        assert all(text[a:b] == text[a:b].strip() and "\n" not in text[a:b] for a, b in own)


def test_p1_sentence_stats(spark):
    length = defaultdict(list)
    lang = {i: r[3] for i, r in passages().items()}
    for r in rows(spark, "p1_found"):
        length[lang[r.sent_id]].append(r.end_char - r.start_char)
    got = {r.lang: (r.sentences, r.mean_chars, r.max_chars) for r in rows(spark, "p1_sentence_stats")}
    assert got.keys() == length.keys()
    assert all(n == len(x) and top == max(x) and math.isclose(mean, sum(x) / len(x), abs_tol=1e-6) for (n, mean, top), x in ((got[k], length[k]) for k in got))


def vectors():
    """vec -> (split, source, {column: value}) of the blocks as loaded last."""
    out = {}
    for _, _, split, source, first, n, values, columns, bounds in latest(fetched("SELECT block_id, loaded_at, split_name, source, first_vec, n_rows, data, indices, indptr FROM bonus")).values():
        for i in range(n):
            low, high = bounds[i] - bounds[0], bounds[i + 1] - bounds[0]
            v = defaultdict(float)
            for c, x in zip(columns[low:high], values[low:high]):
                if x is not None and x == x:
                    v[c] += x
            out[first + i] = (split, source, {c: x for c, x in v.items() if x})
    return out


def nearest():
    unit = {}
    for i, (_, _, v) in vectors().items():
        norm = math.sqrt(sum(x * x for x in v.values()))
        unit[i] = {c: x / norm for c, x in v.items()}
    by_column = defaultdict(list)
    for i, v in unit.items():
        for c, x in v.items():
            by_column[c].append((i, x))
    out = {}
    for i, v in unit.items():
        score = Counter()
        for c, x in v.items():
            for j, y in by_column[c]:
                score[j] += x * y
        out[i] = sorted((-round(s, 6), j) for j, s in score.items() if j != i and round(s, 6) >= 0.6)[:5]
    return out


def test_p4_found(spark):
    want = {(min(i, j), max(i, j)) for i, near in nearest().items() for _, j in near}
    assert {(r.vec_lo, r.vec_hi) for r in rows(spark, "p4_found")} == want and want


def test_p4_nearest(spark):
    got = {(r.vec, r.near, r.cosine) for r in rows(spark, "p4_nearest")}
    assert got == {(i, j, -s) for i, near in nearest().items() for s, j in near}


def sets():
    """(kind, id) -> (split, source, entries)."""
    out = {("sentence", i): (r[4], r[5], frozenset(folded(r[2]))) for i, r in passages().items()}
    return out | {("vector", i): (split, source, frozenset(v)) for i, (split, source, v) in vectors().items()}


def overlaps():
    out, all_sets = {}, sets()
    lists = defaultdict(list)
    for key, (split, _, s) in all_sets.items():
        if split == "train":
            for x in s:
                lists[key[0], x].append(key[1])
    for (kind, i), (split, source, s) in all_sets.items():
        if split in ("val", "test"):
            shared = Counter(j for x in s for j in lists[kind, x])
            for j, n in shared.items():
                share = n / (len(s) + len(all_sets[kind, j][2]) - n)
                if share >= 0.7:
                    out[kind, split, source, i, j] = share
    return out


def test_p6_found(spark):
    got = {(r.kind, r.eval_split, r.source, r.id_lo, r.id_hi) for r in rows(spark, "p6_found")}
    assert got == {(k, sp, so, min(i, j), max(i, j)) for k, sp, so, i, j in overlaps()} and got


def test_p6_overlap_report(spark):
    found = overlaps()
    linked, exact, links, records = defaultdict(set), defaultdict(set), Counter(), Counter()
    for (kind, split, source, i, j), share in found.items():
        linked[kind, split, source].add(i)
        links[kind, split, source] += 1
        if share == 1:
            exact[kind, split, source].add(i)
    for (kind, _), (split, source, s) in sets().items():
        records[kind, split, source] += bool(s) and split in ("val", "test")
    got = {(r.kind, r.eval_split, r.source): (r.records, r.overlapping, r.exact, r.links) for r in rows(spark, "p6_overlap_report")}
    assert got == {k: (n, len(linked[k]), len(exact[k]), links[k]) for k, n in records.items() if n}


def test_p6_weighted_overlaps(spark):
    train = {i: v for i, (split, _, v) in vectors().items() if split == "train" and v}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for i, (split, source, v) in vectors().items():
        if split in ("val", "test") and v:
            want[i] = (split, source, sum(sum(x * t.get(c, 0) for c, x in v.items()) / norm(v) / norm(t) >= 0.9 - 1e-9 for t in train.values()))
    assert {r.id: (r.split_name, r.source, r.links) for r in rows(spark, "p6_weighted_overlaps")} == want and any(n for _, _, n in want.values())


def prints():
    """field -> skeleton -> its strings."""
    out = {}
    for table, column in (("hindi_unigrams", "token"), ("marathi_trigrams", "w1")):
        groups = defaultdict(set)
        for (s,) in fetched(f"SELECT DISTINCT {column} FROM {table} WHERE {column} IS NOT NULL"):
            groups[lookalike.skeleton(s)].add(s)
        out[f"{table}.{column}"] = groups
    return out


def test_p7_found(spark):
    want = {(f, a, b) for f, groups in prints().items() for g in groups.values() for a in g for b in g if a < b}
    assert {(r.field_name, r.form_lo, r.form_hi) for r in rows(spark, "p7_found")} == want and want


def test_p7_canonical_counts(spark):
    """Spellings and summed counts per print; the form is one of the lattice, so it prints like its spellings."""
    counts = {i: (t, n) for i, n, t in fetched("SELECT uni_id, max(cnt), any_value(token) FROM hindi_unigrams WHERE token IS NOT NULL GROUP BY uni_id")}
    by_print = Counter()
    for t, n in counts.values():
        by_print[lookalike.skeleton(t)] += n or 0
    got = {lookalike.skeleton(r.canonical): (r.spellings, r.cnt or 0) for r in rows(spark, "p7_canonical_counts")}
    assert got == {k: (len(g), by_print[k]) for k, g in prints()["hindi_unigrams.token"].items()}


def sizes():
    encode = packing._encoding(Path(packing.TOKENIZER).read_bytes()).encode_ordinary
    return Counter({d: len(encode(t)) if t else 0 for d, t in fetched("SELECT doc_id, text FROM documents")})


def test_p8_containers(spark):
    """Every text is placed whole, only longer ones than a container are cut, pieces don't overlap and nothing is too full."""
    got, used = rows(spark, "p8_containers"), defaultdict(list)
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
        if r.n_tokens:
            used[r.container_id].append((r.offset, r.offset + r.n_tokens))
    want = sizes()
    assert total == want and all((r.piece == 0) == (r.first_token == 0) for r in got)
    assert all(r.piece == 0 or want[r.doc_id] > 2048 for r in got)
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_p8_fill_report(spark):
    r = rows(spark, "p8_fill_report")[0]
    tokens = sum(sizes().values())
    fewest = -(-tokens // 2048)
    assert r.fewest == fewest and r.fewest <= r.containers <= r.fewest + 2 and r.fullest <= 2048
    assert math.isclose(r.room_left, 1 - tokens / (r.containers * 2048), abs_tol=1e-6)


def leaks():
    windows, total = defaultdict(set), Counter()
    for i, t in fetched("SELECT item_id, text FROM heldout_items"):
        w = folded(t)
        for k in range(len(w) - 11):
            windows[tuple(w[k : k + 12])].add((i, k))
            total[i] += 1
    found = defaultdict(set)
    for d, t in fetched("SELECT doc_id, text FROM documents"):
        w = folded(t)
        for k in range(len(w) - 11):
            for i, place in windows.get(tuple(w[k : k + 12]), ()):
                found[d, i].add(place)
    return found, total


def test_p9_found(spark):
    assert {(r.doc_id, r.item_id) for r in rows(spark, "p9_found")} == set(leaks()[0]) != set()


def test_p9_leaked_items(spark):
    found, total = leaks()
    docs, share = Counter(), defaultdict(float)
    for (_, i), places in found.items():
        docs[i] += 1
        share[i] = max(share[i], len(places) / total[i])
    assert {r.item_id: (r.documents, r.greatest_share) for r in rows(spark, "p9_leaked_items")} == {i: (n, round(share[i], 6)) for i, n in docs.items()}


def repeated():
    out = {}
    for d, t in fetched("SELECT doc_id, text FROM documents"):
        w, seen = folded(t), set()
        mark = [False] * len(w)
        for k in range(len(w) - 7):
            run = tuple(w[k : k + 8])
            if run in seen:
                mark[k : k + 8] = [True] * 8
            seen.add(run)
        out[d] = (len(w), sum(mark))
    return out


def test_p10_found(spark):
    assert {r.doc_id for r in rows(spark, "p10_found")} == {d for d, (n, k) in repeated().items() if n and 10 * k >= 3 * n} != set()


def test_p10_repetition(spark):
    """The exact figures; the posteriors are held against brute force in test_llm_operators, and agree with the cases here."""
    got = {r.doc_id: r for r in rows(spark, "p10_repetition")}
    assert {d: (r.n_words, r.repeated_words) for d, r in got.items()} == repeated()
    assert {d for d, r in got.items() if r.posterior >= 0.5} == {d for d, (n, k) in repeated().items() if n and 10 * k >= 3 * n}
