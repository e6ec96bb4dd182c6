"""Tokenisers, flags and word rules as column expressions: no Python in the hot path.

Regular expressions follow the Unicode sense of the classes: a word character is a letter, a number or '_', and
combining marks are none. Null text gives an empty array (or null, for scalars).
"""

from __future__ import annotations

import random
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the word tokeniser, first alternative wins at each place.
NOT_BLANK = r"[^\s\p{Z}\x{85}\x{1c}-\x{1f}]"
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
WORD_PATTERNS = (
    rf"https?://{NOT_BLANK}+",
    rf"www\.{NOT_BLANK}+",
    rf"{NOT_BLANK}+@{NOT_BLANK}+\.{NOT_BLANK}+",
    rf"{BEFORE}\p{{Nd}}{{1,2}}[-/.]\p{{Nd}}{{1,2}}[-/.]\p{{Nd}}{{2,4}}{AFTER}",
    rf"{BEFORE}\p{{Nd}}+(?:\.\p{{Nd}}+)?{AFTER}",
    r"[\x{900}-\x{97f}]+",
    r"[\x{a80}-\x{aff}]+",
    r"[\x{980}-\x{9ff}]+",
    r"[\x{b80}-\x{bff}]+",
    r"[\x{c00}-\x{c7f}]+",
    r"[\x{c80}-\x{cff}]+",
    r"[\x{d00}-\x{d7f}]+",
    r"[\x{a00}-\x{a7f}]+",
    r"[\x{b00}-\x{b7f}]+",
    r"[\x{600}-\x{6ff}]+",
    r"[a-zA-Z]+",
    r"""[।॥!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""",
)
WORD_PATTERN = "|".join(f"(?:{p})" for p in WORD_PATTERNS)
#: The message tokeniser (links, addresses, dates, numbers, words, signs).
MESSAGE_PATTERN = rf"https?://{NOT_BLANK}+|www\.{NOT_BLANK}+|[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}|\p{{Nd}}{{1,4}}[-/]\p{{Nd}}{{1,2}}[-/]\p{{Nd}}{{1,4}}|\p{{Nd}}+(?:\.\p{{Nd}}+)?|[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}]"
#: Pre-tokens of the sub-word models.
SUBWORD_PATTERN = r"[\x{900}-\x{97f}]+|[a-zA-Z]+|\p{Nd}+|[^\p{L}\p{N}_\s\p{Z}]"
SENTENCE_END = r"[.!?।॥]\s*"
EDGE_BLANKS = " \t\n\r\x0b\x0c"
#: Fixed value: what counts as white space when files are parted and stripped.
WHITE = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Lists of the plural analyser.
IRREGULAR_PLURALS = {
    "children": "child", "feet": "foot", "teeth": "tooth", "men": "man", "women": "woman", "mice": "mouse", "geese": "goose", "people": "person",
}
NO_ES_PLURAL = ("analyses", "bases", "crises", "diagnoses", "hypotheses", "oases", "parentheses", "syntheses", "theses")
ENDS_IN_S = (
    "lens", "bus", "gas", "glass", "class", "mass", "pass", "bass", "grass", "dress", "stress", "press", "chess", "mess", "less",
    "business", "princess", "process", "success", "access", "address",
)
# Affixes in the order in which they are tried.
PREFIXES = ("un", "re", "in", "im", "dis", "en", "non", "over", "mis", "sub", "pre", "inter", "fore", "de", "trans", "super", "semi", "anti", "mid", "under")
SUFFIXES = ("ies", "es", "s", "ing", "ed", "er", "est", "ment", "ness", "tion", "able", "ful", "al", "ous", "ly")


def _nonempty(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: x != "")


def _all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space (WHITE) at its edges."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def sentence_split(text: Column) -> Column:
    """Parts between sentence ends (also danda), trimmed, empty ones dropped. Abbreviations and decimals split too."""
    edges = lambda x: F.trim(x, F.lit(EDGE_BLANKS))
    return _nonempty(F.transform(F.split(edges(F.coalesce(text, F.lit(""))), SENTENCE_END), edges))


def word_tokens(sentence: Column) -> Column:
    """Links, addresses, dates, numbers, runs of one script, single signs; all else is left out."""
    return _all_matches(sentence, WORD_PATTERN)


def message_tokens(text: Column) -> Column:
    """Tokens of short messages: links, addresses, dates, numbers, words, signs."""
    return _all_matches(text, MESSAGE_PATTERN)


def subword_pretokens(text: Column) -> Column:
    """Runs of Devanagari, ASCII letters, digits, and single signs, in lower case; accented letters are left out."""
    return F.transform(_all_matches(text, SUBWORD_PATTERN), F.lower)


def blank_tokens(text: Column) -> Column:
    """Tokens between blanks."""
    return _nonempty(F.split(F.coalesce(text, F.lit("")), r"\s+"))


def has_url(text: Column) -> Column:
    return text.rlike(r"https?://|www\.").cast("int")


def has_number(text: Column) -> Column:
    return text.rlike(r"\p{Nd}").cast("int")


def has_exclaim(text: Column) -> Column:
    return text.contains("!").cast("int")


def is_alphabetic(word: Column) -> Column:
    """Whether a word has letters only; the empty word has none."""
    return word.rlike(r"^\p{L}+$")


def dfa_accepts(word: Column, accept_empty: bool = False) -> Column:
    """The automaton of words: one ASCII letter, then lower-case ASCII letters."""
    accepted = word.rlike(r"\A[A-Za-z][a-z]*\z")
    return (accepted | (word == "")) if accept_empty else accepted


def run_dfa(word: Column, moves: dict[tuple[str, str], str], start: str, finals: set[str], reject: str = "reject") -> Column:
    """Whether any table-driven automaton accepts the word: a fold over its characters.

    ``moves`` maps (state, character) to a state; a missing move leads to ``reject``, which is never left.
    """
    table = F.create_map(*[x for (s, c), t in moves.items() for x in (F.lit(f"{s}\x1f{c}"), F.lit(t))])
    step = lambda state, c: F.coalesce(F.element_at(table, F.concat(state, F.lit("\x1f"), c)), F.lit(reject))
    letters = F.filter(F.split(word, ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(start), step).isin(*sorted(finals))


def word_automaton() -> tuple[dict[tuple[str, str], str], str, set[str]]:
    """(moves, start, finals) of the automaton of English words: an ASCII letter, then lower-case ASCII letters; all else rejects."""
    moves = {("q0", c): "q1" for c in string.ascii_lowercase} | {("q0", c): "q2" for c in string.ascii_uppercase}
    moves |= {(state, c): state for state in ("q1", "q2") for c in string.ascii_lowercase}
    return moves, "q0", {"q1", "q2"}


#: The categories of test words, and the signs that make a word special.
WORD_CATEGORIES = ("valid_lower", "valid_initial_cap", "invalid_upper_later", "invalid_contains_digit", "invalid_starts_digit", "invalid_special", "leading_space", "empty", "all_uppercase")
SPECIAL_SIGNS = " _-@.!?,'"


def sample_words(per_category: int = 5, longest: int = 8, seed: int = 42) -> list[tuple[str, int, str]]:
    """(category, number, word): seeded words, ``per_category`` of each kind; half as many that begin with a blank or are all upper case, one empty.

    Every word is drawn from a generator of its own (seed, category, number), so asking for more leaves the first ones as they are.
    """
    low, up = string.ascii_lowercase, string.ascii_uppercase

    def made(category: str, rnd: random.Random) -> str:
        body = "".join(rnd.choices(low, k=rnd.randint(2, longest)))
        spot = rnd.randint(1, len(body) - 1)
        put = lambda sign: body[:spot] + sign + body[spot:]
        return {
            "valid_lower": body, "valid_initial_cap": body.capitalize(), "invalid_upper_later": put(rnd.choice(up)), "invalid_contains_digit": put(rnd.choice(string.digits)),
            "invalid_starts_digit": rnd.choice(string.digits) + body, "invalid_special": put(rnd.choice(SPECIAL_SIGNS)), "leading_space": " " + body, "empty": "", "all_uppercase": body.upper(),
        }[category]

    some = {"leading_space": max(1, per_category // 2), "all_uppercase": max(1, per_category // 2), "empty": 1}
    return [(c, i, made(c, random.Random(f"{seed}-{c}-{i}"))) for c in WORD_CATEGORIES for i in range(some.get(c, per_category))]


# The labelled edges of the three drawings of the plural automaton: from, to, input/output.
DETAILED_EDGES = """
START ROOT α/α
ROOT S_END s/+PL
ROOT Z_END z/+PL
ROOT X_END x/+PL
ROOT CH_END ch/+PL
ROOT SH_END sh/+PL
ROOT Y_END y/ies
S_END ACCEPT es/ε
Z_END ACCEPT es/ε
X_END ACCEPT es/ε
CH_END ACCEPT es/ε
SH_END ACCEPT es/ε
Y_END ACCEPT ies/ε
ROOT ACCEPT s/+PL
START ACCEPT irregular/+PL
ROOT ACCEPT ε/+SG
START REJECT invalid/ε
ROOT REJECT invalid/ε
"""
SIMPLIFIED_EDGES = """
q0 q1 letter/letter
q1 q1 letter/letter
q1 q2 s,x,z,ch,sh/stem
q2 q5 es/+N+PL
q1 q3 consonant+y/stem
q3 q5 ies/+N+PL
q1 q5 s/+N+PL
q1 q5 ε/+N+SG
q0 q4 irregular_word/stem
q4 q5 ε/+N+PL
"""
ENGLISH_EDGES = """
q0 q1 α (letter)
q1 q1 α (continue reading)
q1 q2 word ending
q2 q6 s → +N+PL
q1 q3 s|x|z|ch|sh ending
q3 q6 es → +N+PL
q1 q4 consonant+y ending
q4 q6 y→ies → +N+PL
q0 q5 irregular pattern
q5 q6 irregular → +N+PL
q2 q6 no suffix → +N+SG
q0 q7 invalid input
q1 q7 invalid pattern
"""


def plural_edges() -> list[tuple[str, str, str, str]]:
    """(diagram, source, target, label) of the three drawings."""
    tables = {"detailed": DETAILED_EDGES, "simplified": SIMPLIFIED_EDGES, "english": ENGLISH_EDGES}
    return [(name, *line.split(" ", 2)) for name, table in tables.items() for line in table.strip().split("\n")]


def plural_root(word: Column) -> Column:
    """Struct (root, number) of a word by the plural automaton; null root where the word is not alphabetic."""
    w = F.lower(word)
    n = F.length(w)
    cut = lambda k: F.substring(w, 1, n - k)
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR_PLURALS.items() for x in pair])
    es_stem = cut(2)
    sibilant = es_stem.rlike("(s|x|z|ch|sh)$")
    es = w.endswith("es") & (n > 2)
    listed = es & w.isin(*NO_ES_PLURAL)
    root = (
        F.when(w.isin(*IRREGULAR_PLURALS), F.element_at(irregular, w))
        .when(listed, F.lit(None).cast("string"))
        .when(es & sibilant, es_stem)
        .when(w.endswith("ies") & (n > 3) & ~w.endswith("eies"), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("s") & (n > 1) & ~w.endswith("es") & ~w.isin(*ENDS_IN_S) & (n - 1 >= 2), cut(1))
    )
    valid = is_alphabetic(word)
    return F.struct(F.when(valid, F.coalesce(root, w)).alias("root"), F.when(valid, F.when(root.isNotNull(), "PL").otherwise("SG")).alias("number"))


def plural_analysis(word: Column) -> Column:
    """The analysis in words: 'w = root+N+PL', 'w = w+N+SG' or 'w: Invalid Word'."""
    a = plural_root(word)
    return F.when(a["root"].isNull(), F.concat(F.coalesce(word, F.lit("")), F.lit(": Invalid Word"))).otherwise(F.concat(F.lower(word), F.lit(" = "), a["root"], F.lit("+N+"), a["number"]))


def rule_prefix(word: Column) -> Column:
    """The first prefix of PREFIXES that leaves at least two characters, or null."""
    tests = [F.when(word.startswith(p) & (F.length(word) > len(p) + 1), F.lit(p)) for p in PREFIXES]
    return F.coalesce(*tests)


def rule_suffix(word: Column) -> Column:
    """Struct (stem, suffix) of the first suffix of SUFFIXES that leaves at least two characters, or null."""

    def test(s: str) -> Column:
        stem = F.substring(word, 1, F.length(word) - len(s))
        stem = F.concat(stem, F.lit("y")) if s == "ies" else stem
        return F.when(word.endswith(s) & (F.length(word) > len(s) + 1), F.struct(stem.alias("stem"), F.lit(s).alias("suffix")))

    return F.coalesce(*[test(s) for s in SUFFIXES])


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression named inside a lambda would run again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array as arrays, in order; arrays shorter than n have none."""
    empty = F.array().cast("array<array<string>>")
    return let(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.slice(t, i, n))).otherwise(empty))


def adjacent_pairs(symbols: Column) -> Column:
    """Distinct neighbouring pairs of an array."""
    return F.array_distinct(ngrams(symbols, 2))


def merge_pair(symbols: Column, left: str, right: str) -> Column:
    """Every left+right pair joined, from left to right without overlap: a fold over the array."""
    empty = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        joined = (F.size(done) > 0) & (F.element_at(done, -1) == left) & (x == right)
        return F.when(joined, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.lit(left + right)))).otherwise(F.concat(done, F.array(x)))

    folded = F.aggregate(symbols, empty, step)
    return F.when(F.size(symbols) > 0, folded).otherwise(empty)
