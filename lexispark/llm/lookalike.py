"""Visually identical text: ignorable characters, width, composition, and look-alike lattices."""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters and signs that are drawn alike, first the plain form.
ALIKE = """
A А Α Ꭺ ꓮ Ⲁ
B В Β Ᏼ ꓐ Ⲃ
C С Ϲ Ꮯ ꓚ Ⲥ
D Ꭰ ꓓ
E Е Ε Ꭼ ꓰ
F Ϝ ꓝ
G Ԍ Ꮐ ꓖ
H Н Η Ꮋ ꓧ Ⲏ
I І Ι Ӏ ꓲ Ⲓ
J Ј Ꭻ ꓙ
K К Κ K Ꮶ ꓗ Ⲕ
L Ꮮ ꓡ
M М Μ Ꮇ ꓟ Ⲙ
N Ν ꓠ Ⲛ
O О Ο Օ ꓳ Ⲟ
P Р Ρ Ꮲ ꓑ Ⲣ
Q Ԛ
R Ꭱ ꓣ
S Ѕ Ꮪ ꓢ Տ
T Т Τ Ꭲ ꓔ Ⲧ
U ꓴ Ս
V Ꮩ ꓦ Ѵ
W Ԝ Ꮤ ꓪ
X Х Χ ꓫ Ⲭ
Y Ү Υ ꓬ Ⲩ
Z Ζ Ꮓ ꓜ Ⲍ
Å Å
a а ɑ
c с ϲ ᴄ ⲥ
d ԁ
e е
g ɡ
h һ հ
i і
j ј ϳ
o о ο օ ᴏ ⲟ
p р ρ ⲣ
q ԛ
s ѕ ꜱ
u ս
v ѵ ν ᴠ
w ԝ ᴡ
x х
y у
z ᴢ
Ω Ω
µ μ
: ः ։ ∶ ꞉
| । ǀ ∣ │
' ’ ‘ ʼ ′ ‛ ʹ
" ” “ ″ ‟
- ‐ ‑ – − ﹣
, ‚
; ;
· • ‧ ∙
/ ⁄ ∕
~ ∼
ك ک
ي ی ى
ه ہ
"""
# Sequences drawn like one letter.
ALIKE_SEQUENCES = """
आ अा
ओ अो आे
ऑ अॉ आॅ
औ अौ आै
ऐ एे
ऍ एॅ
ॲ अॅ
ऒ अॊ
ो ाे
ौ ाै
ॉ ाॅ
॥ ।।
… ...
र्\u200d ऱ्
আ অা
"""
#: Default ignorable signs besides the format characters.
IGNORABLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0\u00ad"
JOINERS = "\u200c\u200d"
VIRAMAS = "्্੍્୍்్್്්"
BLANKS = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@functools.cache
def alike_classes() -> dict[str, str]:
    """Look-alike letter -> the plain form of its class."""
    out: dict[str, str] = {}
    for line in ALIKE.split("\n"):
        members = line.split(" ")
        for m in members:
            if m:
                out[m] = members[0]
    return out


@functools.cache
def alike_members() -> dict[str, tuple[str, ...]]:
    """Plain form -> all members of its class."""
    out: dict[str, list[str]] = {}
    for member, plain in alike_classes().items():
        out.setdefault(plain, []).append(member)
    return {k: tuple(v) for k, v in out.items()}


@functools.cache
def alike_sequences() -> tuple[tuple[str, str], ...]:
    """(sequence, single form), longest first."""
    pairs = []
    for line in ALIKE_SEQUENCES.split("\n"):
        single, *others = line.split(" ") if line else [""]
        pairs += [(s, single) for s in others]
    return tuple(sorted(pairs, key=lambda p: -len(p[0])))


def ignorable(ch: str) -> bool:
    """Format characters, variation selectors and the like; joiners are judged by their neighbours."""
    return ch in IGNORABLE or (unicodedata.category(ch) == "Cf" and not "\u0600" <= ch <= "\u0605") or "︀" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef"


def script_of(ch: str) -> str:
    """A coarse script tag: the first word of the character's name, or its category when it is no letter."""
    kind = unicodedata.category(ch)
    if kind[0] not in "LM":
        return kind
    return unicodedata.name(ch, "UNKNOWN").split(" ", 1)[0]


#: Letters whose compatibility form is drawn differently, so they stay as they are.
DRAWN_APART = "ſẛϐϑϒϓϔϕϖϰϱϴϵϷ"
#: The kinds of compatibility form that change width, font or position in a word, not the letter.
SAME_LETTER = ("<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")


@functools.lru_cache(maxsize=65536)
def _compatible(ch: str) -> str:
    """The plain form of a compatibility character that is drawn as that form.

    Width, font and positional forms give their letter; ligatures, radicals and letter numerals (<compat>) give their letters if they
    consist of letters alone. Raised, lowered, circled and squared forms and fractions stay, as do DRAWN_APART and
    the Hangul jamo that would compose into syllables.
    """
    how = unicodedata.decomposition(ch)
    if not how.startswith("<") or ch in DRAWN_APART or "\u3131" <= ch <= "\u318e":
        return ch
    form = unicodedata.normalize("NFKC", ch)
    if how.startswith(SAME_LETTER):
        return ch if form.startswith(" ") else form
    letter = unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nl" or "\u2e80" <= ch <= "\u2fdf"
    return form if how.startswith("<compat>") and letter and all(unicodedata.category(c)[0] in "LM" for c in form) else ch


@functools.cache
def compatible_map() -> dict[int, str]:
    """Code point -> plain form of every character that has one."""
    found = ((i, _compatible(chr(i))) for i in (*range(0xA0, 0xD800), *range(0xF900, 0x1FFFF)))
    return {i: form for i, form in found if form != chr(i)}


_ARABIC = ("\u0600", "ۿ")


def _joiner_counts(text: str, i: int) -> bool:
    """Whether a joiner changes the drawn shape: after a virama, or between joining Arabic letters."""
    j = i - 1
    while j >= 0 and (text[j] in JOINERS or ignorable(text[j])):
        j -= 1
    if j < 0:
        return False
    if text[j] in VIRAMAS:
        return True
    k = i + 1
    while k < len(text) and (text[k] in JOINERS or ignorable(text[k])):
        k += 1
    inside = lambda c: _ARABIC[0] <= c <= _ARABIC[1] and unicodedata.category(c) == "Lo"
    return text[i] == "\u200c" and inside(text[j]) and k < len(text) and inside(text[k]) and text[j] not in "اأإآدذرزژڑڈوۆےۓ"


def plain(text: str) -> str:
    """Compatibility step: width, font, ligatures, composition, blanks and ignorable characters made one; case and accents stay."""
    if text.isascii() and text.isprintable():
        return text.strip(" ")
    out = []
    for i, ch in enumerate(text):
        if ch in JOINERS:
            if _joiner_counts(text, i):
                out.append(ch)
        elif ch in BLANKS:
            out.append(" ")
        elif not ignorable(ch):
            out.append(_compatible(ch))
    return unicodedata.normalize("NFC", "".join(out)).strip(" ")


def skeleton(text: str) -> str:
    """What the text looks like: every character replaced by the plain form of its look-alike class.

    Two texts print the same exactly if their skeletons are equal.
    """
    text = plain(text)
    if text.isascii():
        return text.replace("...", "…")
    for sequence, single in alike_sequences():
        if sequence in text:
            text = text.replace(sequence, single)
    classes = alike_classes()
    return "".join(classes.get(c, c) for c in text).replace("||", classes.get("॥", "॥"))


def symbol(ch: str) -> str:
    """n-gram alphabet: members of look-alike classes stand for themselves, all else for its script."""
    return ch if ch in alike_classes() else f"<{script_of(ch)}>"


def bigram_symbols(text: str) -> list[tuple[str, str]]:
    s = ["^", *map(symbol, plain(text)), "$"]
    return list(zip(s, s[1:]))


class ScriptModel:
    """Character bigram log-probabilities over the alphabet of symbol(); bounded by that alphabet squared."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.left: dict[str, int] = {}
        for (a, _), n in counts.items():
            self.left[a] = self.left.get(a, 0) + n
        self.counts = counts
        self.size = max(1, len({b for _, b in counts}))

    def score(self, a: str, b: str) -> float:
        return math.log((self.counts.get((a, b), 0) + 0.1) / (self.left.get(a, 0) + 0.1 * self.size))


def canonical(text: str, model: ScriptModel) -> str:
    """The best path through the look-alike lattice of the text.

    The lattice has, at every place of the skeleton, all members of that look-alike class; Viterbi finds the
    path of highest bigram score, of equal ones the one with the smaller characters. Texts that
    print the same have the same lattice and so get the same form; others never do, as classes are disjoint.
    """
    members = alike_members()
    layer: list[tuple[float, str, str]] = [(0.0, "^", "")]
    place = [members.get(c, (c,)) for c in skeleton(text)]
    back: list[list[tuple[str, int]]] = []
    for options in place:
        nxt, links = [], []
        for ch in sorted(options):
            sym = symbol(ch)
            best, at = max(((s + model.score(a, sym), -k) for k, (s, a, _) in enumerate(layer)))
            nxt.append((best, sym, ch))
            links.append((ch, -at))
        layer = nxt
        back.append(links)
    if not place:
        return ""
    _, at = max(((s + model.score(a, "$"), -k) for k, (s, a, _) in enumerate(layer)))
    at = -at
    out = []
    for links in reversed(back):
        ch, at = links[at]
        out.append(ch)
    return "".join(reversed(out))


def _count_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], int] = {}
    for batch in batches:
        for t in batch.column(0).to_pylist():
            for pair in bigram_symbols(t):
                counts[pair] = counts.get(pair, 0) + 1
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()), type=pa.int64())], names=["a", "b", "n"])


def train_script_model(strings: DataFrame, column: str) -> ScriptModel:
    """Bigram counts over all distinct strings.

    What reaches the driver is at most (members of all look-alike classes + script tags) squared rows,
    whatever the size of the table: a few hundred symbols.
    """
    counted = strings.select(column).mapInArrow(_count_symbols, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return ScriptModel({(r.a, r.b): r.n for r in counted.toLocalIterator()})


def canonical_forms(strings: DataFrame, column: str, model: ScriptModel | None = None) -> DataFrame:
    """Distinct strings of ``column`` with ``canonical``, the one form all texts that print alike share.

    Nulls are left out; the empty string and strings of blanks have the empty form. Every distinct string
    is handled once, however often it is stored.
    """
    distinct = strings.where(F.col(column).isNotNull()).select(column).distinct()
    model = model or train_script_model(distinct, column)
    shared = strings.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            forms = [canonical(t, m) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, type=pa.string())], names=[column, "canonical"])

    return distinct.mapInArrow(step, f"`{column}` string, canonical string")


def same_print_pairs(forms: DataFrame, column: str) -> DataFrame:
    """Pairs form_lo < form_hi of different strings with one canonical form.

    The result is defined as pairs, so its size is that of the answer; the join runs by canonical form over
    distinct strings, and a form with very many spellings is split by Spark's skew join.
    """
    left = forms.select("canonical", F.col(column).alias("form_lo"))
    right = forms.select("canonical", F.col(column).alias("form_hi"))
    several = forms.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("canonical")
    return left.join(several, "canonical", "left_semi").join(right, "canonical").where(F.col("form_lo") < F.col("form_hi")).select("form_lo", "form_hi")
