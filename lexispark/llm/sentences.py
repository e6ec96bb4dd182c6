"""Sentence boundaries across languages and scripts by a pushdown automaton."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shortened words, written as before their last dot.
#: Never end a sentence when a text follows on the line.
TITLES = """Mr Mrs Ms Dr Prof St Sr Jr Rev Hon Gen Col Capt Lt Sgt Gov Sen Rep Pres Fr vs cf viz approx e.g i.e Fig Figs Eq Rs Vol Ch Sec
डॉ प्रो प्रा पं श्री सौ कु कि.मी से.मी मि.मी मी सं क्र पृ रु ता उदा इ.स ई.पू ई.स इ.पू स.न वि.सं चि मा स्व कै श्रीम इंजि अॅड
திரு திருமதி டாக்டர் ডা ড মো মি.মি কি.মি""".split()
#: End a sentence only if a capital follows.
CLOSERS_OF_TIME = "a.m p.m A.M P.M etc Co Ltd Inc Corp Bros U.S U.K".split()
#: Shortened only before a number.
BEFORE_NUMBER = "p pp No Nos no vol".split()
#: Names of Latin letters in Devanagari, used as initials.
LETTER_NAMES = "ए बी सी डी ई एफ जी एच आई आय जे के एल एम एन ओ पी क्यू आर एस टी यू वी डब्ल्यू व्ही एक्स वाई वाय जेड झेड".split()
#: Words that take up a quotation as part of their own clause, even one that "said," introduced.
QUOTATIVES = set("कहकर नामक बोलकर पूछकर म्हणून म्हणत नावाचा नावाची नावाचे বলে নামে নামক என்று என்ற எனும் کہہ نامی".split())
QUOTATIVE_STARTS = ("と", "って", "という")

END = ".!?।॥؟۔。！？…｡"
LINE = "\n\r\x0b\x0c\x85\u2028\u2029"
OPEN = {"“": "”", "‘": "’", "„": "“", "「": "」", "『": "』", "«": "»", "《": "》", "〈": "〉"}
CLOSE = {v: k for k, v in OPEN.items() if v != "“"}
BRACKET = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】"}
UNBRACKET = {v: k for k, v in BRACKET.items()}
CLOSING = "”’」』»》〉)]}）】\"'"
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad\u034f\ufe0e\ufe0f"
_BLANK = re.compile(r"[\s\x85\u2028\u2029]+")
_EVENT = re.compile(r"[.!?।॥|؟۔。！？…｡“”‘’„「」『』«»《》〈〉\"'()\[\]{}（）【】]|(?<=[฀-๿\u200b-\u200f\u2060\ufeff”\"'’)0-9!?])[^\S\n\r]+(?=[฀-๿“\"'‘(0-9\u200b-\u200f\u2060\ufeff])")
_LINES = re.compile(f"[^{LINE}]+")
_LIST = re.compile(r"\s*(?:\(?(?:\d{1,3}(?:\.\d{1,3})*|[a-zA-Zक-ह]|[ivxIVX]{1,5})[.)]|[-•*–])(?=\s)")
#: Longest run before a dot that is looked at as a word: no shortened word is longer.
LONGEST = 64
_TOKEN_END = " \t\u00a0\u2009\u202f\u3000(["


def _trie(words: list[str]) -> dict:
    """Character trie over reversed words: walked backwards from a dot."""
    root: dict = {}
    for word in words:
        node = root
        for ch in reversed(word):
            node = node.setdefault(ch, {})
        node[""] = True
    return root


_TITLE, _TIME, _NUMBERED, _LETTER = (_trie(x) for x in (TITLES, CLOSERS_OF_TIME, BEFORE_NUMBER, LETTER_NAMES))


def _ends_with(node: dict, text: str, low: int, dot: int) -> bool:
    """Whether the whole word before ``dot`` is in the trie; invisible characters don't count."""
    i = dot - 1
    while i >= low:
        ch = text[i]
        if ch in INVISIBLE:
            i -= 1
            continue
        if ch not in node:
            break
        node = node[ch]
        i -= 1
    return "" in node and (i < low or text[i].isspace() or text[i] in "(（[“‘\"'「")


def _next_visible(text: str, i: int, high: int) -> int:
    while i < high and (text[i] in INVISIBLE or text[i].isspace()):
        i += 1
    return i


def _cased_lower(ch: str) -> bool:
    return ch.islower()


def _uncased(ch: str) -> bool:
    return ch.isalpha() and ch.lower() == ch.upper()


def _matched(text: str, events: list[tuple[int, str]]) -> dict[int, int]:
    """Openers and closers that belong together: opener -> closer. An opener left alone is plain text.

    A closer nobody awaits is told by a count, so the stack is only walked to be shortened: linear work.
    """
    stack: list[tuple[str, int]] = []
    awaited: dict[str, int] = {}
    pairs: dict[int, int] = {}
    for i, ch in events:
        if ch in OPEN or ch in BRACKET:
            closer = OPEN.get(ch) or BRACKET[ch]
            stack.append((closer, i))
            awaited[closer] = awaited.get(closer, 0) + 1
            continue
        straight = ch in "\"'"
        if not straight and ch not in CLOSE and ch not in UNBRACKET:
            continue
        before = text[i - 1] if i else " "
        after = text[i + 1] if i + 1 < len(text) else " "
        if ch in "'\u2019" and before.isalnum() and after.isalnum():
            continue
        if awaited.get(ch, 0) and not (straight and before.isspace()):
            while True:
                closer, at = stack.pop()
                awaited[closer] -= 1
                if closer == ch:
                    pairs[at] = i
                    break
        elif straight and not after.isspace():
            stack.append((ch, i))
            awaited[ch] = awaited.get(ch, 0) + 1
    return pairs


class _Token:
    """The run between blanks around a dot, looked up once per run, and whether it is an address."""

    __slots__ = ("start", "stop", "address")

    def __init__(self) -> None:
        self.start = self.stop = -1
        self.address = False

    def at(self, text: str, low: int, high: int, dot: int) -> "_Token":
        if not self.start <= dot < self.stop:
            i = dot
            while i > low and text[i - 1] not in _TOKEN_END:
                i -= 1
            j = dot
            while j < high and text[j] not in _TOKEN_END:
                j += 1
            run = text[i:j]
            self.start, self.stop, self.address = i, j, "www." in run or "://" in run or "@" in run
        return self


def _dot_is_plain(text: str, low: int, high: int, dot: int, token: _Token) -> bool:
    """Whether a single dot stands inside a number, a name, an address or a shortened word."""
    before = text[dot - 1] if dot > low else " "
    k = dot + 1
    while k < high and text[k] in INVISIBLE:
        k += 1
    after = text[k] if k < high else ""
    if after.isdigit() and (before.isdigit() or before.isspace()):
        return True
    run = token.at(text, low, high, dot)
    start = max(run.start, low, dot - LONGEST)
    if after and not after.isspace() and after not in CLOSING:
        if not (after.isalnum() or after in "/@_-") or run.address:
            return True
        first = max(run.start, low)
        if text.rfind(".", first, dot) >= 0:  # looks back to the last dot only, so a run is read once
            return True
        word = text[first:dot].strip("\u201c\u2018\"'\u300c")
        if len(word) < 4:
            return True
        if after.isascii():
            return not (after.isupper() and word.islower())
        return not (unicodedata.category(after)[0] in "LM" and (after.isupper() or _uncased(after)))
    next_at = _next_visible(text, dot + 1, high)
    if next_at >= high:
        return False
    following = text[next_at]
    if following in CLOSING:
        rest = _next_visible(text, next_at + 1, high)
        if rest >= high or following not in ")]）】":
            return False
    if _ends_with(_TITLE, text, start, dot) or _ends_with(_LETTER, text, start, dot):
        return True
    if _ends_with(_TIME, text, start, dot):
        return not following.isupper()
    if _ends_with(_NUMBERED, text, start, dot):
        return following.isdigit()
    word = "".join(c for c in text[start:dot] if c not in INVISIBLE).lstrip("“‘\"'「")
    if len(word) == 1 and word.isalpha() and (word.isupper() or _uncased(word)):
        return True
    if len(word) > 2 and "." in word and all(len(x) == 1 and x.isupper() for x in word.split(".")):
        return not following.isupper()
    return False


def _continues(text: str, line_low: int, high: int, opened: int, sentence_low: int, at: int) -> bool:
    """After a closing mark: whether what follows takes the quotation up.

    Where letters have case it decides. Elsewhere a quotation introduced by a comma or colon is complete, unless
    a quotative follows; one that stands within its clause, or opens it, is taken up.
    """
    i = _next_visible(text, at, high)
    if i >= high:
        return False
    ch = text[i]
    if ch in ",;，、；":
        return True
    if ch.isalpha() and ch.lower() != ch.upper():
        return ch.islower()
    if text.startswith(QUOTATIVE_STARTS, i):
        return True
    stop = i
    while stop < high and not text[stop].isspace() and text[stop] not in END and text[stop] not in ",|":
        stop += 1
    if "".join(c for c in text[i:stop] if c not in INVISIBLE) in QUOTATIVES:
        return True
    if ch in OPEN or ch in "\"'":
        return False
    j = opened - 1
    while j >= sentence_low and (text[j].isspace() or text[j] in INVISIBLE):
        j -= 1
    return j < sentence_low or text[j] not in ",:，：、"


def _marker_kind(marker: str) -> str:
    """The style of a list marker: what counts in it, and its marks."""
    core = marker.strip("().")
    style = "bullet" if not core or core in "-•*–" else "number" if core[0].isdigit() else "letter" if len(core) == 1 else "roman"
    return style + marker.replace(core, "", 1) if style != "bullet" else "bullet" + marker


class _ListLevels:
    """The open levels of a text's lists, a stack of (indent, style) kept from line to line.

    A marker further in, or of another style below an open one on its line, opens a level; one of an open level's style
    closes the levels within it; a line without a marker at the margin closes all.
    """

    def __init__(self):
        self.stack: list[tuple[int, str]] = []
        self.depth = 0  # the deepest level so far

    def enter(self, line: str) -> None:
        if self.stack and line[:1].strip() and _LIST.match(line) is None:
            self.stack.clear()

    def open(self, marker: str, indent: int) -> None:
        level = (indent, _marker_kind(marker))
        while self.stack and self.stack[-1][0] > indent:
            self.stack.pop()
        if self.stack and self.stack[-1][0] == indent and self.stack[-1][1] != level[1] and level in self.stack:
            del self.stack[self.stack.index(level) + 1 :]
        if level not in self.stack:
            self.stack.append(level)
        self.depth = max(self.depth, len(self.stack))


def _line_spans(text: str, low: int, high: int, out: list[int], levels: _ListLevels) -> None:
    """Sentences of one line, appended to ``out`` as start, end, start, end..."""
    line = text[low:high] if low or high < len(text) else text
    events = [(m.start(), m.group()) for m in _EVENT.finditer(line)]
    n = len(line)
    begin = 0
    skip_to = 0
    levels.enter(line)
    while (m := _LIST.match(line, skip_to)) is not None:
        levels.open(m.group().strip(), m.end() - len(m.group().lstrip()))
        skip_to = m.end()  # a list marker opens a level, its dot ends nothing; the next marker on the line opens one below
    if events:
        pairs = _matched(line, events) if any(ch in OPEN or ch in BRACKET or ch in "\"'" for _, ch in events) else {}
        stack: list[int] = []  # where the open levels close
        token = _Token()
        quoted_end = -1  # place after a terminator that closed inside the current outermost quotation
        outer = -1
        for i, ch in events:
            if i < skip_to:
                continue
            if i in pairs:
                if not stack:
                    outer = i
                stack.append(pairs[i])
                quoted_end = -1
                continue
            if stack and i == stack[-1]:
                stack.pop()
                if not stack and quoted_end >= 0 and line[outer] not in BRACKET:
                    j = i + 1
                    while j < n and line[j] in CLOSING and j not in pairs:
                        j += 1
                    follows = _next_visible(line, j, n)
                    if follows < n and (line[follows] in END or line[follows] == "|"):
                        continue
                    if not _continues(line, 0, n, outer, begin, j):
                        _emit(line, begin, j, low, out)
                        begin = skip_to = j
                continue
            if ch in END or ch == "|":
                if stack:
                    j = i + 1
                    while j < n and (line[j] in END or line[j] in INVISIBLE):
                        j += 1
                    if j == stack[-1] or (j < n and line[j] in CLOSING):
                        quoted_end = i
                    skip_to = j
                    continue
                if ch == "|":
                    j = i - 1
                    while j >= 0 and (line[j].isspace() or line[j] in INVISIBLE or line[j] in ")]"):
                        j -= 1
                    if j < 0 or not "ऀ" <= line[j] <= "෿":
                        continue
                j = i + 1
                while j < n and (line[j] in END or (ch == "|" and line[j] == "|")):
                    j += 1
                run = line[i:j]
                if run == ".":
                    if _dot_is_plain(line, begin, n, i, token):
                        continue
                elif set(run) <= {".", "…"}:
                    k = _next_visible(line, j, n)
                    if k < n and (_cased_lower(line[k]) or line[k].isdigit() or line[k] in ",;"):
                        skip_to = j
                        continue
                while j < n and line[j] in CLOSING and j not in pairs:
                    j += 1
                _emit(line, begin, j, low, out)
                begin = skip_to = j
            elif ch[0].isspace() and not stack:
                a, b = i - 1, i + len(ch)
                while a >= 0 and line[a] in INVISIBLE:
                    a -= 1
                while b < n and line[b] in INVISIBLE:
                    b += 1
                if a < 0 or b >= n or line[a].isdigit() or line[b].isdigit():
                    continue
                if "฀" <= line[a] <= "๿" or "฀" <= line[b] <= "๿":
                    _emit(line, begin, i, low, out)
                    begin = i
    _emit(line, begin, n, low, out)


def _emit(line: str, begin: int, end: int, low: int, out: list[int]) -> None:
    part = line[begin:end]
    left = len(part) - len(part.lstrip())
    stripped = part.strip()
    if stripped:
        out.append(low + begin + left)
        out.append(low + begin + left + len(stripped))


def sentence_spans(text: str | None) -> list[int]:
    """Start and end of every sentence, one after the other, in code points.

    Null, empty and blank texts have none. Work grows with the number of marks, not with the square of
    anything, so very long texts are fine.
    """
    out: list[int] = []
    if text:
        levels = _ListLevels()
        for m in _LINES.finditer(text):
            _line_spans(text, m.start(), m.end(), out, levels)
    return out


def _spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int32())
    for batch in batches:
        spans = [sentence_spans(t) for t in batch.column("__text").to_pylist()]
        sizes = np.cumsum([0, *map(len, spans)], dtype=np.int32)
        flat = pa.array([x for s in spans for x in s], type=pa.int32())
        columns = [batch.column(k) for k in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(sizes), flat).cast(kind)], names=[*batch.schema.names[:-1], "__spans"])


def sentences(df: DataFrame, key: str, text: str, delivered: str | None = None) -> DataFrame:
    """One row per sentence: (key, start_char, end_char), code points from 0, end exclusive.

    Only offsets travel: texts never enter a shuffle. With ``delivered`` a key counts once, as delivered
    last (rows with a null key can't be known as copies and all count, but for equal ones); without it every row counts. Null, empty and blank
    texts give no rows.
    """
    kept = [F.col(key).alias("__key"), *([F.col(delivered).alias("__at")] if delivered else []), F.col(text).alias("__text")]
    source = df.select(*kept)
    fields = [f"__key {dict(df.dtypes)[key]}", *([f"__at {dict(df.dtypes)[delivered]}"] if delivered else []), "__spans array<int>"]
    spans = source.mapInArrow(_spans_of, ", ".join(fields))
    if delivered:
        own = F.when(F.col("__key").isNull(), F.xxhash64("__at", "__spans"))  # rows without a key can't be known as copies
        spans = spans.groupBy("__key", own).agg(F.max(F.struct("__at", "__spans")).alias("m")).select("__key", F.col("m.__spans").alias("__spans"))
    place = F.explode(F.sequence(F.lit(1), F.size("__spans"), F.lit(2)))
    return (
        spans.where(F.size("__spans") > 0)
        .select("__key", "__spans", place.alias("p"))
        .select(F.col("__key").alias(key), F.get("__spans", F.col("p") - 1).alias("start_char"), F.get("__spans", F.col("p")).alias("end_char"))
    )
