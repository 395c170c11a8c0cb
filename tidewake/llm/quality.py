"""Per-document text statistics that tell natural prose from lists, tables and junk.

Structure is read from the lines of a block: delimiters that stand in the same number on
consecutive lines (vertical alignment), indentation that repeats with a period, and the
autocorrelation of line lengths. What lines show by these is added to the share of
lines that end nowhere: together they make a block a table or a list. Word, symbol,
punctuation and repetition ratios of every line decide the rest. Each character of a
document is booked as prose or as one kind of non-prose; nothing is cut off.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Delimiters of table cells; a run of blanks is one, too.
DELIMITERS = ("|", "\t", ";", ",", "::", " : ", " ~ ", "/", "   ")
# Vowels of the Latin, Greek and Cyrillic scripts, without accents.
VOWELS = frozenset("aeiouyæœøıαεηιουωаеиоуыэюяіє")

# Scripts whose vowels are listed, and scripts that write words without blanks.
VOWELLED = ("LATIN", "GREEK", "CYRILLIC")
UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "BOPOMOFO", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN")

#: Periodicity from which lines of any length can be records.
PERIODIC = 0.4

_MARKER = re.compile(r"\s*(?:([-*•–—·▪◦‣+#→]+)|(\(?\d{1,4}[.):\]])|(\(?[a-zA-Z][.)])|(\[.?\]|☐|☑|✓|✔))\s+")
_LOG = re.compile(r"\W*(?:\d{4}-\d\d-\d\d[T ]?|\d\d?[/.]\d\d?[/.]\d{2,4}\s|\d\d:\d\d(?::\d\d)?\b|\[?(?:INFO|WARN|ERROR|DEBUG|SKIP)\b)")
_PAIR = re.compile(r"[\w.-]+=[^\s=]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ASCII_WORD = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)*")  # the same for plain ASCII, where it is faster
_REFERENCE = re.compile(r"(?:https?://|www\.)\S+|[#@]\w[\w.]*|\w+@\w[\w.]*")
# Sentence marks of scripts besides the European ones.
OTHER_ENDS = "。！？｡．؟؛۔।॥։՞።፧။"
_SENTENCE_END = re.compile(rf"[.!?…;·{OTHER_ENDS}][»\"”’」』）')*]*\s*$")
_INNER_END = re.compile(rf"[.!?…]['\"”»)*]*\s+[*'\"“«(]*[^\W\d_]|;\s+[A-ZΑ-ΩΆΈΉΊΌΎΏ]|[{OTHER_ENDS}]\s*[^\W\d_]")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_ITEM = re.compile("[,;] ")
_WIDE = re.compile(r"\s{3}")
#: Words of three letters or more without a vowel, or with four letters in a row without one.
_DULL = re.compile(r"(?<!\S)(?:[^\s{0}]{{3,}}(?!\S)|\S*?[^\s{0}]{{4}}\S*)".format("".join(sorted(VOWELS))))
_MOJIBAKE = re.compile(r"[ÂÃÎÏÐÑÅÄ][\x80-\xbf\u0152-\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]")


def _plain(text: str) -> str:
    """Without case and accents."""
    text = text.casefold()
    if text.isascii():
        return text
    text = _ACCENTS.sub("", unicodedata.normalize("NFD", text))
    marks = [c for c in set(text) if unicodedata.combining(c)]
    for c in marks:
        text = text.replace(c, "")
    return text


@lru_cache(maxsize=1 << 16)
def _dull(word: str) -> bool:
    """Whether a word has no vowel where one is due; words repeat, so answers are kept."""
    return _DULL.match(word) is not None


@cache
def _script(c: str) -> str:
    """The script of a letter or mark as its Unicode name begins; '' for anything else. Styled
    and wide letters count as what they stand for."""
    c = unicodedata.normalize("NFKC", c)[:1]
    return unicodedata.name(c, "").partition(" ")[0] if unicodedata.category(c)[0] in "LM" else ""


def _vowelled(word: str) -> bool:
    """Whether the word is written in scripts whose vowels are listed."""
    return word.isascii() or all(_script(c) in ("", "COMBINING", "MODIFIER", *VOWELLED) for c in word)


class _Line:
    __slots__ = ("text", "size", "words", "plain", "letters", "marker", "indent", "ends", "inner", "kind", "cells")

    def __init__(self, text: str) -> None:
        self.size = len(text) + 1
        if text.startswith(">"):  # a quoted line counts as what is quoted
            text = text.lstrip("> ")
        self.text = text
        self.words = (_ASCII_WORD if text.isascii() else _WORD).findall(text)
        self.plain = _plain(" ".join(self.words)).split(" ") if self.words else []
        self.letters = sum(map(len, self.words))
        m = _MARKER.match(text)
        self.marker = next((i for i, g in enumerate(m.groups()) if g is not None), None) if m else None
        if self.marker == 0:
            self.marker = m[1][0]
        self.indent = len(text) - len(text.lstrip())
        self.ends = bool(_SENTENCE_END.search(text))
        self.inner = bool(_INNER_END.search(text))
        self.kind = ""
        self.cells = 0


def _blocks(lines: list[_Line], same) -> Iterator[list[_Line]]:
    """Maximal runs of consecutive lines of which each is ``same`` as the one before."""
    run: list[_Line] = []
    for line in lines:
        if run and not same(run[-1], line):
            yield run
            run = []
        run.append(line)
    if run:
        yield run


def _tables(lines: list[_Line]) -> None:
    """Marks rows whose delimiters align with those of the line above or below."""
    wide = any(map(_WIDE.search, (line.text for line in lines)))
    for d in DELIMITERS:
        if d == "   " and not wide:
            continue
        counts = [line.text.count(d) if d != "   " else len(re.findall(r"\S\s{3,}(?=\S|$)", line.text)) for line in lines]
        least = 3 if d in (",", "/") else 1 if d == "\t" else 2
        for i, line in enumerate(lines):
            n = counts[i]
            if line.kind or n < least:
                continue
            near = [counts[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(lines)]
            if not any(abs(n - m) <= (1 if n > 3 else 0) for m in near):
                continue
            if len(line.words) / (n + 1) <= (6 if d in ("|", "\t", "   ", "::") else 5) and not (d in (",", ";") and _prosy(line, d)):
                line.kind, line.cells = "table", n + 1


def _prosy(line: _Line, d: str) -> bool:
    """Whether a comma or semicolon line reads as a sentence: blanks follow its delimiters."""
    spaced = line.text.count(d + " ")
    return spaced >= 0.7 * line.text.count(d) and (line.ends or line.inner)


def _autocorrelation(values: list[int], lag: int) -> float:
    n = len(values)
    if n <= lag + 1:
        return 0.0
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    if not spread:
        return 1.0
    return sum((values[i] - mean) * (values[i + lag] - mean) for i in range(n - lag)) / spread


def period(values: list[int]) -> float:
    """How strongly a sequence repeats with some period of 2 to 6: 0 to 1.

    The highest autocorrelation over these lags, less what a random sequence of that
    length reaches, and less what the lag before it shows, so that a trend is none. Six
    lines or more that are all alike count 1.
    """
    n = len(values)
    if n < 6:
        return 0.0
    if len(set(values)) == 1:
        return 1.0
    near = [_autocorrelation(values, k) for k in range(1, 7) if n > 2 * k]
    peaks = [r * n / (n - k) - max(before, 0.0) for k, (before, r) in enumerate(zip(near, near[1:]), 2)]
    return min(1.0, max(0.0, max(peaks, default=0.0) - 1.5 / math.sqrt(n)))


def _periodic(run: list[_Line]) -> tuple[float, float]:
    """Periodicity of a block's indentation and of its line lengths."""
    indents = [x.indent for x in run]
    return period(indents) if len(set(indents)) > 1 else 0.0, period([len(x.text) for x in run])


def _verse(run: list[_Line], common: frozenset[str]) -> bool:
    """Lines of a measure: of like length, of several words with many common ones, that begin
    differently."""
    lengths = [len(x.text) for x in run]
    mean = sum(lengths) / len(run)
    even = math.sqrt(sum((n - mean) ** 2 for n in lengths) / len(run)) <= 0.3 * mean
    words = [w for x in run for w in x.plain]
    begins = Counter(x.plain[0] for x in run if x.plain)
    various = len({tuple(x.plain[:2]) for x in run}) >= 0.85 * len(run) and max(begins.values(), default=0) <= 0.5 * len(run)
    opens = sum(n for w, n in begins.items() if w in common) / len(run)
    return even and various and 3.5 <= len(words) / len(run) <= 14 and _function_share(words, common) >= 0.4 and (opens >= 0.4 or sum(x.text.rstrip().endswith(",") for x in run) >= 0.3 * len(run))


def _wrapped(run: list[_Line]) -> bool:
    """Prose broken at a width: lines fill it, break inside sentences and go on in lower case."""
    if len(run) < 2:
        return False
    body = run[:-1]
    width = max(len(x.text) for x in run)
    full = sum(len(x.text) >= 0.75 * width for x in body) / len(body)
    said = sum(x.ends or x.inner for x in run)
    goes_on = sum(x.text.lstrip()[:1].islower() for x in run[1:]) / len(body)
    stops = sum(x.ends or x.inner for x in run) / len(run)
    if stops <= 0.6 and said * 35 >= sum(len(x.words) for x in run):  # sentences over several lines, even a word a line
        return True
    return full >= 0.6 and (goes_on >= 0.4 and stops >= 0.2 or stops >= 0.4)


def _lists(lines: list[_Line], common: frozenset[str]) -> None:
    for run in _blocks(lines, lambda a, b: a.marker is not None and a.marker == b.marker):
        if run[0].marker is None or len(run) < 2:
            continue
        said = sum(x.ends and len(x.words) >= 9 for x in run) / len(run)
        if said < 0.5:
            for x in run:
                x.kind = x.kind or "list"
    # lines without markers: unfinished ones, and the more so if they come in a period; short
    # ones by themselves, any that way
    open_ = lambda x: x.kind in ("", "junk")
    short = lambda x: open_(x) and len(x.text) <= 90
    for fits, least in ((open_, 6), (short, 4)):
        for run in _blocks(lines, lambda a, b: fits(a) and fits(b)):
            if len(run) < least or not fits(run[0]):
                continue
            unfinished = sum(not x.ends and not x.inner for x in run) / len(run)
            indented, measured = _periodic(run)
            if fits is open_ and max(indented, measured) < PERIODIC or _verse(run, common):
                continue
            if indented < PERIODIC and _wrapped(run):  # wrapped prose isn't indented in a period
                continue
            if unfinished + max(indented, measured) >= 0.7:
                for x in run:
                    x.kind = x.kind or "list"


def _function_share(plain: list[str], common: frozenset[str]) -> float:
    """Share of words that are common ones or, as in any language, very short."""
    return sum(len(w) <= 3 or w in common for w in plain) / len(plain) if plain else 0.0


def _junk(line: _Line, common: frozenset[str]) -> str:
    text = line.text
    n = max(1, len(text.strip()))
    if _LOG.match(text) and not line.ends or "=" in text and len(_PAIR.findall(text)) >= 2:
        return "log"
    if "#" in text or "@" in text or "://" in text or "www." in text:
        if sum(len(m) for m in _REFERENCE.findall(text)) / n > 0.5:
            return "list"
    items = text.count(", ") + text.count("; ")
    if items >= 6 and not line.inner and len(line.words) / (items + 1) <= 7.5:
        pieces = [len(p.split()) for p in _ITEM.split(text)]
        if len(line.words) / (items + 1) <= 5.5 or sum(p > 9 for p in pieces) <= 0.05 * len(pieces):
            return "list"
    if not text.isascii() and len(_MOJIBAKE.findall(text)) * 2 / n > 0.25:
        return "junk"
    # plain ASCII letters are of a vowelled script with blanks, so the others decide
    scripts = {"LATIN"} if text.isascii() else {_script(c) for c in set(text) if c > "\x7f"}
    # vowel signs of other scripts are marks, no letters
    plain_scripts = scripts <= {"", "COMBINING", "MODIFIER", *VOWELLED}
    marks = 0 if plain_scripts else sum(_script(c) not in ("", "COMBINING", *VOWELLED) and unicodedata.category(c)[0] == "M" for c in text)
    if (line.letters + marks + text.count(" ")) / n < 0.6:
        return "junk"
    spaced = not scripts.intersection(UNSPACED)
    if spaced and n > 40 and sum(len(t) for t in text.split() if len(t) > 40 and not _REFERENCE.match(t)) / n > 0.4:
        return "junk"
    if spaced and line.words and max(map(len, line.words)) > 40 or spaced and line.letters / max(1, len(line.words)) > 18:
        return "junk"
    if len(line.words) >= 4:
        told = line.plain if plain_scripts else [w for w in line.plain if _vowelled(w)]
        if len(told) >= min(4, len(line.plain)) and sum(map(_dull, told)) / len(told) > 0.3:
            return "junk"
    if len(line.words) >= 8 and not line.ends and 15 * sum(map(text.count, ",;:.")) < len(line.words) and _function_share(line.plain, common) < 0.12:
        return "junk"
    return ""


def _repeated_share(text: str, gram: int = 5) -> float:
    """Share of characters that only repeat what the document said before."""
    if len(text) > 60:
        raw = text.encode()
        if len(zlib.compress(raw, 6)) / len(raw) < 0.12:
            return 1.0
    names = text.split()
    if len(names) <= gram:
        return 0.0
    grams = list(zip(*(names[k:] for k in range(gram))))
    if len(set(grams)) == len(grams):
        return 0.0
    seen: set[tuple[str, ...]] = set()
    again: set[int] = set()
    for i, g in enumerate(grams):
        if g in seen:
            again.update(range(i, i + gram))
        seen.add(g)
    return sum(len(names[i]) + 1 for i in again) / len(text)


def text_statistics(text: str | None, common: frozenset[str]) -> dict[str, float]:
    """All statistics of one text; an empty or missing text is all zeros."""
    text = text or ""
    out = dict.fromkeys(COLUMNS, 0.0)
    lines = [_Line(t) for t in text.split("\n") if t.strip()]
    if not lines:
        return out
    words = [w for x in lines for w in x.words]
    plain = [w for x in lines for w in x.plain]
    n = len(text)
    _tables(lines)
    for line in lines:
        line.kind = line.kind or _junk(line, common)
    # lines that are said three times or more, unless they are single words
    times = Counter(x.text.strip() for x in lines)
    for x in lines:
        if not x.kind and times[x.text.strip()] >= 3 and (len(x.words) != 1 or x.size > 20):
            x.kind = "junk"
    _lists(lines, common)
    total = sum(x.size for x in lines)
    by_kind = Counter()
    for x in lines:
        by_kind[x.kind] += x.size
    repeated = _repeated_share(text)
    characters = Counter(text)
    lengths = [len(x.text) for x in lines]
    indents = [x.indent for x in lines]
    prose = by_kind[""] / total
    not_prose = max(1 - prose, repeated, min(1.0, (1 - prose) + repeated * prose))
    out |= {
        "words": len(words),
        "mean_word_length": sum(map(len, words)) / max(1, len(words)),
        "symbol_ratio": sum(k for c, k in characters.items() if not c.isalnum() and not c.isspace()) / n,
        "digit_ratio": sum(k for c, k in characters.items() if c.isdecimal()) / n,
        "lines": len(lines),
        "punctuated_line_share": sum(x.ends for x in lines) / len(lines),
        "marked_line_share": sum(x.marker is not None for x in lines) / len(lines),
        "common_word_share": sum(map(common.__contains__, plain)) / max(1, len(words)),
        "function_word_share": _function_share(plain, common),
        "delimiter_alignment": sum(x.cells > 0 for x in lines) / len(lines),
        "indent_period": max((_autocorrelation(indents, k) for k in (1, 2, 3, 4)), default=0.0) if len(set(indents)) > 1 else 0.0,
        "line_period": max(_periodic(lines)),
        "line_length_autocorrelation": max(_autocorrelation(lengths, k) for k in (1, 2, 3)),
        "repeated_share": repeated,
        "table_share": by_kind["table"] / total,
        "list_share": by_kind["list"] / total,
        "log_share": by_kind["log"] / total,
        "junk_share": by_kind["junk"] / total,
        "not_prose_share": not_prose,
    }
    return out


COLUMNS = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "lines", "punctuated_line_share", "marked_line_share", "common_word_share",
    "function_word_share", "delimiter_alignment", "indent_period", "line_period", "line_length_autocorrelation", "repeated_share", "table_share", "list_share",
    "log_share", "junk_share", "not_prose_share",
)


def quality(df: DataFrame, id_col: str, text_col: str, common_words: list[str]) -> DataFrame:
    """``(<id>, <statistics>)``, one row per row; see ``COLUMNS``.

    ``not_prose_share`` is the share of characters that are table, list or log rows,
    junk or mere repetition. A null or empty text has zeros throughout. Whole texts
    are read; repeated ids stay repeated.
    """
    common = frozenset(_plain(w) for w in common_words if w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [text_statistics(t, common) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([float(s[c]) for s in stats], pa.float64()) for c in COLUMNS]], [id_col, *COLUMNS])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(c, T.DoubleType()) for c in COLUMNS]])
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
