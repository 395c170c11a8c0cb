"""One consistent form for text that looks the same but differs in its characters.

DuckDB runs inside the Arrow partitions: an embedded SQL expression of
``nfc_normalize``, ``translate`` and regular expressions maps compatibility forms
(width, ligatures, presentation forms), blanks, invisible characters and letters of
other scripts that look like Latin ones, and non-breaking and other hyphens. Letter case, accents and plain ASCII
characters stay apart.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that look like a Latin letter or a hyphen, by script, each before what it looks like.
LOOK_ALIKES = {
    "greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ αa ιi κk νv οo ρp υu χx γy ϲc ϳj",
    "cyrillic": "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԚQ ԜW ҮY ӀI ѴV аa еe кk оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw үy ӏl ѵv",
    "armenian": "ՕO ՍU ՏS ԼL օo սu հh զq ցg յj",
    "latin": "ɑa ɡg ᴄc ᴏo ᴠv ᴡw ᴢz ꜱs",
    "cherokee": "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏒR ᏔW ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB",
    "lisu": "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU",
    "coptic": "ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX ⲟo ⲣp ⲥc",
    "others": "ჿo ዐO 𐐄O 𐐬o 𐑈s",
    "hyphens": "‐- ‑- −-",
}
# Kinds of decomposition that keep the look (Unicode data file).
KEPT_FORMS = ("<noBreak>", "<wide>", "<narrow>", "<compat>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>")
# Characters that show nothing, besides the format characters (category Cf).
INVISIBLE = "034F 115F 1160 17B4 17B5 180B-180F 3164 FE00-FE0F FFA0 E0100-E01EF 0000-0008 000E-001F 007F-009F"
# Blanks, besides the space separators (category Zs).
BLANKS = "0009 2028 2029 2800"


@cache
def _alike() -> dict[int, str]:
    return {ord(pair[0]): pair[1] for script in LOOK_ALIKES.values() for pair in script.split()}


def _ranges(spec: str) -> list[int]:
    out: list[int] = []
    for part in spec.split():
        first, _, last = part.partition("-")
        out.extend(range(int(first, 16), int(last or first, 16) + 1))
    return out


@cache
def _classes() -> tuple[frozenset[int], frozenset[int]]:
    """(invisible, blank) code points."""
    planes = range(0xE0200)
    blank = {c for c in planes if unicodedata.category(chr(c)) == "Zs"} | set(_ranges(BLANKS))
    hidden = ({c for c in planes if unicodedata.category(chr(c)) == "Cf"} | set(_ranges(INVISIBLE))) - blank
    return frozenset(hidden), frozenset(blank)


def _compatible(ch: str) -> str:
    """Full decomposition by canonical and look-keeping steps only; a listed look-alike stands for
    what it looks like before that."""
    if ord(ch) in _alike():
        return _alike()[ord(ch)]
    how = unicodedata.decomposition(ch)
    if not how:
        return ch
    tag, *codes = how.split() if how[0] == "<" else ("", *how.split())
    if tag and (tag not in KEPT_FORMS or codes[0] == "0020"):
        return ch
    return "".join(_compatible(chr(int(c, 16))) for c in codes)


@cache
def replacements() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """By rule, every character whose look is another's: (letters of other scripts,
    other single characters, characters that become several)."""
    hidden, blank = _classes()
    alike = _alike()
    letters: dict[str, str] = {}
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        if code in hidden or code in blank:
            continue
        ch = chr(code)
        parts = _compatible(ch)
        if parts == ch:
            continue
        to = unicodedata.normalize("NFC", parts)
        if to == ch or to == unicodedata.normalize("NFC", ch):
            continue
        if len(to) > 1:
            several[ch] = to
        elif parts[0] != ch and not unicodedata.decomposition(ch).startswith("<") or code in alike:
            letters[ch] = to
        else:
            single[ch] = to
    return letters, single, several


def _class(codes: Iterator[int]) -> str:
    """A regular-expression class of code points, as ranges."""
    spans: list[list[int]] = []
    for c in sorted(codes):
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in spans) + "]"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@cache
def _look_relation(distinct: str) -> str:
    """Over a relation with a column ``value``: the relation ``(v, look)``, step by step."""
    hidden, blank = _classes()
    letters, single, several = replacements()

    def when(part: dict[str, str], change: str) -> str:
        return f"CASE WHEN regexp_matches(x, {_text(_class(map(ord, part)))}) THEN {change} ELSE x END"

    pairs = ", ".join(f"{_text(a)}: {_text(b)}" for a, b in several.items())
    steps = [
        f"regexp_replace(x, {_text(_class(hidden))}, '', 'g')",
        f"regexp_replace(x, {_text(_class(blank))}, ' ', 'g')",
        when(several, f"array_to_string(list_transform(string_split(x, ''), lambda c: coalesce(element_at(MAP {{{pairs}}}, c)[1], c)), '')"),
        when(single, f"translate(x, {_text(''.join(single))}, {_text(''.join(single.values()))})"),
        when(letters, f"translate(x, {_text(''.join(letters))}, {_text(''.join(letters.values()))})"),
        "nfc_normalize(x)",
    ]
    out = f"SELECT value AS v, value AS x FROM {distinct}"
    for step in steps:
        out = f"SELECT v, {step} AS x FROM ({out})"
    return f"SELECT v, x AS look FROM ({out})"


def look_query(source: str, keep: str) -> str:
    """SQL over a relation with a column ``value``: ``keep`` with ``look`` at hand.

    A value that repeats is brought to its form once; values of plain ASCII without
    control characters are their own form.
    """
    plain = r"'^[\x20-\x7E]*$'"
    return f"""
    WITH src AS MATERIALIZED ({source}),
    odd AS (SELECT DISTINCT value FROM src WHERE NOT regexp_full_match(value, {plain})),
    forms AS ({_look_relation('odd')})
    SELECT {keep} FROM (SELECT src.*, coalesce(forms.look, src.value) AS look FROM src LEFT JOIN forms ON src.value = forms.v)"""


def run_sql(sql: str, names: list[str], schema: T.StructType):
    """An Arrow map that runs ``sql`` in DuckDB over each batch, seen as ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]).rename_columns(names))
                table = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from table.to_batches()

    return lambda df: df.mapInArrow(run, schema)


def consistent_text(df: DataFrame, columns: list[str], suffix: str = "_look") -> DataFrame:
    """``df`` with ``<column><suffix>`` for each of the string columns.

    Null stays null, '' stays ''; a text of invisible characters only becomes ''.
    Texts are processed whole, rows keep their number and their other columns,
    whose names may be any but those added (``ValueError``).
    """
    added = [c + suffix for c in columns]
    if clash := set(added) & set(df.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    rename = [f"c{i}" for i in range(len(df.columns))]
    out = "SELECT * FROM batch"
    for i, c in enumerate(columns):
        source = f"SELECT *, {rename[df.columns.index(c)]} AS value FROM ({out})"
        out = look_query(source, f"* EXCLUDE (value, look), look AS l{i}")
    schema = T.StructType([*df.schema.fields, *[T.StructField(a, T.StringType()) for a in added]])
    names = ", ".join([*rename, *[f"l{i}" for i in range(len(columns))]])
    titles = ", ".join(f'{n} AS "{f.name.replace(chr(34), chr(34) * 2)}"' for n, f in zip(names.split(", "), schema.fields))
    return run_sql(f"SELECT {titles} FROM ({out})", rename, schema)(df)


KEYS = T.StructType(
    [
        T.StructField("field_name", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("raw_key", T.BinaryType()),
        T.StructField("look_key", T.BinaryType()),
    ]
)


def look_keys(df: DataFrame, id_col: str, texts: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """``(field_name, id, pos, raw_key, look_key)``, one row per value of the columns.

    The keys are 128-bit digests of the value and of its consistent form, so that
    later steps compare and move 16 bytes instead of texts. ``id`` is the id as text.
    Null values and null elements give no row; positions in lists start at 0.
    """
    names = ["id", *[f"t{i}" for i in range(len(texts))], *[f"a{i}" for i in range(len(lists))]]
    parts = [f"SELECT {_text(c)} AS field_name, id, 0 AS pos, t{i} AS value FROM batch WHERE t{i} IS NOT NULL" for i, c in enumerate(texts)]
    parts += [
        f"SELECT * FROM (SELECT {_text(c)} AS field_name, id, unnest(range(len(a{i})))::INT AS pos, unnest(a{i}) AS value FROM batch) WHERE value IS NOT NULL"
        for i, c in enumerate(lists)
    ]
    keep = "field_name, id, pos::INT AS pos, unhex(md5(value)) AS raw_key, unhex(md5(look)) AS look_key"
    rows = df.select(F.col(id_col).cast("string").alias("id"), *texts, *lists)
    return run_sql(look_query(" UNION ALL ".join(parts), keep), names, KEYS)(rows)


def look_alikes(keys: DataFrame) -> DataFrame:
    """``(field_name, id, pos, look_ref)`` of the values of one column that look like,
    but differ from, the value of the lowest id (as a number) with the same look.

    Repeated values are one row before anything is compared, so a value that fills
    a third of the table moves once per task.
    """
    number = F.col("id").cast("bigint")
    variants = keys.groupBy("look_key", "raw_key").agg(F.min(number).alias("first"))
    refs = variants.groupBy("look_key").agg(F.min_by("raw_key", "first").alias("ref_key"), F.min("first").alias("ref"), F.count(F.lit(1)).alias("n")).where("n > 1")
    odd = variants.join(refs, "look_key").where("raw_key <> ref_key").select("raw_key", F.col("ref").cast("string").alias("look_ref"))
    return keys.join(odd, "raw_key").select("field_name", "id", "pos", "look_ref")


def look_like(keys: DataFrame, reference: DataFrame) -> DataFrame:
    """``(field_name, id, pos, look_ref)`` of values that look like, but differ from, a
    reference value; ``look_ref`` is the reference's id, one row for each."""
    ref = reference.select("look_key", F.col("raw_key").alias("ref_key"), F.col("id").alias("look_ref")).distinct()
    return keys.join(ref, "look_key").where("raw_key <> ref_key").select("field_name", "id", "pos", "look_ref")
