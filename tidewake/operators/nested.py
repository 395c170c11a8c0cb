"""Deeply nested JSON records into related flat tables.

A hand-driven, non-recursive event parser turns every record into path-value-ordinal
triples. Triples are grouped by their repeated ancestor and every group is pivoted into
one row that carries the link to its parent's row: ``nested_rows`` takes array elements
as ancestors, for any record; ``shaped_rows`` the objects that have the fields of a
``Shape``, at whatever depth they are. All triples of a record are made in one task, so
grouping a record needs no shuffle, and one parse serves all tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.session import Stage

_SPACE = re.compile(r"[ \t\n\r]*").match
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?").match
_WORDS = {"t": ("true", "bool"), "f": ("false", "bool"), "n": ("null", "null"), "N": ("NaN", "float"), "I": ("Infinity", "float")}

#: A step of a path: an object's key, or the ordinal of an array's element.
Path = tuple
#: (path, type, text): type is one of str int float bool null object array.
Triple = tuple[Path, str, str | None]


class BadJson(ValueError):
    """The text is not JSON."""


def _past_space(text: str, pos: int) -> int:
    """Most exports have no blanks between tokens, so they are only looked for where one is."""
    return _SPACE(text, pos).end() if text[pos : pos + 1] <= " " else pos


def parse_triples(text: str, keep: frozenset | None = None) -> list[Triple]:
    """The triples of one JSON text in document order; ``BadJson`` if it is none.

    Containers give a triple of their own (type ``object`` or ``array``), so that
    an empty list differs from a missing one. Accepts what Python's ``json`` does
    (including ``NaN`` and ``Infinity``) at any depth: nothing recurses. If an
    object repeats a key, the last value counts and the earlier one's triples go. With
    ``keep`` only triples whose path ends in one of these keys are made.
    """
    out: list[Triple | None] = []
    path: list = []
    # per open container: [is_object, next ordinal, {key: (first, past last) triple}, key, first triple of the key]
    stack: list[list] = []
    pos, end = _past_space(text, 0), len(text)
    want_value = True
    while True:
        if want_value:
            if pos >= end:
                raise BadJson("value expected")
            ch = text[pos]
            if ch == '"':
                try:
                    value, pos = scanstring(text, pos + 1, True)
                except ValueError as e:
                    raise BadJson(str(e)) from None
                if keep is None or path and path[-1] in keep:
                    out.append((tuple(path), "str", value))
            elif ch == "{" or ch == "[":
                is_object = ch == "{"
                if keep is None or path and path[-1] in keep:
                    out.append((tuple(path), "object" if is_object else "array", None))
                pos = _past_space(text, pos + 1)
                closing = "}" if is_object else "]"
                if text[pos : pos + 1] == closing:
                    pos += 1
                else:
                    stack.append([is_object, 0, {}, None, 0])
                    if is_object:
                        pos = _key(text, pos, path, stack[-1], len(out))
                    else:
                        path.append(0)
                    continue
            elif m := _NUMBER(text, pos):
                if keep is None or path and path[-1] in keep:
                    out.append((tuple(path), "float" if m[1] or m[2] else "int", m[0]))
                pos = m.end()
            else:
                minus = ch == "-"
                word, kind = _WORDS.get(text[pos + minus : pos + minus + 1], ("", ""))
                if not word or not text.startswith(word, pos + minus) or minus and word != "Infinity":
                    raise BadJson("value expected")
                if keep is None or path and path[-1] in keep:
                    out.append((tuple(path), kind, None if kind == "null" else "-" * minus + word))
                pos += minus + len(word)
        if pos < end and text[pos] <= " ":
            pos = _SPACE(text, pos).end()
        if not stack:
            if pos != end:
                raise BadJson("extra text")
            return [t for t in out if t is not None]
        top = stack[-1]
        ch = text[pos : pos + 1]
        if top[0] and ch in (",", "}"):
            span = top[2].get(top[3])
            if span:
                out[span[0] : span[1]] = [None] * (span[1] - span[0])
            top[2][top[3]] = (top[4], len(out))
        if ch == ",":
            pos = _past_space(text, pos + 1)
            path.pop()
            if top[0]:
                pos = _key(text, pos, path, top, len(out))
            else:
                top[1] += 1
                path.append(top[1])
            want_value = True
        elif ch == ("}" if top[0] else "]"):
            pos += 1
            path.pop()
            stack.pop()
            want_value = False
        else:
            raise BadJson("delimiter expected")


def _key(text: str, pos: int, path: list, top: list, first: int) -> int:
    if text[pos : pos + 1] != '"':
        raise BadJson("key expected")
    try:
        key, pos = scanstring(text, pos + 1, True)
    except ValueError as e:
        raise BadJson(str(e)) from None
    pos = _past_space(text, pos)
    if text[pos : pos + 1] != ":":
        raise BadJson("colon expected")
    path.append(key)
    top[3], top[4] = key, first
    return _past_space(text, pos + 1)


# ---------------------------------------------------------------- generic tables


def _split(path: Path) -> tuple[str, list[int], str]:
    """A path as (path of its repeated ancestor with [] for ordinals, ordinals, rest)."""
    last = max((i for i, step in enumerate(path) if isinstance(step, int)), default=-1)
    steps = [("[]" if isinstance(s, int) else _escape(s)) for s in path]
    return "$" + "".join(f".{s}" if s != "[]" else s for s in steps[: last + 1]), [s for s in path if isinstance(s, int)], ".".join(steps[last + 1 :])


def _escape(key: str) -> str:
    return re.sub(r"[.\[\]\\$]", lambda m: "\\" + m[0], key)


def nested_rows(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``(<id>, group_path, ordinals, parent_ordinals, fields)``, one row per repeated ancestor.

    ``group_path`` is the path of the ancestor (``$`` for the record itself, ``$.a.b[]`` for
    elements of that array), ``ordinals`` the 0-based positions that lead to it (its key
    within the record and group), ``parent_ordinals`` those of the enclosing group's row
    (null at the top) and ``fields`` the values by the rest of their paths, as text; null
    values and containers are null. An element that is an object or a list has no value of
    its own. Null, empty and unparsable texts give no rows.
    """
    id_type = df.schema[id_col].dataType
    pairs = pa.map_(pa.string(), pa.string())
    schema = T.StructType(
        [T.StructField(id_col, id_type), T.StructField("group_path", T.StringType()), T.StructField("ordinals", T.ArrayType(T.IntegerType())), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(4)]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                groups: dict[tuple, dict[str, str | None]] = {}
                for path, kind, value in _parsed(text):
                    group, ordinals, field = _split(path)
                    row = groups.setdefault((group, tuple(ordinals)), {})
                    if field or kind not in ("object", "array"):
                        row[field or "value"] = value
                for (group, ordinals), row in groups.items():
                    for c, x in zip(cols, (rid, group, list(ordinals), list(row.items()))):
                        c.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pairs)], [id_col, "group_path", "ordinals", "fields"]
            )

    parent = F.when(F.size("ordinals") > 0, F.slice("ordinals", 1, F.size("ordinals") - 1))
    return df.select(id_col, json_col).mapInArrow(run, schema).select(id_col, "group_path", "ordinals", parent.alias("parent_ordinals"), "fields")


def _parsed(text: str | None, keep: frozenset | None = None) -> list[Triple]:
    if not text:
        return []
    try:
        return parse_triples(text, keep)
    except BadJson:
        return []


def flat_tables(df: DataFrame, id_col: str, json_col: str) -> dict[str, DataFrame]:
    """One flat table per repeated ancestor: ``{group_path: table}``, from one parse.

    Columns: the record id, ``ordinals`` (row key within the record and group),
    ``parent_ordinals`` (row key of the enclosing group's row; null at the top) and one
    string column per leaf path (``value`` for elements that are values). The set of groups and fields is a schema, read
    once by a distinct over the rows; values never reach the driver.
    """
    rows = Stage(df.sparkSession).cut(nested_rows(df, id_col, json_col))
    names = rows.select("group_path", F.explode_outer(F.map_keys("fields")).alias("field")).distinct()
    fields: dict[str, list[str]] = {}
    for group, field in sorted(map(tuple, names.collect()), key=lambda x: (x[0], x[1] or "")):
        fields.setdefault(group, []).extend([field] if field is not None else [])
    return {
        group: rows.where(F.col("group_path") == group).select(id_col, "ordinals", "parent_ordinals", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in leaves])
        for group, leaves in fields.items()
    }


# ---------------------------------------------------------------- objects of a shape


@dataclass(frozen=True)
class Shape:
    """What makes an object a row: ``fields`` it must all have, each at the first of some relative
    paths where a filled value of the kinds allowed is, and lists of ``items``, of which
    the first that is a list counts, each with its elements' field."""

    fields: dict[str, tuple[Path, ...]]
    kinds: dict[str, tuple[str, ...]]
    items: tuple[tuple[Path, str], ...]

    def ends(self) -> tuple[dict, dict]:
        """By the last key of a path, the relative paths (and what they fill) that may end there: of fields and lists, and of elements."""
        own: dict[str, list] = {}
        for name, paths in self.fields.items():
            for i, path in enumerate(paths):
                own.setdefault(path[-1], []).append((path, (name, i)))
        inside: dict[str, list] = {}
        for i, (path, field) in enumerate(self.items):
            own.setdefault(path[-1], []).append((path, ("items", i)))
            inside.setdefault(field, []).append((path, i))
        return own, inside


_AUTHOR = ("core", "user_results", "result")
#: A post: an author's handle, an id, and tags.
POST = Shape(
    fields={"author_handle": ((*_AUTHOR, "core", "screen_name"), (*_AUTHOR, "legacy", "screen_name")), "post_id": (("rest_id",), ("legacy", "id_str"))},
    kinds={"author_handle": ("str",), "post_id": ("str", "int", "float")},
    items=((("note_tweet", "note_tweet_results", "result", "entity_set", "hashtags"), "text"), (("legacy", "entities", "hashtags"), "text")),
)


def shaped(triples: list[Triple], shape: Shape, ends: tuple[dict, dict] | None = None) -> list[tuple[dict[str, str], Path | None, Path, list[str]]]:
    """(fields, path of the nearest enclosing one or None, own path, items) of every object of the
    shape among a record's triples.

    Triples are grouped by the object they would be a field of; each group is pivoted into the
    shape's fields; groups that have all of them are rows, linked to the nearest enclosing one.
    """
    own, inside = ends or shape.ends()
    groups: dict[Path, dict] = {}
    for path, kind, value in triples:
        if not path:
            continue
        last = path[-1]
        for rel, i in inside.get(last, ()):
            n = len(rel) + 2
            if len(path) >= n and path[-n:-2] == rel and isinstance(path[-2], int) and kind == "str" and value:
                groups.setdefault(path[:-n], {}).setdefault(("inside", i), []).append((path[-2], value))
        for rel, what in own.get(last, ()):
            n = len(rel)
            if path[-n:] == rel:
                groups.setdefault(path[:-n], {})[what] = (kind, value)
    kept: dict[Path, tuple] = {}
    for path, got in sorted(groups.items(), key=lambda x: len(x[0])):
        fields = {}
        for name, paths in shape.fields.items():
            cells = (got.get((name, i), ("", None)) for i in range(len(paths)))
            fields[name] = next((v for k, v in cells if k in shape.kinds[name] and v and (k == "str" or v != "0")), None)
        if any(v is None for v in fields.values()):
            continue
        listed = next((i for i in range(len(shape.items)) if got.get(("items", i), ("",))[0] == "array"), None)
        items = [t for _, t in sorted(got.get(("inside", listed), ()), key=lambda x: x[0])]
        above = next((path[:i] for i in range(len(path) - 1, -1, -1) if path[:i] in kept), None)
        kept[path] = (fields, above, path, items)
    return list(kept.values())


def shaped_rows(df: DataFrame, id_col: str, json_col: str, shape: Shape, key: str, item: str) -> DataFrame:
    """``(<id>, <fields>, parent_<key>, pos, <item>)``: objects of a shape at any depth.

    One row per item with its 0-based position among the kept ones, or one row with -1
    and ''; ``parent_<key>`` is the nearest enclosing object's ``key``, '' at the top. Null,
    empty and unparsable texts give nothing; repeated rows give repeated results.
    """
    names = list(shape.fields)
    ends = shape.ends()
    keep = frozenset((*ends[0], *ends[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(len(names) + 4)]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shaped(_parsed(text, keep), shape, ends)
                keys = {path: fields[key] for fields, _, path, _ in found}
                for fields, above, _, items in found:
                    for pos, value in enumerate(items) if items else ((-1, ""),):
                        for c, x in zip(cols, (rid, *fields.values(), "" if above is None else keys[above], pos, value)):
                            c.append(x)
            types = [batch.schema.field(0).type, *[pa.string()] * (len(names) + 1), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [id_col, *names, f"parent_{key}", "pos", item])

    text = [T.StructField(n, T.StringType()) for n in (*names, f"parent_{key}")]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *text, T.StructField("pos", T.IntegerType()), T.StructField(item, T.StringType())])
    return df.select(id_col, json_col).mapInArrow(run, schema)
