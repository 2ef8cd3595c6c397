"""Deeply nested records as flat tables: bodies are shredded into an adjacency table, which is pivoted into entity tables."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.session import checkpointed, spread_shuffled

#: What lies under each kind of object: label of the list -> (kind of its members, sign in the path). Infons are a map under every kind.
BIOC = {
    "collection": {"documents": ("document", "d")},
    "document": {"passages": ("passage", "p"), "relations": ("relation", "r")},
    "passage": {"sentences": ("sentence", "s"), "annotations": ("annotation", "a"), "relations": ("relation", "r")},
    "sentence": {"annotations": ("annotation", "a"), "relations": ("relation", "r")},
    "annotation": {"locations": ("location", "l")},
    "relation": {"nodes": ("node", "n")},
}
MAP_LABEL = "infons"
#: Scalar columns of the entity tables.
FIELDS = {
    "document": ["id"],
    "passage": ["offset", "text"],
    "sentence": ["offset", "text"],
    "annotation": ["id", "text"],
    "location": ["offset", "length"],
    "relation": ["id"],
    "node": ["refid", "role"],
}
ADJACENCY = "rec_id bigint, node string, parent string, entity string, label string, ordinal int, is_object boolean, scalar string"
_blank = re.compile(r"[ \t\n\r]*")
_number = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?")
_words = {"true": True, "false": False, "null": None, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
_word = re.compile("|".join(_words))


def parse_deep(text: str):
    """The value of a JSON text nested to any depth: open lists and objects lie on a stack of their own. Texts that are no JSON raise ValueError."""
    open_: list[tuple[list | dict, str | None]] = []  # with the key that the next value goes to
    at, value, done = _blank.match(text).end(), None, False
    while True:
        c = text[at : at + 1]
        if not done:
            if c in ("{", "["):
                open_.append(({} if c == "{" else [], None))
                at = _blank.match(text, at + 1).end()
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    value, done, at = open_.pop()[0], True, at + 1
                elif c == "{":
                    at = _key(text, at, open_)
            elif c == '"':
                value, at = scanstring(text, at + 1)
                done = True
            elif m := _word.match(text, at):
                value, done, at = _words[m.group()], True, m.end()
            elif m := _number.match(text, at):
                whole, part, power = m.groups()
                value, done, at = float(m.group()) if part or power else int(whole), True, m.end()
            else:
                raise ValueError(f"no value at {at}")
            continue
        at = _blank.match(text, at).end()
        if not open_:
            if at < len(text):
                raise ValueError(f"more text at {at}")
            return value
        holder, key = open_[-1]
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)
        c = text[at : at + 1]
        if c == ("}" if isinstance(holder, dict) else "]"):
            value, at = open_.pop()[0], at + 1
        elif c == ",":
            at, done = _blank.match(text, at + 1).end(), False
            if isinstance(holder, dict):
                at = _key(text, at, open_)
        else:
            raise ValueError(f"no comma at {at}")


def _key(text: str, at: int, open_: list) -> int:
    """Reads the key of an object at ``at``, and returns where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1)
    at = _blank.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    open_[-1] = (open_[-1][0], key)
    return _blank.match(text, at + 1).end()


def dump_deep(value) -> str:
    """``value`` as JSON with sorted keys, nested to any depth."""
    out, todo = [], [(value, "")]
    while todo:
        x, text = todo.pop()
        out.append(text)
        if x is _NOTHING:
            continue
        if isinstance(x, (dict, list)):
            pairs = sorted(x.items()) if isinstance(x, dict) else [(None, y) for y in x]
            first, last = "{}" if isinstance(x, dict) else "[]"
            todo.append((_NOTHING, last))
            for i in range(len(pairs) - 1, -1, -1):
                k, y = pairs[i]
                todo.append((y, (", " if i else "") + ("" if k is None else json.dumps(k, ensure_ascii=False) + ": ")))
            todo.append((_NOTHING, first))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


_NOTHING = object()


def parse_body(body: str | None):
    """The object that ``body`` holds as JSON, also behind a byte order mark or encoded as a JSON string any number of times; None if there is none."""
    value = body
    while isinstance(value, str):
        text = value.lstrip("\ufeff").strip()
        try:
            try:
                value = json.loads(text)
            except RecursionError:
                value = parse_deep(text)
        except ValueError:
            return None
    return value if isinstance(value, dict) else None


def root_of(value: dict) -> tuple[str, dict] | None:
    """('collection' or 'document', object): the outermost object with documents or, else, passages, also inside outer objects."""
    level = [value]
    while level:
        for x in level:
            if "documents" in x:
                return "collection", x
        for x in level:
            if "passages" in x:
                return "document", x
        level = [y for x in level for k, y in x.items() if isinstance(y, dict) and k != MAP_LABEL]
    return None


def _clean(s: str) -> str:
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in s) else s


def _scalar(x) -> str | None:
    if x is None:
        return None
    if isinstance(x, str):
        return _clean(x)
    try:
        return _clean(json.dumps(x, ensure_ascii=False, sort_keys=True))
    except RecursionError:
        return _clean(dump_deep(x))


def walk(body: str | None, shape: dict = BIOC) -> Iterator[tuple]:
    """Adjacency rows (node, parent, entity, label, ordinal, is_object, scalar) of a body, parents before children.

    An object row names its own entity, a scalar row that of its parent; a map entry is a row of entity 'infon'. One
    object in place of a list is a list of one; members that are no objects keep their place but give no row. Nested
    values under labels that ``shape`` doesn't know are kept as JSON text.
    """
    found = root_of(value) if (value := parse_body(body)) is not None else None
    if found is None:
        return
    entity, top = found
    stack = [("d0" if entity == "document" else "", "", entity, "", 0, top)]
    while stack:
        path, parent, entity, label, ordinal, obj = stack.pop()
        yield path, parent, entity, label, ordinal, True, None
        lists, below = shape.get(entity, {}), []
        for key, x in obj.items():
            if key in lists:
                kind, sign = lists[key]
                for i, member in enumerate([x] if isinstance(x, dict) else x if isinstance(x, list) else ()):
                    if isinstance(member, dict):
                        below.append((f"{path}/{sign}{i}" if path else f"{sign}{i}", path, kind, key, i, member))
            elif key == MAP_LABEL and isinstance(x, dict):
                for i, (k, v) in enumerate(x.items()):
                    yield f"{path}/i:{_clean(k)}", path, "infon", _clean(k), i, False, _scalar(v)
            elif x is not None:
                yield None, path, entity, _clean(key), 0, False, _scalar(x)
        stack.extend(reversed(below))


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in ADJACENCY.split(", ")]
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)
    for batch in batches:
        rows: list[tuple] = []
        for rec_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for row in walk(body):
                rows.append((rec_id, *row))
                if len(rows) >= 20_000:
                    yield flush(rows)
                    rows = []
        if rows:
            yield flush(rows)


def adjacency(raw: DataFrame, key: str = "rec_id", body: str = "body") -> DataFrame:
    """The adjacency table of all bodies of ``raw``: one row per object, map entry and scalar, each with its parent's path.

    Per key one body counts, the smallest of repeated ones. Null keys, null or empty bodies and bodies that hold no whole
    object give no rows. Other columns of ``raw`` are not read, whatever their names.
    """
    known = raw.where(F.col(key).isNotNull() & (F.length(body) > 1))
    one = known.groupBy(F.col(key).cast("long").alias("rec_id")).agg(F.min(body).alias("body"))
    return spread_shuffled(one, known).mapInArrow(_shred, ADJACENCY)


def entity_table(adjacent: DataFrame, entity: str, fields: list[str] | None = None) -> DataFrame:
    """Flat table of one kind of object: (rec_id, path, parent_path, ordinal, its scalar fields).

    Object rows and the scalar rows of their children meet in one aggregation by (rec_id, path), which pivots labels
    into columns.
    """
    of = F.when(F.col("is_object"), F.col("node")).otherwise(F.col("parent"))
    return (
        adjacent.where(F.col("entity") == entity)
        .groupBy("rec_id", of.alias("path"))
        .agg(
            F.max(F.when(F.col("is_object"), F.col("parent"))).alias("parent_path"),
            F.max(F.when(F.col("is_object"), F.col("ordinal"))).alias("ordinal"),
            *[F.max(F.when(~F.col("is_object") & (F.col("label") == f), F.col("scalar"))).alias(f) for f in (FIELDS[entity] if fields is None else fields)],
        )
    )


def infon_table(adjacent: DataFrame) -> DataFrame:
    """Flat table of the map entries: (rec_id, parent_path, path, infon_key, infon_value); null values are kept."""
    return adjacent.where(F.col("entity") == "infon").select("rec_id", F.col("parent").alias("parent_path"), F.col("node").alias("path"), F.col("label").alias("infon_key"), F.col("scalar").alias("infon_value"))


def links(adjacent: DataFrame, entities: list[str], infons_of: str | None = None) -> DataFrame:
    """(rec_id, parent_path, child_path) of the objects of some kinds and of the map entries under another.

    Object rows meet the rows of their scalar children and map entries in one aggregation by (rec_id, path), the same
    join and pivot that makes the entity tables; an object without its row gives none of its children.
    """
    sign = {k: s for lists in BIOC.values() for k, s in lists.values()}.get(infons_of)
    entry = F.col("entity") == "infon"
    wanted = F.col("entity").isin([*entities, *([infons_of] if infons_of else [])])
    if infons_of is not None:
        wanted = wanted | (entry & F.col("parent").rlike(f"(^|/){sign}[0-9]+$"))
    rows = adjacent.where(wanted & (F.col("is_object") | entry)).groupBy("rec_id", F.when(F.col("is_object"), F.col("node")).otherwise(F.col("parent")).alias("path"))
    pivoted = rows.agg(
        F.max(F.when(F.col("is_object"), F.col("entity"))).alias("entity"),
        F.max(F.when(F.col("is_object"), F.col("parent"))).alias("parent_path"),
        F.collect_set(F.when(entry, F.col("node"))).alias("entries"),
    )
    own = F.when(F.col("entity").isin(entities), F.array(F.struct("parent_path", F.col("path").alias("child_path")))).otherwise(F.array())
    below = F.when(F.col("entity").isNotNull(), F.transform("entries", lambda e: F.struct(F.col("path").alias("parent_path"), e.alias("child_path")))).otherwise(F.array())
    return pivoted.select("rec_id", F.explode(F.concat(own, below)).alias("x")).select("rec_id", "x.*")


def flat_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """All entity tables of ``raw`` and 'infon', each row with the key of its parent. The adjacency table is checkpointed, so that bodies are parsed once for all."""
    adjacent = checkpointed(adjacency(raw))
    return {e: entity_table(adjacent, e) for e in FIELDS} | {"infon": infon_table(adjacent)}
