"""Deeply nested JSON records to flat, related tables.

Each payload is read as a stream of tokens that gives (path, ordinals, value) triples, without a tree of the record being
built; the triples of a repeated ancestor are grouped and pivoted into one row of that ancestor's table. Ordinals are the
keys that tie a child to its parent. `flatten_any` takes records of any shape as they stand; `flatten_records` knows where
the levels of an extraction may be found, where levels that are missing, null, empty or given as a lone object need no
special table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.session import cut

TRIPLES = "key bigint, path string, c int, e int, n int, seq int, value string"
#: Values of triples that announce an object or a list.
OBJECT, LIST = "{", "["

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|"([^"\\]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\]*)*)"|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity))')
_OPENS = re.compile(r"[\[{]|<think>")
#: A bracket followed like this begins a record, not a remark.
_RECORD = re.compile(r'\{\s*"|\[\s*(\{|\]|$)|\{\s*$')
#: What may stand behind a record that is all there is.
_REST = re.compile(r"[\s`]*$")


@dataclass(frozen=True)
class Shape:
    """Where the levels of a record may be found. A lone object in place of a list counts as a list of one."""

    chunks: str = "chunks"
    events: str = "events"
    wrapper: str = "result"
    entities: str = "entities"
    slots: tuple[str, ...] = ("subject", "object")
    text_key: str = "text"
    chunk_fields: tuple[str, ...] = ("title", "text", "status", "prompt_type")
    event_fields: tuple[str, ...] = ("relation",)
    entity_fields: tuple[str, ...] = ("name", "attribute")
    deep_field: str = "definition"
    record_keys: frozenset = field(default_factory=lambda: frozenset({"chunks", "events", "result", "title", "text", "run", "status", "error"}))


class Broken(ValueError):
    """A record that is cut off or no JSON; `opened` has the places of the brackets that are not closed."""

    def __init__(self, opened: list[int]):
        super().__init__("not JSON")
        self.opened = opened


def _string(body: str) -> str:
    return json.loads(f'"{body}"', strict=False) if "\\" in body else body


class Path:
    """A path as a chain of keys, with None for an element of a list: a step costs the same however deep it is."""

    __slots__ = ("above", "key", "below", "place")

    def __init__(self, above: Path | None = None, key: str | None = None):
        self.above, self.key, self.below, self.place = above, key, {}, None

    def step(self, key: str | None) -> Path:
        found = self.below.get(key)
        if found is None:
            found = self.below[key] = Path(self, key)
        return found

    def keys(self) -> tuple:
        out, at = [], self
        while at.above is not None:
            out.append(at.key)
            at = at.above
        return tuple(reversed(out))


def ordinals_of(chain: tuple | None) -> list[int]:
    """The numbers of a chain (chain before, number)."""
    out = []
    while chain is not None:
        chain, i = chain
        out.append(i)
    return out[::-1]


def read_triples(text: str, at: int = 0) -> tuple[list[tuple], int]:
    """The triples (path, ordinals, kind, value) of the JSON value at a place, in document order, and where it ends.

    A path is a tuple of keys, with None for an element of a list, whose number is the next of the ordinals. kind is
    OBJECT or LIST, which announce what may be empty, or string, other (numbers and truth values, as written) or null.
    """
    out, end = _read(text, at)
    return [(path.keys(), ordinals_of(chain), kind, value) for path, chain, kind, value in out], end


def _read(text: str, at: int) -> tuple[list[tuple[Path, tuple | None, str, str | None]], int]:
    """As read_triples, with paths and ordinals as chains."""
    out: list[tuple] = []
    token, stack = _TOKEN.match, []  # of [place, path, ordinals, next element or None for an object]
    path, chain = Path(), None
    while True:
        # a value stands here
        m = token(text, at)
        if not m:
            raise Broken([f[0] for f in stack])
        at, mark = m.end(), m[1]
        if mark is None:
            body = m[2]
            if body is not None:
                out.append((path, chain, "string", _string(body)))
            else:
                out.append((path, chain, "null", None) if m[3] == "null" else (path, chain, "other", m[3]))
        elif mark == "{" or mark == "[":
            out.append((path, chain, mark, None))
            stack.append([m.end() - 1, path, chain, None if mark == "{" else 0])
            after = token(text, at)
            if after and after[1] == ("}" if mark == "{" else "]"):
                stack.pop()
                at = after.end()
            elif mark == "[":
                path, chain = path.step(None), (chain, 0)
                continue
            else:
                path, at = _key(text, at, stack)
                continue
        else:
            raise Broken([f[0] for f in stack])
        # what stands behind a value closes lists and objects, or leads on to the next value
        while stack:
            top = stack[-1]
            m = token(text, at)
            mark = m[1] if m else None
            if mark == ",":
                if top[3] is None:
                    path, at = _key(text, m.end(), stack)
                    chain = top[2]
                else:
                    top[3] += 1
                    path, chain, at = top[1].step(None), (top[2], top[3]), m.end()
                break
            if mark != ("}" if top[3] is None else "]"):
                raise Broken([f[0] for f in stack])
            at = m.end()
            stack.pop()
        else:
            return out, at


def _key(text: str, at: int, stack: list) -> tuple[Path, int]:
    m = _TOKEN.match(text, at)
    colon = _TOKEN.match(text, m.end()) if m and m[2] is not None else None
    if not colon or colon[1] != ":":
        raise Broken([f[0] for f in stack])
    return stack[-1][1].step(_string(m[2])), colon.end()


def decode(payload: str | None, shape: Shape = Shape()) -> list[tuple] | None:
    """The triples of the record inside a payload, with paths and ordinals as chains, or None.

    Thought blocks, fences, a byte order mark and prose around the JSON are passed over; what stands in the record's own
    strings is left as it is. Brackets in prose are told from the record by what follows them. A record that is cut off or
    broken gives None: its inner objects are not taken for records.
    """
    if not payload:
        return None
    at, dead = 0, set()
    while m := _OPENS.search(payload, at):
        start = m.start()
        if m[0] == "<think>":
            end = payload.find("</think>", m.end())
            at = m.end() if end < 0 else end + 8
            continue
        if start in dead:
            at = start + 1
            continue
        try:
            out, end = _read(payload, start)
        except Broken as broken:
            # the brackets inside that are open too would break off at the same place
            if any(_RECORD.match(payload, p) for p in (broken.opened or [start])):
                return None
            dead.update(broken.opened)
            at = start + 1
            continue
        root = out[0][0]
        if _REST.match(payload, end) or shape.record_keys & (root.below.keys() | root.step(None).below.keys()):
            return out
        at = end
    return None


@dataclass(frozen=True)
class Place:
    """Where a path lies: a level's own row (no field) or a field of it. `lists` are the places, among the path's ordinals,
    of chunk, event and entity, -1 for a lone object. `inside` are nested texts of the deep field."""

    level: str
    field: str = ""
    lists: tuple[int, ...] = (-1, -1, -1)
    passed: int = 0
    many: bool = False
    wrapped: bool = False
    slot: int = -1
    open_list: bool = True
    wrapper: bool = False


def _step(at: Place | None, key: str | None, shape: Shape) -> Place | None:
    """Where the path goes with one more key; None is nowhere. `open_list`: an element of a list would be the level's row."""
    if at is None:
        return None
    if at.field:
        inside = at.level == "entity" and at.field == shape.deep_field and (key is None or key == shape.text_key)
        return replace(at, passed=at.passed + (key is None)) if inside else None
    if key is None:
        if not at.open_list:
            return None
        k = ("chunk", "event", "entity").index(at.level)
        return replace(at, lists=(*at.lists[:k], at.passed, *at.lists[k + 1 :]), passed=at.passed + 1, open_list=False)
    if at.wrapper:
        return replace(at, level="event", wrapper=False, wrapped=True, open_list=True) if key == shape.events else None
    if at.level == "chunk":
        if key == shape.chunks and at.open_list and not at.many:
            return replace(at, many=True)
        if key == shape.events:
            return replace(at, level="event", open_list=True)
        if key == shape.wrapper:
            return replace(at, wrapper=True, open_list=False)
        return replace(at, field=key) if key in shape.chunk_fields else None
    if at.level == "event":
        if key == shape.entities:
            return replace(at, level="entity", open_list=True)
        if key in shape.slots:
            return replace(at, level="entity", slot=shape.slots.index(key), open_list=False)
        return replace(at, field=key) if key in shape.event_fields else None
    return replace(at, field=key) if key in shape.entity_fields or key == shape.deep_field else None


def triples(read: list[tuple] | None, shape: Shape = Shape()) -> Iterator[tuple]:
    """(path, chunk, event, entity, seq, value) of everything the tables hold, in document order, from read_triples.

    A level's own row is announced by a triple with an empty field name, so that an object without usable fields still
    has a row. Ordinals count every element, usable or not. Events of a chunk go before those of its wrapper, and a list
    of entities before the slots of the old form, unless it is empty.
    """
    if not read:
        return
    root = read[0][0]
    root.place = Place("chunk")
    many = read[0][2] == OBJECT and shape.chunks in root.below
    own_events, own_entities, kept = set(), set(), []
    for seq, (path, chain, kind, value) in enumerate(read):
        # what is above a path came before it
        if path is not root and path.place is None:
            path.place = _step(path.above.place or None, path.key, shape) or False
        place = path.place
        if not place or place.many != many or place.wrapper:
            continue
        ordinals = ordinals_of(chain)
        c, e, n = (0 if x < 0 else ordinals[x] for x in place.lists)
        if not place.field and (kind == OBJECT or path.key is None):
            if place.level == "event" and not place.wrapped:
                own_events.add(c)
            elif place.level == "entity" and place.slot < 0:
                own_entities.add((c, e, place.wrapped))
        slot = None if place.slot < 0 else place.slot
        kept.append((place.level, place.field, c, e, n if slot is None else slot, place.wrapped, slot, kind, value, seq))
    objects = {(level, c, e, n, wrapped, slot is None) for level, name, c, e, n, wrapped, slot, kind, _, _ in kept if not name and kind == OBJECT}
    for level, name, c, e, n, wrapped, slot, kind, value, seq in kept:
        if level != "chunk" and wrapped and c in own_events or slot is not None and (c, e, wrapped) in own_entities:
            continue
        if (level, c, e, n, wrapped, slot is None) not in objects or not name and kind != OBJECT:
            continue
        if not name:
            yield f"{level}.", c, None if level == "chunk" else e, n if level == "entity" else None, 0, None
        elif name == shape.deep_field and level == "entity":
            if kind == "string" and value.strip():
                yield f"entity.{name}", c, e, n, seq, value
        elif kind in ("string", "other"):
            yield f"{level}.{name}", c, None if level == "chunk" else e, n if level == "entity" else None, 0, value


def to_triples(df: DataFrame, key: str, payload: str, shape: Shape = Shape(), levels: tuple[str, ...] = ("chunk", "event", "entity")) -> DataFrame:
    """One row for each triple of each payload; `levels` limits the tables that are wanted.

    Null, blank and undecodable payloads give no rows, as do rows with a null key. One payload is held at a time.
    """
    prefixes = tuple(f"{x}." for x in levels)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, p in zip(batch["key"], batch["payload"]):
                if p is not None:
                    rows.extend((k, *t) for t in triples(decode(p, shape), shape) if t[0].startswith(prefixes))
                if len(rows) > 50_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    source = df.select(F.col(key).cast("bigint").alias("key"), F.col(payload).cast("string").alias("payload"))
    return source.where("key is not null and payload is not null").mapInPandas(parse, TRIPLES)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "path", "c", "e", "n", "seq", "value"], dtype=object)
    return out.astype({"key": "int64", "c": "Int32", "e": "Int32", "n": "Int32", "seq": "Int32"}) if rows else out


def pivot_level(parsed: DataFrame, level: str, key_name: str, shape: Shape = Shape()) -> DataFrame:
    """The table of one level: keys of its parents, its own ordinal, and its fields as columns.

    A group holds the triples of one object only, so its size is bounded by that object.
    """
    keys = {"chunk": ["c"], "event": ["c", "e"], "entity": ["c", "e", "n"]}[level]
    names = {"c": "chunk_no", "e": "event_no", "n": "entity_no"}
    fields = {"chunk": shape.chunk_fields, "event": shape.event_fields, "entity": shape.entity_fields}[level]
    pick = [F.max(F.when(F.col("path") == f"{level}.{f}", F.col("value"))).alias(f) for f in fields]
    if level == "entity":
        pieces = F.collect_list(F.when(F.col("path") == f"entity.{shape.deep_field}", F.struct("seq", "value")))
        texts = F.transform(F.array_sort(pieces), lambda x: x["value"])
        pick.append(F.when(F.size(texts) > 0, F.array_join(texts, "; ")).alias(shape.deep_field))
    grouped = parsed.where(F.col("path").startswith(f"{level}.")).groupBy("key", *keys).agg(*pick)
    return grouped.select(F.col("key").alias(key_name), *(F.col(k).alias(names[k]) for k in keys), *fields, *([shape.deep_field] if level == "entity" else []))


def flatten_level(df: DataFrame, key: str, payload: str, level: str, shape: Shape = Shape()) -> DataFrame:
    """The table of one level only, in one pass over the payloads."""
    return pivot_level(to_triples(df, key, payload, shape, (level,)), level, key, shape)


def flatten_records(df: DataFrame, key: str, payload: str, shape: Shape = Shape()) -> dict[str, DataFrame]:
    """Chunk, event and entity tables of all payloads, which are parsed once: their triples are written to the checkpoint
    folder. (key, chunk_no[, event_no[, entity_no]]) is unique in each, and a child's leading keys are its parent's key."""
    parsed = cut(to_triples(df, key, payload, shape))
    return {lv: pivot_level(parsed, lv, key, shape) for lv in ("chunk", "event", "entity")}


# --- records of any shape ----------------------------------------------------------------------------------------


def path_name(path: tuple) -> str:
    """A path as text: keys joined by dots, `[]` for the elements of a list; keys that hold such signs are quoted."""
    out = ""
    for k in path:
        if k is None:
            out += "[]"
        else:
            out += ("." if out else "") + (k if re.fullmatch(r"[^.\[\]\"]+", k) else json.dumps(k, ensure_ascii=False))
    return out


def any_triples(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, ancestor, field, ordinals, value) of every scalar and object in every payload, whatever the shape.

    ancestor is the path down to the last list element, field what is left of it (empty for the element itself).
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "ancestor", "field", "ordinals", "value"]
        for batch in batches:
            rows = []
            for k, p in zip(batch["key"], batch["payload"]):
                for chained, chain, kind, value in decode(p) or ():
                    path, ordinals = chained.keys(), ordinals_of(chain)
                    last = max((i + 1 for i, x in enumerate(path) if x is None), default=0)
                    if kind in ("string", "other") or path[last:] == ():
                        if kind == LIST and path:
                            continue
                        rows.append((k, path_name(path[:last]), path_name(path[last:]), ordinals, value))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    source = df.select(F.col(key).cast("bigint").alias("key"), F.col(payload).cast("string").alias("payload"))
    return source.where("key is not null and payload is not null").mapInPandas(parse, "key bigint, ancestor string, field string, ordinals array<int>, value string")


def flatten_any(df: DataFrame, key: str, payload: str) -> dict[str, DataFrame]:
    """A table for every repeated ancestor that occurs: key, `ordinals` (their parents' lead), and a column a field.

    Root objects are the table with the empty name. Ancestors and fields are read off the data; they are the schema of the
    records, the only thing that reaches the driver. A key that holds the data itself (a map) should be a list instead.
    """
    parsed = cut(any_triples(df, key, payload))
    fields: dict[str, list[str]] = {}
    for r in parsed.select("ancestor", "field").distinct().orderBy("ancestor", "field").collect():
        fields.setdefault(r["ancestor"], []).extend([r["field"]] if r["field"] else [])

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("field") == name, F.col("value"))).alias(name)

    rows = {a: parsed.where(F.col("ancestor") == a).groupBy("key", "ordinals") for a in fields}
    made = {a: g.agg(F.max(F.when(F.col("field") == "", F.col("value"))).alias("value"), *map(pick, fs)) for (a, fs), g in zip(fields.items(), rows.values())}
    return {a: t.withColumnRenamed("key", key) for a, t in made.items()}
