"""Chat formatting: records of any known layout to canonical turns, turns to template text.

**Fingerprints.** The nested field paths of a record (``messages[].content``; the
names only, in sorted order) are hashed.  The hash selects a declarative ``Layout``:
a fingerprint is compared with the declared layouts once, later records with it use
the layout found.  Tables have one fingerprint, that of their schema, and are
converted by column expressions; JSON texts have one each.

**Template.** A turn becomes ``open role \\n text close``.  Markers in roles and texts
are escaped by one escape sign behind their first character, and runs of such signs
there grow by one, so a marker never stands in a text and escaping is undone exactly.
The text of a trained role is under the loss mask.

Turns are formatted one by one.  One shuffle brings the turns of a conversation
together in order, and they then pass as a stream: a task holds a batch, not a
conversation, whatever the conversation's length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrays import output_schema

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Layout:
    """How records of one shape become turns.

    ``turns``: (role, path) of each turn in order; several paths joined by ``+`` are
    one turn, parts that are missing or empty left out, with an empty line between.
    ``each``: path of the list of turns, or "" if the record is one turn; ``role`` and
    ``text`` are fields of its items, ``order`` the field that numbers a record's turns.
    A record fits if it has all paths named here but the ``optional`` ones."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: str | None = None
    role: str = "role"
    text: str = "content"
    order: str | None = None
    optional: frozenset[str] = frozenset()

    def required(self) -> set[str]:
        if self.each is None:
            paths = {p for _, at in self.turns for p in at.split("+")}
        else:
            at = f"{self.each}[]." if self.each else ""
            paths = {at + self.role, at + self.text} | ({self.order} if self.order else set())
        return paths - self.optional


#: declared layouts; the first that fits is taken
LAYOUTS = (
    Layout("messages", each="messages"),
    Layout("conversations", each="conversations", role="from", text="value"),
    Layout("conversation", each="conversation"),
    Layout("dialog", each="dialog", role="speaker", text="text"),
    Layout("table of turns", each="", text="text", order="turn"),
    Layout("instruction", turns=(("system", "system"), ("user", "instruction+input"), ("assistant", "output")), optional=frozenset({"system", "input"})),
    Layout("instruction, response", turns=(("system", "system"), ("user", "instruction+context"), ("assistant", "response")), optional=frozenset({"system", "context"})),
    Layout("preference", turns=(("system", "system"), ("user", "prompt"), ("assistant", "chosen")), optional=frozenset({"system"})),
    Layout("prompt, completion", turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=frozenset({"system"})),
    Layout("prompt, response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=frozenset({"system"})),
    Layout("question, answer", turns=(("system", "system"), ("user", "context+question"), ("assistant", "answer")), optional=frozenset({"system", "context"})),
)


def json_paths(value: object) -> set[str]:
    """Nested field paths of a parsed JSON value; items of a list share ``[]``."""
    out: set[str] = set()
    left = [("", value)]
    while left:
        at, v = left.pop()
        if isinstance(v, dict):
            for name, inner in v.items():
                path = f"{at}.{name}" if at else name
                out.add(path)
                left.append((path, inner))
        elif isinstance(v, list):
            left.extend((f"{at}[]", inner) for inner in v)
    return out


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a schema."""
    if isinstance(kind, T.StructType):
        own = {f"{at}.{f.name}" if at else f.name: f.dataType for f in kind.fields}
        return set(own).union(*[schema_paths(k, p) for p, k in own.items()])
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else set()


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(json.dumps(p) for p in paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


class Mappings:
    """Layouts by fingerprint.  Only so many fingerprints are remembered; others are looked up again."""

    REMEMBERED = 10_000

    def __init__(self, layouts: tuple[Layout, ...]):
        self.layouts, self.known = layouts, {}

    def of(self, paths: set[str]) -> tuple[str, Layout | None]:
        mark = fingerprint(paths)
        if mark not in self.known:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            self.known[mark] = next((x for x in self.layouts if x.required() <= paths), None)
        return mark, self.known[mark]


def _string(value: object) -> str:
    """Text of a JSON value; lists of content parts are their texts, other values their JSON.
    Halves of surrogate pairs, which are no characters, become the replacement character."""
    if isinstance(value, list) and all(isinstance(v, dict) and "text" in v for v in value):
        return "".join(_string(v["text"]) for v in value)
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def record_turns(layout: Layout, record: dict, roles: dict[str, str]) -> list[tuple[int, str, str]]:
    """(order, role, text) of each turn of one record."""
    if layout.each is None:
        out = []
        for role, at in layout.turns:
            parts = [_string(record.get(p)) for p in at.split("+")]
            if any(parts) or not set(at.split("+")) <= layout.optional:
                out.append((len(out), role, "\n\n".join(filter(None, parts))))
        return out
    items = record.get(layout.each) if layout.each else [record]
    out = []
    for i, item in enumerate(items if isinstance(items, list) else []):
        if isinstance(item, dict):
            role = _string(item.get(layout.role))
            order = item.get(layout.order) if layout.order else i
            out.append((order if isinstance(order, int) and abs(order) < 2**63 else i, roles.get(role, role), _string(item.get(layout.text))))
    return out


def turns_of_json(records: DataFrame, key: str, body: str, layouts: tuple[Layout, ...] = LAYOUTS, roles: dict[str, str] = ROLES) -> tuple[DataFrame, DataFrame]:
    """(turns, unread): ``key``, turn, role, text of the records in the JSON texts of
    ``body``, and ``key``, reason, fingerprint of those that no layout fits.

    Records may differ from row to row.  Null and empty texts, text that is no JSON
    object, or nested beyond what the parser takes, are unread, never an error.  Role
    names are mapped by ``roles``.  Numbers and objects in place of a text are their
    JSON.  Repeated records give their turns each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Mappings(layouts)
        for batch in batches:
            at, turn, role, text, reason, mark = [], [], [], [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    record = json.loads(raw) if raw else None
                except (ValueError, RecursionError):
                    record = None
                if not isinstance(record, dict):
                    found, why, print_ = [], "no object", None
                else:
                    print_, layout = known.of(json_paths(record))
                    found, why = (record_turns(layout, record, roles), None) if layout else ([], "unknown layout")
                for t, r, x in found or ([(None, None, None)] if why else []):
                    at.append(i), turn.append(t), role.append(r), text.append(x), reason.append(why), mark.append(print_)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(turn, pa.int64()), *(pa.array(c, pa.string()) for c in (role, text, reason, mark))]
            yield pa.RecordBatch.from_arrays(columns, [key, "turn", "role", "text", "reason", "fingerprint"])

    # a key and a body that are one column still need two names
    found = records.select(F.col(f"`{key}`"), F.col(f"`{body}`").alias("_body")).mapInArrow(run, output_schema(records, [key], "turn long, role string, text string, reason string, fingerprint string"))
    return found.where("reason is null").select(key, "turn", "role", "text"), found.where("reason is not null").select(key, "reason", "fingerprint")


def turns_of_table(records: DataFrame, key: str, layouts: tuple[Layout, ...] = LAYOUTS, roles: dict[str, str] = ROLES) -> DataFrame:
    """``key``, turn, role, text of the records of a typed table, by the layout that the
    fingerprint of its schema selects; an error if there is none.

    Null texts and roles are empty.  Columns that the layout does not name play no part."""
    _, layout = Mappings(layouts).of(schema_paths(records.schema))
    if layout is None:
        raise ValueError(f"no layout for the fields {sorted(schema_paths(records.schema))}")
    k = F.col(f"`{key}`").alias(key)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    named = lambda c: _renamed(text(c), roles)
    if layout.each is None:
        have = schema_paths(records.schema)
        turns = []
        for role, at in layout.turns:
            parts = [text(F.col(f"`{p}`")) for p in at.split("+") if p in have]
            if parts:
                whole = F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n\n")
                one = F.struct(F.lit(role).alias("role"), whole.alias("text"))
                turns.append(F.when(whole != "", one) if set(at.split("+")) <= layout.optional else one)
        items = F.filter(F.array(*turns), lambda t: t.isNotNull())
        return records.select(k, F.posexplode(items).alias("turn", "_t")).select(key, F.col("turn").cast("long").alias("turn"), "_t.role", "_t.text")
    if layout.each:
        rows = records.select(k, F.posexplode(f"`{layout.each}`").alias("turn", "_t"))
        return rows.where("_t is not null").select(key, F.col("turn").cast("long").alias("turn"), named(F.col(f"_t.`{layout.role}`")).alias("role"), text(F.col(f"_t.`{layout.text}`")).alias("text"))
    order = F.col(f"`{layout.order}`").cast("long") if layout.order else F.lit(0).cast("long")
    return records.select(k, order.alias("turn"), named(F.col(f"`{layout.role}`")).alias("role"), text(F.col(f"`{layout.text}`")).alias("text"))


def _renamed(role: Column, roles: dict[str, str]) -> Column:
    names = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair]) if roles else None
    return role if names is None else F.coalesce(F.try_element_at(names, role), role)


@dataclass(frozen=True)
class Template:
    """Markers round turns of trained and of other roles.  Every marker, and every other
    control string, begins with one of the characters that nowhere else occur in them."""

    trained: tuple[str, str] = ("<s>", "</s>")
    other: tuple[str, str] = ("[INST]", "[/INST]")
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<unk>", "<pad>")
    roles: frozenset[str] = field(default_factory=lambda: frozenset({"assistant"}))
    sign: str = "\\"

    def __post_init__(self):
        first = {c[0] for c in self.controls}
        inner = {x for c in self.controls for x in c[1:]}
        if first & inner or self.sign in first | inner or "\n" in first | inner or not {*self.trained, *self.other} <= set(self.controls) or self.trained[0] == self.other[0] or min(map(len, self.controls)) < 2:
            raise ValueError("control strings must be told apart by their first characters, which occur nowhere else in them")

    @property
    def pattern(self) -> str:
        """A control string, with any number of escape signs behind its first character."""
        first = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rest = "|".join(re.escape(r) for r in sorted({c[1:] for c in self.controls}))
        return f"([{first}])({re.escape(self.sign)}*)({rest})"

    def escape(self, text: Column) -> Column:
        sign = self.sign.replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(text, F.lit(self.pattern), F.lit("$1$2" + sign + "$3"))

    def piece(self, role: Column, text: Column) -> Column:
        """One turn in the template; line ends in a role are escaped as well."""
        trained = role.isin(sorted(self.roles))
        header = F.replace(F.replace(role, F.lit(self.sign), F.lit(self.sign * 2)), F.lit("\n"), F.lit(self.sign + "n"))
        begin, end = (F.when(trained, t).otherwise(o) for t, o in zip(self.trained, self.other, strict=True))
        return F.concat(begin, self.escape(header), F.lit("\n"), self.escape(text), end)

    def unescape(self, text: str) -> str:
        return re.sub(self.pattern, lambda m: m[1] + m[2][len(self.sign) :] + m[3], text)

    def turns(self, formatted: str) -> Iterator[tuple[str, str, bool, int]]:
        """(role, text, trained, place of the escaped text) of each turn in formatted text."""
        at = 0
        for begin, body, end in re.findall(f"({re.escape(self.trained[0])}|{re.escape(self.other[0])})(.*?)({re.escape(self.trained[1])}|{re.escape(self.other[1])})", formatted, re.S):
            header, _, text = body.partition("\n")
            role = re.sub(re.escape(self.sign) + "(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(header), flags=re.S)
            yield role, self.unescape(text), begin == self.trained[0], at + len(begin) + len(header) + 1
            at += len(begin) + len(body) + len(end)


TEMPLATE = Template()


def format_turns(turns: DataFrame, key: str, template: Template = TEMPLATE) -> DataFrame:
    """``key``, turn, piece, start, loss_start, loss_end: formatted turns in the order of
    turn, role and text; a conversation's text is its pieces in a row.

    ``start`` is the piece's place in the conversation's text, loss_start and loss_end
    are that of the text under the loss mask, null where nothing is (code points).  Null
    roles and texts are empty; a null key is a conversation of its own; equal numbers go
    by role and text; repeated rows count each; an empty table gives no row.  Rows of a
    partition keep their order, so what reads them on without a shuffle has it."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = turns.select(F.col(f"`{key}`"), "turn", role.alias("role"), text.alias("text"))
    rows = own.repartition(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`"), "turn", "role", "text")
    masked = F.when(F.col("role").isin(sorted(template.roles)), F.char_length(template.escape(F.col("text"))))
    rows = rows.select(F.col(f"`{key}`"), "turn", template.piece(F.col("role"), F.col("text")).alias("piece"), masked.alias("masked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            first = _first_of_key(batch.column(0), last)
            size = pc.utf8_length(batch.column("piece")).to_numpy(zero_copy_only=False).astype(np.int64)
            start = at + np.cumsum(size) - size
            begun = np.flatnonzero(first)
            start[begun[0] if begun.size else len(start) :] -= np.repeat(start[begun], np.diff(np.r_[begun, len(start)]))
            last, at = batch.column(0)[-1:], int(start[-1] + size[-1])
            masked = batch.column("masked")
            on = masked.is_valid()
            begin = np.where(on.to_numpy(zero_copy_only=False), start + size - masked.fill_null(0).to_numpy(zero_copy_only=False) - len(template.trained[1]), 0)
            end = begin + masked.fill_null(0).to_numpy(zero_copy_only=False)
            off = ~on.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("turn"), batch.column("piece"), pa.array(start), pa.array(begin, pa.int64(), mask=off), pa.array(end, pa.int64(), mask=off)], [key, "turn", "piece", "start", "loss_start", "loss_end"])

    return rows.mapInArrow(run, output_schema(turns, [key], "turn long, piece string, start long, loss_start long, loss_end long"))


def _first_of_key(keys: pa.Array, last: pa.Array | None) -> np.ndarray:
    """Which rows begin another key than the row before; ``last`` holds the key of the row before all."""
    n = len(keys)
    both = pa.concat_arrays([keys[:1] if last is None else last, keys])
    same = pc.equal(both[:-1], both[1:]).fill_null(False).to_numpy(zero_copy_only=False)
    null = both.is_null().to_numpy(zero_copy_only=False)
    first = ~(same | (null[:-1] & null[1:]))
    if last is None and n:
        first[0] = True
    return first


def read_back(formatted: DataFrame, key: str, template: Template = TEMPLATE) -> DataFrame:
    """``key``, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each
    conversation, read from the pieces and loss spans that ``format_turns`` made.

    ``turns_sha256`` is of role, line end, text and line end of every turn;
    ``loss_sha256`` and ``loss_chars`` are of the unescaped text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, rows = None, None, []

        def done() -> list:
            return [held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]]

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, first = [], _first_of_key(batch.column(0), last)
            spans = zip(*(batch.column(c).to_pylist() for c in ("piece", "start", "loss_start", "loss_end")), strict=True)
            for i, (piece, start, begin, end) in enumerate(spans):
                if first[i]:
                    if held is not None:
                        rows.append(done())
                        keys.append(batch.column(0)[i - 1 : i] if i else last)
                    held = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in template.turns(piece):
                    held[0] += 1
                    held[1].update(f"{role}\n{text}\n".encode())
                if begin is not None:
                    loss = template.unescape(piece[begin - start : end - start])
                    held[2] += len(loss)
                    held[3].update(loss.encode())
                held[4] += len(piece)
            last = batch.column(0)[-1:]
            if rows:
                yield table(pa.concat_arrays(keys), rows)
                rows = []
        if held is not None:
            yield table(last, [done()])

    def table(keys: pa.Array, rows: list) -> pa.RecordBatch:
        n, turns, chars, loss, size = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(turns), pa.array(chars, pa.int64()), pa.array(loss), pa.array(size, pa.int64())], [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, output_schema(formatted, [key], "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


def documents(formatted: DataFrame, key: str) -> DataFrame:
    """``key``, formatted, loss_spans: whole texts of conversations that fit one value, for
    training files.  Longer ones stay in pieces, as ``format_turns`` gives them."""
    one = F.struct("start", "piece", F.struct("loss_start", "loss_end").alias("span"))
    held = formatted.groupBy(F.col(f"`{key}`")).agg(F.array_sort(F.collect_list(one)).alias("_p"))
    spans = F.filter(F.transform("_p", lambda p: p["span"]), lambda s: s["loss_start"].isNotNull())
    return held.select(F.col(f"`{key}`"), F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"))
