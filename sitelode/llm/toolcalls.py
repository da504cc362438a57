"""Tool calls of conversations: linked to their results, ordered, validated and serialised.

Calls and results are hash-joined by their conversation and identifier. Where an
identifier repeats within a conversation, the first by its place counts, and
``copies`` says how many there were. Results that come without a conversation
belong to the calls of their identifier in all conversations.
Calls are ordered topologically: level 0 needs no other call, and each call's
level is above those of all calls that it depends on; within a conversation
(level, place, id) is an order in which each call comes after what it needs.
Levels are found round by round over all conversations at once, so that a
conversation of any size is never in one task. Calls on a cycle have no level.

Arguments are checked against the tool's schema, a subset of JSON Schema: type,
enum, required, properties, additionalProperties, items, minimum, maximum,
minLength, maxLength. The serialised form is canonical JSON: sorted keys, no
spaces, no escapes but the necessary ones, whole floats as integers.

Calls without an identifier link to nothing and are kept, each with its own
row; results without one are dropped, as are dependencies on unknown calls and
null ones. Null or malformed arguments are invalid, and malformed is all that
is no JSON in the strict sense: NaN, infinities, repeated keys, lone surrogates,
nesting beyond what can be read. Long arguments are read whole. Calls of one
place are told apart by name, then arguments. A call without a result has status
``no result``. Without calls there are no rows; columns other than those named
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelode.llm.common import materialize

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return isinstance(value, _TYPES[kind])


def errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value, in the schema's order."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the enum")
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in fields:
                out += errors(value[k], fields[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    elif isinstance(value, list) and "items" in schema:
        out += [e for i, v in enumerate(value) for e in errors(v, schema["items"], f"{at}[{i}]")]
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: too long")
    elif _is(value, "number"):
        if value < schema.get("minimum", -math.inf):
            out.append(f"{at}: too small")
        if value > schema.get("maximum", math.inf):
            out.append(f"{at}: too large")
    return out


def canonical(value: object) -> str:
    def plain(v: object) -> object:
        if isinstance(v, float):
            return int(v) if v.is_integer() else v
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def levels(edges: DataFrame) -> DataFrame:
    """call_id, level of all calls of edges (call_id, needs) that are on or above no cycle; level 0 for what needs nothing.
    As many rounds as there are levels."""
    edges = materialize(edges.distinct(), "edges")
    ids = edges.select("call_id").union(edges.select(F.col("needs").alias("call_id"))).distinct()
    done = materialize(ids.join(edges, "call_id", "left_anti").withColumn("level", F.lit(0)), "levels")
    last, left = done, edges
    for level in count(1):
        left = materialize(left.join(last.select(F.col("call_id").alias("needs")), "needs", "left_anti").select("call_id", "needs"), "left")
        # what had edges before this round and has none now
        last = materialize(edges.select("call_id").distinct().join(left, "call_id", "left_anti").join(done, "call_id", "left_anti").withColumn("level", F.lit(level)), "level")
        if last.isEmpty():
            return done
        done = done.unionByName(last)
        if level % 20 == 0:  # a plan of few tables, however many levels there are
            done = materialize(done.coalesce(edges.sparkSession.sparkContext.defaultParallelism), "levels")


def _pairs(items: list[tuple[str, object]]) -> dict:
    out = dict(items)
    if len(out) < len(items):
        raise ValueError("repeated key")
    return out


def _finite(number: str) -> float:
    value = float(number)
    if not math.isfinite(value):
        raise ValueError("no finite number")
    return value


def read_json(raw: str) -> object:
    """A JSON text's value. ValueError for anything that is none: NaN, infinities, numbers too large for a double, repeated
    keys, lone surrogates, and what is nested too deeply to be read."""
    try:
        value = json.loads(raw, object_pairs_hook=_pairs, parse_float=_finite, parse_constant=_finite)
        canonical(value).encode()
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


def _serialise(batches: Iterator[pa.RecordBatch], schemas: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, lines = [], []
        for call_id, name, raw, result in zip(*(b.column(c).to_pylist() for c in ("call_id", "name", "arguments", "result")), strict=True):
            try:
                value = read_json(raw) if raw is not None else None
                bad = ["$: no arguments"] if raw is None else errors(value, schemas[name]) if name in schemas else ["$: unknown tool"]
            except (ValueError, RecursionError):
                value, bad = None, ["$: not JSON"]
            found.append(bad)
            lines.append(canonical({"arguments": value, "id": call_id, "name": name, "result": result}))
        cols = [b.column(c) for c in b.schema.names]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.list_(pa.string())), pa.array(lines, pa.string())], [*b.schema.names, "errors", "json"])


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row per call. calls: conv_id, place, call_id, name, arguments (JSON), needs (array of call ids of the conversation);
    results: call_id, place, content and, where identifiers are unique within a conversation only, conv_id."""
    key = lambda c: F.struct("conv_id", F.col(c).alias("call_id"))  # noqa: E731  # equal also where both have no conversation
    first = F.struct("place", "name", "arguments", "needs")
    named = calls.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(first).alias("c"), F.count("*").alias("copies")).select("call_id", "conv_id", "c.*", "copies")
    nameless = calls.where(F.col("call_id").isNull()).select("call_id", "conv_id", "place", "name", "arguments", "needs", F.lit(1).cast("long").alias("copies"))
    one = materialize(named.withColumn("key", key("call_id")), "calls")
    by = "key" if "conv_id" in results.columns else "call_id"
    answers = results.where(F.col("call_id").isNotNull()).withColumn("key", key("call_id")) if by == "key" else results.where(F.col("call_id").isNotNull())
    answers = answers.groupBy(by).agg(F.min(F.struct("place", "content")).alias("r"), F.count("*").alias("answers"))
    answers = answers.select(by, F.col("r.place").alias("result_place"), F.col("r.content").alias("result"), "answers")
    asked = one.select("key", "conv_id", F.explode("needs").alias("needs")).where(F.col("needs").isNotNull())
    asked = asked.select("key", key("needs").alias("needs"))
    edges = asked.join(one.select(F.col("key").alias("needs")), "needs", "left_semi").select(F.col("key").alias("call_id"), "needs")
    ranked = levels(edges).withColumnRenamed("call_id", "key")
    in_graph = edges.select(F.col("call_id").alias("key"), F.lit(True).alias("has_needs")).distinct()
    rows = one.join(answers, by, "left").join(ranked, "key", "left").join(in_graph, "key", "left").unionByName(nameless, allowMissingColumns=True)
    level = F.when(F.col("level").isNull() & F.col("has_needs").isNull(), 0).otherwise(F.col("level")).alias("level")
    status = F.when(level.isNull(), "cycle").when(F.col("answers").isNull(), "no result").otherwise("ok")
    rows = rows.select("conv_id", "call_id", "place", "name", "arguments", level, "copies", "result_place", "result", status.alias("status"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lambda it: _serialise(it, schemas), f"{kinds}, errors array<string>, json string").withColumn("valid", F.size("errors") == 0)


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call has, in their conversation if they name one."""
    same = F.col("r.call_id") == F.col("c.call_id")
    own = [c for c in ("conv_id", "call_id") if c in results.columns]
    if "conv_id" in own:
        same = same & F.col("r.conv_id").eqNullSafe(F.col("c.conv_id"))
    return results.where(F.col("call_id").isNotNull()).alias("r").join(calls.select(*own).distinct().alias("c"), same, "left_anti")


#: The tools that turns of a conversation stand for where its messages hold no calls of their own.
SCHEMAS = {
    "configure": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False},
    "ask": {
        "type": "object",
        "required": ["text", "words"],
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 100000}, "words": {"type": "integer", "minimum": 1}, "context": {"type": "string"}},
        "additionalProperties": False,
    },
}


def of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain conversations: a system turn configures, a user turn asks and the next
    assistant turn answers; what is asked needs the configuration at turn 0, if there is one."""
    call_id = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    asks = F.col("role") == "user"
    arguments = F.when(asks, F.to_json(F.struct("text", words.alias("words"), call_id(F.lit(0)).alias("context")))).otherwise(F.to_json(F.struct("text")))
    calls = conversations.where(F.col("role").isin("user", "system")).select(
        "conv_id",
        F.col("turn").alias("place"),
        call_id(F.col("turn")).alias("call_id"),
        F.when(asks, "ask").otherwise("configure").alias("name"),
        arguments.alias("arguments"),
        F.when(asks & (F.col("turn") > 0), F.array(call_id(F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = conversations.where(F.col("role") == "assistant").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("place"), F.col("text").alias("content"))
    return calls, results


#: The query over turns in DuckDB's SQL. No turn's call is needed by one that it needs, so levels are 0 and 1.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         'call-' || conv_id || '-' || turn AS call_id, 'call-' || conv_id || '-0' AS first_id FROM conversations),
a AS (
  SELECT *, CASE WHEN role = 'user' THEN 'ask' ELSE 'configure' END AS name,
         CASE WHEN role = 'user' AND text IS NULL THEN to_json({'context': first_id, 'words': words}) WHEN role = 'user' THEN to_json({'context': first_id, 'text': text, 'words': words})
              WHEN text IS NULL THEN '{}'::JSON ELSE to_json({'text': text}) END AS arguments,
         length(coalesce(text, '')) BETWEEN 1 AND CASE WHEN role = 'user' THEN 100000 ELSE 1000000000000 END AND (role <> 'user' OR words >= 1) AS valid
  FROM t WHERE role IN ('user', 'system') AND call_id IS NOT NULL),
c AS (
  SELECT conv_id, call_id, count(*) AS copies, min({'place': turn, 'name': name, 'text': coalesce(text, ''), 'arguments': arguments::VARCHAR, 'valid': valid, 'asks': role = 'user' AND turn > 0, 'first_id': first_id}) AS f
  FROM a GROUP BY ALL),
r AS (SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, min({'place': turn, 'content': text}) AS r FROM t WHERE role = 'assistant' GROUP BY ALL)
SELECT c.conv_id, c.call_id, f.place AS place, f.name AS name, CASE WHEN f.asks AND EXISTS (SELECT 1 FROM c o WHERE o.conv_id = c.conv_id AND o.call_id = f.first_id) THEN 1 ELSE 0 END AS level,
       copies, r.r.place AS result_place, CASE WHEN r.r IS NULL THEN 'no result' ELSE 'ok' END AS status, f.valid AS valid,
       '{"arguments":' || f.arguments || ',"id":' || to_json(c.call_id) || ',"name":' || to_json(f.name) || ',"result":' || coalesce(to_json(r.r.content)::VARCHAR, 'null') || '}' AS json
FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
"""
