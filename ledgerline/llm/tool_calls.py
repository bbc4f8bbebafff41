"""Tool-call linking for chat data, in DataFrame functions alone.

Calls and results are hash-joined by identifier. Calls are put in topological order of what they depend on: rounds of joins give each
call the round after its last dependency. Arguments are checked against the tool's schema, and every call becomes canonical JSON:
keys in order, no spaces, one spelling for each value, as the schema's kinds ask.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, stored


def quoted(text: Column) -> Column:
    """A JSON string: the shortest escapes, other control characters as \\u00xx, everything else as it is."""
    pairs = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
    rest = [(chr(k), f"\\u{k:04x}") for k in range(32) if chr(k) not in "\n\r\t\b\f"]
    plain = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)
    full = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), rest, plain)
    odd = F.regexp_like(text, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]"))
    return F.concat(F.lit('"'), F.when(odd, full).otherwise(plain), F.lit('"'))


INTEGER, DECIMAL = r"^(0|-?[1-9][0-9]{0,17})$", r"^-?(0|[1-9][0-9]{0,17})([.][0-9]{1,18})?$"


def _once(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kind(fields: Column, key: Column) -> Column:
    """The kind that the schema gives a key; null for a key or a schema that is not there."""
    return F.get(F.transform(F.filter(fields, lambda f: f["name"] == key), lambda f: f["kind"]), F.lit(0))


def _nested(text: Column, kind: Column) -> Column:
    """Canonical JSON of a value that spells an object or array, as its kind says; null if it doesn't."""
    parsed = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(parsed), F.upper(kind)), F.to_json(parsed))


def spelled(value: Column, kind: Column) -> Column:
    """A value in JSON as its kind asks for, or null if it is not of that kind.

    Kinds: string, integer, number, boolean, object, array (JSON text, keys in order at every level) and enum:a|b|c."""
    return (
        F.when(kind == "integer", F.when(F.regexp_like(value, F.lit(INTEGER)), value))
        .when(kind == "number", F.when(F.regexp_like(value, F.lit(DECIMAL)), F.to_json(F.try_parse_json(value))))
        .when(kind == "boolean", F.when(value.isin("true", "false"), value))
        .when(kind.isin("object", "array"), _nested(value, kind))
        .when(F.startswith(kind, F.lit("enum:")), F.when(F.array_contains(F.split(F.substring(kind, 6, 1 << 30), "[|]"), value), quoted(value)))
        .otherwise(quoted(value))
    )


def canonical(arguments: Column, fields: Column) -> Column:
    """A map of strings as canonical JSON, keys in order; a value is written as its kind in the schema asks, as a string where it is not of that kind or has none, null as null."""
    entries = F.array_sort(F.map_entries(arguments), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    value = lambda e: F.when(e["value"].isNull(), F.lit("null")).otherwise(F.coalesce(_once(_kind(fields, e["key"]), lambda k: spelled(e["value"], k)), quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), value(e))), ","), F.lit("}"))


def faults(arguments: Column, fields: Column) -> Column:
    """What is wrong with the arguments: missing:<name>, type:<name>, unknown:<name>, in the order of names.

    fields: array of (name, kind, required boolean)."""
    given = F.coalesce(F.map_keys(arguments), F.array().cast("array<string>"))
    held = lambda f: F.element_at(arguments, f["name"])
    missing = F.transform(F.filter(fields, lambda f: f["required"] & held(f).isNull()), lambda f: F.concat(F.lit("missing:"), f["name"]))
    wrong = F.transform(F.filter(fields, lambda f: held(f).isNotNull() & spelled(held(f), f["kind"]).isNull()), lambda f: F.concat(F.lit("type:"), f["name"]))
    unknown = F.transform(F.filter(given, lambda k: ~F.array_contains(F.transform(fields, lambda f: f["name"]), k)), lambda k: F.concat(F.lit("unknown:"), k))
    return F.array_sort(F.concat(missing, wrong, unknown))


CALL = ["conv_id", "call_id"]


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that depend on nothing known in their conversation, else one more than the largest level they depend on.

    Calls on a cycle, and those behind one, get no row. Dependencies on unknown calls and on oneself count as none. As many rounds as the
    longest chain has calls; each round joins only the edges whose source was settled in the round before."""
    ids = calls.select(*CALL)
    source = lambda df: df.select("conv_id", F.col("call_id").alias("on"))
    edges = calls.select(*CALL, F.explode("after").alias("on")).distinct().filter("call_id <> on").join(source(ids), ["conv_id", "on"], "left_semi")
    edges = stored(edges, "edges")
    waiting = edges.groupBy(*CALL).agg(F.count("*").alias("open"))
    settled = stored(ids.join(waiting, CALL, "left_anti").withColumn("level", F.lit(0)), "level")
    waiting, every, now, k = stored(waiting, "waiting"), settled, settled, 0
    while not waiting.isEmpty() and not now.isEmpty():
        k += 1
        met = edges.join(source(now), ["conv_id", "on"]).groupBy(*CALL).agg(F.count("*").alias("met"))
        left = stored(waiting.join(met, CALL, "left").select(*CALL, (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")), "waiting")
        now = stored(left.filter("open = 0").select(*CALL, F.lit(k).alias("level")), "level")
        every, waiting = every.union(now), left.filter("open > 0")
    return every


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: its result by identifier, level, faults and canonical JSON.

    calls: call_id, conv_id, turn, name, arguments map<string,string>, after array<string>; results: conv_id, call_id, turn, content;
    schemas: name, fields. Identifiers are those of a conversation: equal ones of different conversations are different calls. Calls without conv_id or call_id are dropped; of calls that repeat an identifier in a conversation the first by turn counts, of results likewise. A call without a result has none;
    results without a call are left out; a tool without a schema has the fault schema:<name>; null arguments are an empty map. Extra
    columns are ignored."""
    known = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    first = F.struct(F.col("turn"), F.col("name"), F.map_entries("arguments").alias("arguments"), F.col("after"))
    c = calls.filter(known).groupBy(*CALL).agg(F.min(first).alias("c")).select(*CALL, "c.turn", "c.name", F.map_from_entries(F.coalesce("c.arguments", F.array().cast("array<struct<key:string,value:string>>"))).alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    c = stored(c, "calls")
    r = results.filter(known).groupBy(*CALL).agg(F.min(F.struct("turn", "content")).alias("r")).select(*CALL, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))
    s = schemas.groupBy("name").agg(F.min("fields").alias("fields"))
    # keys are unique on both sides by now, so no hash table holds more than its share of the calls
    joined = c.join(r.hint("shuffle_hash"), CALL, "left").join(levels(c).hint("shuffle_hash"), CALL, "left").join(s, "name", "left")
    wrong = F.when(F.col("fields").isNull(), F.array(F.concat(F.lit("schema:"), F.coalesce("name", F.lit(""))))).otherwise(faults(F.col("arguments"), F.col("fields")))
    text = F.concat(F.lit('{"arguments":'), canonical(F.col("arguments"), F.col("fields")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), F.when(F.col("name").isNull(), F.lit("null")).otherwise(quoted(F.col("name"))), F.lit(',"result":'), F.when(F.col("content").isNull(), F.lit("null")).otherwise(quoted(F.col("content"))), F.lit("}"))
    done = joined.withColumn("wrong", wrong)
    return done.select("conv_id", "call_id", "turn", "name", "result_turn", "level", F.array_join("wrong", ",").alias("faults"), (F.size("wrong") == 0).alias("valid"), text.alias("json"))


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) as calls, results and schemas.

    A user or system turn is a call of the tool named by its role, identified conv_id-turn, with its text and place as arguments; an assistant turn is the result of the turn before it.
    Calls after a conversation's first turn depend on that one. A system call allows no argument but its text, so its place is a fault."""
    t = turns.select(column(turns, "conv_id", "bigint").alias("conv_id"), column(turns, "turn", "bigint").alias("turn"), column(turns, "role", "string").alias("role"), column(turns, "text", "string").alias("text")).filter("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL")
    name = lambda at: F.concat_ws("-", F.col("conv_id").cast("string"), at.cast("string"))
    arguments = F.create_map(F.lit("text"), F.col("text"), F.lit("turn"), F.col("turn").cast("string"))
    after = F.when(F.col("turn") > 0, F.array(name(F.lit(0)))).otherwise(F.array().cast("array<string>"))
    calls = t.filter("role <> 'assistant'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.col("role").alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = t.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    kind = "array<struct<name:string,kind:string,required:boolean>>"
    schemas = turns.sparkSession.sql(f"""SELECT 'user' AS name, CAST(array(named_struct('name', 'text', 'kind', 'string', 'required', true), named_struct('name', 'turn', 'kind', 'integer', 'required', true)) AS {kind}) AS fields
        UNION ALL SELECT 'system', CAST(array(named_struct('name', 'text', 'kind', 'string', 'required', true)) AS {kind})""")
    return calls, results, schemas
