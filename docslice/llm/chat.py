"""Chat formatting with linked tool calls, in DataFrame functions alone.

Messages are rows (conv_id, turn, role, text). A text that is a JSON object can carry structure:

    tools        {"tools": [{"name", "parameters": JSON schema}]}: schemas of the conversation
    calls        {"content", "tool_calls": [{"id", "name", "arguments", "depends_on": [ids]}]}
    a result     {"tool_call_id", "content"}

Calls and tools may hold their name, arguments and parameters in an object `function`, and arguments may be a JSON text.

Calls and results are hash-joined by conversation and identifier. Order is topological: a result stands after its
call, and a call after the results it depends on; otherwise turns decide. Places are found by rounds of joins that end
when nothing moves; a message in a cycle keeps its own turn and is told in its issues. Arguments are checked against
the tool's schema: required and unknown names, types (one or several), enumerations, bounds of numbers, lengths of
strings and arrays, of nested objects and array items (`items`) to any depth; other keywords of JSON schema (references,
combinations, patterns) are not checked.

Each message is one line of canonical JSON: all fields that the message has, known or not, at every depth; names sorted,
no spaces, arguments that are a JSON text of an object written as that object. Left out are only null fields of the
message itself. The row's role is the line's; another one in the text is told in the issues.

A conversation is never gathered in one task: messages keep their rows, and a message's position is the number of
messages in earlier stretches of STRETCH turns, counted beforehand, plus its rank in its own stretch.

Defined cases: a null or empty text is a message without content; a text that is no JSON object, or an object with a
name twice, is plain content; null conv_ids are one conversation, apart from one that is named "null"; numbers beyond
38 digits become doubles; null turns come first; rows of equal turn order by
role and text; repeated rows keep a line each; an identifier called twice belongs to its first call, and of several results the first
is the one that others depend on; a result without
call and a call without result are told in their issues; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docslice.runtime import materialise, table

STRETCH = 1024
_TYPES = {"string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT", "null": "VOID"}


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with c (conversation), key (a message's identity) and the parts of a structured text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = messages.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"), F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c")
    )
    doc = F.when(F.substring(F.ltrim("text", F.lit(" \t\r\n")), 1, 1) == "{", F.try_parse_json("text"))
    own = own.withColumn("doc", doc)
    return own.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "c",
        F.xxhash64("c", "turn", "role", "text").alias("key"),
        _get(F.col("doc"), "$.tool_calls", "array<variant>").alias("calls"),
        _get(F.col("doc"), "$.tool_call_id", "string").alias("answers"),
        _get(F.col("doc"), "$.tools", "array<variant>").alias("tools"),
        F.when(_get(F.col("doc"), "$.tool_calls", "array<variant>").isNotNull() | _get(F.col("doc"), "$.tool_call_id", "string").isNotNull() | _get(F.col("doc"), "$.tools", "array<variant>").isNotNull(), F.col("doc")).alias("doc"),
    )


def _arguments(v: Column) -> Column:
    """Arguments (variant); a JSON text of an object is that object."""
    inner = F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(_get(v, "$", "string")))
    return F.when(F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False)), inner).otherwise(v)


def _either(v: Column, name: str, kind: str) -> Column:
    """A field of a call or tool, or of its `function`."""
    return F.coalesce(_get(v, f"$.{name}", kind), _get(v, f"$.function.{name}", kind))


def _tidy(call: Column) -> Column:
    """A call with all its fields, its arguments as an object."""
    inner = _get(call, "$.function", "map<string,variant>")
    inner = F.parse_json(F.to_json(F.transform_values(inner, lambda k, v: F.when(k == "arguments", _arguments(v)).otherwise(v))))
    own = F.transform_values(_get(call, "$", "map<string,variant>"), lambda k, v: F.when(k == "arguments", _arguments(v)).when(k == "function", F.coalesce(inner, v)).otherwise(v))
    return F.coalesce(F.parse_json(F.to_json(own)), call)


def _type_ok(value: Column, schema: Column, at: str = "$") -> Column:
    """Whether a variant has one of the types of a JSON schema (at a path of a variant); unknown or missing ones hold for all."""
    own = F.schema_of_variant(value)

    def one(kind: Column) -> Column:
        ok = F.when(kind == "number", own.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")).when(kind == "array", own.startswith("ARRAY")).when(kind == "object", own.startswith("OBJECT"))
        for name, spark_type in _TYPES.items():
            ok = ok.when(kind == name, own == spark_type)
        return F.coalesce(ok, F.lit(True))

    kinds = F.coalesce(_get(schema, f"{at}.type", "array<string>"), F.array(_get(schema, f"{at}.type", "string")))
    return F.exists(kinds, one)


def _bounds_ok(value: Column, schema: Column, at: str = "$") -> Column:
    """Whether a variant keeps the bounds of a JSON schema: of numbers, and lengths of strings and arrays."""
    own = F.schema_of_variant(value)
    number = F.when(own.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _get(value, "$", "double"))
    length = F.when(own == "STRING", F.length(_get(value, "$", "string")))
    items = F.when(own.startswith("ARRAY"), F.size(_get(value, "$", "array<variant>")))
    bound = lambda name: _get(schema, f"{at}.{name}", "double")
    broken = [number < bound("minimum"), number > bound("maximum"), number <= bound("exclusiveMinimum"), number >= bound("exclusiveMaximum"), length < bound("minLength"), length > bound("maxLength"), items < bound("minItems"), items > bound("maxItems")]
    return ~F.exists(F.array(*broken), lambda x: F.coalesce(x, F.lit(False)))


def argument_issues(arguments: Column, schema: Column, path: Column | None = None) -> Column:
    """Sorted issues of an object or array (variant) under a JSON schema (variant): of its own names, and the types and
    enumerations of its values. path: where it lies in the arguments; without one it is the arguments themselves."""
    none = F.array().cast("array<string>")
    args = F.coalesce(_get(arguments, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    properties = F.coalesce(_get(schema, "$.properties", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    required = F.coalesce(_get(schema, "$.required", "array<string>"), none)
    names, known = F.map_keys(args), F.map_keys(properties)
    closed = ~F.coalesce(_get(schema, "$.additionalProperties", "boolean"), F.lit(True))
    place = lambda k: F.concat(path, F.lit("."), k) if path is not None else k
    missing = F.transform(F.array_except(required, names), lambda x: F.concat(F.lit("missing:"), place(x)))
    unknown = F.when(closed, F.transform(F.array_except(names, known), lambda x: F.concat(F.lit("unknown:"), place(x)))).otherwise(none)
    shared = F.array_intersect(names, known)
    wrong = F.transform(F.filter(shared, lambda k: ~_type_ok(args[k], properties[k])), lambda x: F.concat(F.lit("type:"), place(x)))
    beyond = F.transform(F.filter(shared, lambda k: ~_bounds_ok(args[k], properties[k])), lambda x: F.concat(F.lit("range:"), place(x)))
    options = lambda k: F.transform(_get(properties[k], "$.enum", "array<variant>"), lambda x: F.to_json(x))
    odd = F.transform(F.filter(shared, lambda k: ~F.coalesce(F.array_contains(options(k), F.to_json(args[k])), F.lit(True))), lambda x: F.concat(F.lit("enum:"), place(x)))
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    if path is None:
        return F.array_sort(F.concat(F.when(is_object, none).otherwise(F.array(F.lit("type:arguments"))), missing, unknown, wrong, beyond, odd))
    kinds = F.transform(_get(schema, "$.items.enum", "array<variant>"), lambda x: F.to_json(x))
    told = lambda v, i: F.array(
        F.when(~_type_ok(v, schema, "$.items"), F.concat(F.lit("type:"), path, F.lit("["), i.cast("string"), F.lit("]"))),
        F.when(~_bounds_ok(v, schema, "$.items"), F.concat(F.lit("range:"), path, F.lit("["), i.cast("string"), F.lit("]"))),
        F.when(~F.coalesce(F.array_contains(kinds, F.to_json(v)), F.lit(True)), F.concat(F.lit("enum:"), path, F.lit("["), i.cast("string"), F.lit("]"))),
    )
    items = F.filter(F.flatten(F.transform(F.coalesce(_get(arguments, "$", "array<variant>"), F.array().cast("array<variant>")), told)), lambda x: x.isNotNull())
    return F.array_sort(F.when(is_object, F.concat(missing, unknown, wrong, beyond, odd)).otherwise(items))


def nested_issues(calls: DataFrame) -> DataFrame:
    """uid, nested: issues of the objects and arrays inside the arguments of calls (uid, arguments, schema as JSON), to
    any depth. Each round is one level of nesting."""

    def inside(df: DataFrame, path: Column | None) -> DataFrame:
        v, s = F.parse_json("arguments"), F.parse_json("schema")
        join = lambda k: F.concat(path, F.lit("."), k) if path is not None else k
        args, properties = _get(v, "$", "map<string,variant>"), _get(s, "$.properties", "map<string,variant>")
        named = F.transform(F.array_intersect(F.map_keys(args), F.map_keys(properties)), lambda k: F.struct(join(k).alias("path"), F.to_json(args[k]).alias("arguments"), F.to_json(properties[k]).alias("schema")))
        found = df.select("uid", F.explode(named).alias("x"))
        if path is not None:
            item = F.to_json(_get(s, "$.items", "variant"))
            listed = F.transform(_get(v, "$", "array<variant>"), lambda y, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.to_json(y).alias("arguments"), item.alias("schema")))
            found = found.unionAll(df.select("uid", F.explode(listed).alias("x")))
        # only objects and arrays hold more
        return materialise(found.select("uid", "x.*").filter(F.col("schema").isNotNull() & F.col("arguments").rlike(r"^[{\[]")), "chat-nested")

    own = calls.filter(F.col("schema").isNotNull() & F.col("arguments").isNotNull())
    level, told = inside(own, None), None
    while True:
        issues = level.select("uid", F.explode(argument_issues(F.parse_json("arguments"), F.parse_json("schema"), F.col("path"))).alias("issue"))
        told = issues if told is None else told.unionAll(issues)
        if level.isEmpty():
            return told.groupBy("uid").agg(F.array_sort(F.collect_set("issue")).alias("nested"))
        level = inside(level, F.col("path"))


def _linked(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (one for each conversation and identifier, with its schema's issues) and results."""
    call = F.explode("calls").alias("call")
    each = own.filter(F.size("calls") > 0).select("c", "key", "turn", call)
    each = each.select("c", "key", "turn", _get(F.col("call"), "$.id", "string").alias("id"), _either(F.col("call"), "name", "string").alias("name"), _arguments(_either(F.col("call"), "arguments", "variant")).alias("arguments"), F.coalesce(_get(F.col("call"), "$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("after"))
    tools = own.filter(F.size("tools") > 0).select("c", "turn", "key", F.explode("tools").alias("tool")).select("c", "turn", "key", _either(F.col("tool"), "name", "string").alias("name"), F.to_json(_either(F.col("tool"), "parameters", "variant")).alias("schema"))
    tools = tools.groupBy("c", "name").agg(F.min_by("schema", F.struct("turn", "key")).alias("schema"))
    each = each.join(tools, ["c", "name"], "left").withColumn("problems", F.when(F.col("schema").isNotNull(), argument_issues(F.col("arguments"), F.parse_json("schema"))).otherwise(F.array(F.lit("no_schema"))))
    each = each.withColumn("arguments", F.to_json("arguments"))
    each = materialise(each.withColumn("uid", F.xxhash64("c", "key", "schema", "arguments")), "chat-arguments")
    nested = nested_issues(each.select("uid", "arguments", "schema").distinct())
    each = each.join(nested, "uid", "left").withColumn("problems", F.array_sort(F.concat("problems", F.coalesce("nested", F.array().cast("array<string>")))))
    results = own.filter(F.col("answers").isNotNull()).select("c", "key", "turn", F.col("answers").alias("id"))
    return each, results


def _places(edges: DataFrame) -> DataFrame:
    """edges: c, src, src_turn, dst, dst_turn. Place (turn, step) of each message that an edge ends in, and whether it
    lies in a cycle."""
    edges = materialise(edges.distinct(), "chat-edges")
    sources = edges.select("c", F.col("src").alias("key"), F.col("src_turn").alias("turn"))
    nodes = sources.unionAll(edges.select("c", F.col("dst").alias("key"), F.col("dst_turn").alias("turn"))).distinct()
    size = nodes.groupBy("c").agg(F.count("*").alias("nodes"))
    now = materialise(nodes.join(size, "c").select("c", "key", "turn", "nodes", F.struct(F.col("turn").alias("turn"), F.lit(0).cast("long").alias("step")).alias("place"), F.lit(False).alias("cycle")), "chat-places")
    if edges.isEmpty():
        return now
    while True:
        pushed = edges.join(now.select("c", F.col("key").alias("src"), "place", "cycle"), ["c", "src"]).filter(~F.col("cycle"))
        pushed = pushed.groupBy("c", F.col("dst").alias("key")).agg(F.max("place").alias("before"))
        after = F.struct(F.col("before.turn").alias("turn"), (F.col("before.step") + 1).alias("step"))
        moved = F.col("before").isNotNull() & (F.col("place") < after) & ~F.col("cycle")
        step = now.join(pushed, ["c", "key"], "left").withColumns({"moved": moved, "to": F.when(moved, after).otherwise(F.col("place"))})
        ring = F.col("cycle") | (F.col("to.step") > F.col("nodes"))
        step = materialise(step.select("c", "key", "turn", "nodes", F.when(ring, F.struct(F.col("turn").alias("turn"), F.lit(0).cast("long").alias("step"))).otherwise(F.col("to")).alias("place"), ring.alias("cycle"), "moved"), "chat-places")
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, position, role, kind, issues, line of every message, position from 0 in each conversation."""
    own = materialise(parsed(messages).withColumns({"calls": F.to_json("calls"), "tools": F.to_json("tools"), "doc": F.to_json("doc")}), "chat-messages")
    variants = {n: F.from_json(n, "array<variant>") for n in ("calls", "tools")}
    structured = own.filter(F.col("calls").isNotNull() | F.col("tools").isNotNull() | F.col("answers").isNotNull()).withColumns(variants)
    each, results = _linked(structured)
    calls = each.select("c", "key", "turn", "id", "name", "after", "problems", "arguments")
    calls, results = materialise(calls, "chat-calls"), materialise(results, "chat-results")
    first = calls.filter(F.col("id").isNotNull()).groupBy("c", "id").agg(F.min_by(F.struct("key", "turn"), F.struct("turn", "key")).alias("call"), F.count_distinct("key").alias("times"))
    answered = results.groupBy("c", "id").agg(F.min_by(F.struct("key", "turn"), F.struct("turn", "key")).alias("result"))
    call_to_result = results.join(first, ["c", "id"]).select("c", F.col("call.key").alias("src"), F.col("call.turn").alias("src_turn"), F.col("key").alias("dst"), F.col("turn").alias("dst_turn"))
    result_to_call = calls.select("c", "key", "turn", F.explode("after").alias("id")).join(answered, ["c", "id"]).select("c", F.col("result.key").alias("src"), F.col("result.turn").alias("src_turn"), F.col("key").alias("dst"), F.col("turn").alias("dst_turn"))
    places = _places(call_to_result.unionAll(result_to_call).filter(F.col("src") != F.col("dst"))).select("c", "key", "place", "cycle")

    told = calls.join(first.select("c", "id", "times"), ["c", "id"], "left").join(answered.select("c", "id", F.lit(True).alias("has")), ["c", "id"], "left")
    label = F.coalesce("id", F.lit("?"))
    problems = F.transform("problems", lambda p: F.concat(label, F.lit(":"), p))
    problems = F.concat(problems, F.when(F.col("has").isNull(), F.array(F.concat(label, F.lit(":no_result")))).otherwise(F.array().cast("array<string>")), F.when(F.col("times") > 1, F.array(F.concat(label, F.lit(":repeated_id")))).otherwise(F.array().cast("array<string>")))
    by_call = told.groupBy("c", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(problems)))).alias("call_issues"))
    by_result = results.join(first.select("c", "id", F.lit(True).alias("has")), ["c", "id"], "left").filter(F.col("has").isNull()).select("c", "key", F.array(F.concat("id", F.lit(":no_call"))).alias("result_issues")).distinct()

    none = F.array().cast("array<string>")
    notes = by_call.join(by_result, ["c", "key"], "full").join(places, ["c", "key"], "full")
    notes = materialise(notes.select("c", "key", F.concat(F.coalesce("call_issues", none), F.coalesce("result_issues", none), F.when(F.col("cycle"), F.array(F.lit("cycle"))).otherwise(none)).alias("issues"), "place"), "chat-notes")
    # a message's place: (turn, step); messages without links keep their turn
    full = own.join(notes, ["c", "key"], "left").withColumns({"at": F.coalesce(F.col("place.turn"), F.col("turn")), "step": F.coalesce(F.col("place.step"), F.lit(0))})
    full = full.withColumn("stretch", F.floor(F.coalesce("at", F.lit(-1)) / STRETCH).cast("long"))
    narrow = own.select("c", "key", "turn").join(notes.select("c", "key", "place"), ["c", "key"], "left")
    counts = narrow.groupBy("c", F.floor(F.coalesce(F.col("place.turn"), F.col("turn"), F.lit(-1)) / STRETCH).cast("long").alias("stretch")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("c", "stretch", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("c", "stretch").orderBy(F.col("at").asc_nulls_first(), "step", F.col("turn").asc_nulls_first(), "role", "text"))
    full = full.join(starts, ["c", "stretch"]).withColumn("position", F.col("before") + rank - 1)

    kind = F.when(F.col("calls").isNotNull(), "call").when(F.col("answers").isNotNull(), "result").when(F.col("tools").isNotNull(), "tools").otherwise("message")
    fields = _get(F.parse_json("doc"), "$", "map<string,variant>")
    calls_ = F.parse_json(F.to_json(F.transform(F.from_json("calls", "array<variant>"), _tidy)))
    own_role = _get(F.parse_json("doc"), "$.role", "string")
    fields = F.map_filter(fields, lambda k, v: (k != "role") & (F.schema_of_variant(v) != "VOID"))
    fields = F.transform_values(fields, lambda k, v: F.when((k == "tool_calls") & calls_.isNotNull(), calls_).otherwise(v))
    plain = F.when(F.col("text") != "", F.create_map(F.lit("content"), F.col("text").cast("variant")))
    none_ = F.create_map().cast("map<string,variant>")
    role = F.when(F.col("role").isNotNull(), F.create_map(F.lit("role"), F.col("role").cast("variant")))
    whole = F.map_concat(F.coalesce(fields, plain, none_), F.coalesce(role, none_))
    line = F.to_json(F.parse_json(F.to_json(whole)))  # a variant's fields are in the order of their names
    issues = F.concat_ws(",", "issues", F.when(own_role != F.coalesce("role", F.lit("")), F.concat(F.lit("own_role:"), own_role)))
    return full.select("conv_id", "turn", "position", "role", kind.alias("kind"), issues.alias("issues"), line.alias("line"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))
