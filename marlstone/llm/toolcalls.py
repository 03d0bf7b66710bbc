"""Chat formatting: tool calls linked to results, ordered, validated and serialised (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, running_sum

# JSON Schema types and the variant types that Spark reports for them.
NUMBER = "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)"
TYPES = {"string": "STRING", "number": NUMBER, "boolean": "BOOLEAN", "object": "OBJECT<.*>", "array": "ARRAY<.*>", "null": "VOID"}
#: Takes the place of a level in the order of calls that have none.
LAST = 1 << 62
NO_IDS = "array<string>"


def _number(token: Column) -> Column:
    """One form for equal numbers: whole ones without fraction or exponent up to 38 digits, others as
    plain decimals where these are the same double, else as the double's own form."""
    double, whole, plain = token.try_cast("double"), token.try_cast("decimal(38,0)"), token.try_cast("decimal(38,18)")
    return (
        F.when(~token.rlike("[.eE]"), token)
        .when(whole.cast("double") == double, whole.cast("string"))
        .when(plain.cast("double") == double, F.regexp_replace(plain.cast("string"), "0+$", ""))
        .otherwise(F.coalesce(double.cast("string"), token))
    )


def one_number_form(json: Column) -> Column:
    """JSON text without white space, the numbers outside its strings in one form.

    JSON holds no raw control characters, so two of these stand for escaped backslashes and
    quotes while the text is cut at the quotes of its strings."""
    bare = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    token = F.lit("-?[0-9][0-9.eE+-]*|[^0-9-]+")
    one = lambda t: F.when(t.rlike("^-?[0-9]"), _number(t)).otherwise(t)
    parts = F.transform(F.split(bare, '"'), lambda x, i: F.when(i % 2 == 1, x).otherwise(F.array_join(F.transform(F.regexp_extract_all(x, token, F.lit(0)), one), "")))
    joined = F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.when(json.rlike("[0-9][.eE]"), joined).otherwise(json)


def canonical(json: Column) -> Column:
    """JSON with the keys of every object in order, no white space and one form for equal numbers;
    null where it is not valid."""
    return one_number_form(F.to_json(F.try_parse_json(json)))


def _has_type(part: Column, kinds: list[str]) -> Column:
    kind, good = F.schema_of_variant(part), F.lit(False)
    for k in kinds:
        if k == "integer":  # whole numbers, however they are written
            value = F.try_variant_get(part, "$", "double")
            good = good | (kind.rlike(f"^{NUMBER}$") & F.coalesce(value == F.rint(value), F.lit(False)))
        else:
            good = good | kind.rlike(f"^{TYPES[k]}$")
    return F.coalesce(good, F.lit("null" in kinds))


def violations(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with a call's arguments, in order: an array of texts, empty if nothing is.

    A schema has properties (type, enum, minimum, maximum, minLength, maxLength each), required and
    additionalProperties (true unless given as false)."""
    value = F.try_parse_json(arguments)
    out = F.when(value.isNull(), F.array(F.lit("arguments are not JSON"))).when(~F.schema_of_variant(value).rlike("^OBJECT"), F.array(F.lit("arguments are not an object")))
    for tool, schema in schemas.items():
        found: list[Column] = []
        props = schema.get("properties", {})
        keys = F.json_object_keys(F.to_json(value))
        for key in schema.get("required", []):
            found.append(F.when(~F.coalesce(F.array_contains(keys, key), F.lit(False)), F.lit(f"{key} is missing")))
        if not schema.get("additionalProperties", True):
            known = F.array(*[F.lit(k) for k in props]).cast(NO_IDS)
            more = F.array_sort(F.array_except(keys, known))
            found.append(F.when(F.size(more) > 0, F.concat(F.array_join(more, ", "), F.lit(" not known"))))
        for key, want in props.items():
            part = F.try_variant_get(value, f"$['{key}']", "variant")
            is_there = F.array_contains(keys, key)
            if "type" in want:
                kinds = want["type"] if isinstance(want["type"], list) else [want["type"]]
                found.append(F.when(is_there & ~_has_type(part, kinds), F.lit(f"{key} is not {' or '.join(kinds)}")))
            text = F.try_variant_get(value, f"$['{key}']", "string")
            if "enum" in want:
                found.append(F.when(is_there & ~F.coalesce(text.isin(*want["enum"]), F.lit(False)), F.lit(f"{key} is not one of its values")))
            for limit, measure, beyond, word in (
                ("minimum", F.try_variant_get(value, f"$['{key}']", "double"), False, "below"),
                ("maximum", F.try_variant_get(value, f"$['{key}']", "double"), True, "above"),
                ("minLength", F.char_length(text), False, "shorter than"),
                ("maxLength", F.char_length(text), True, "longer than"),
            ):
                if limit in want:
                    found.append(F.when(measure > want[limit] if beyond else measure < want[limit], F.lit(f"{key} is {word} {want[limit]}")))
        out = out.when(name == tool, F.array_compact(F.array(*found)) if found else F.array().cast(NO_IDS))
    return out.otherwise(F.array(F.lit("tool is not known")))


def _levels(calls: DataFrame, tables: Tables) -> DataFrame:
    """(conv, id, level) of calls (conv, id, waits_for): the longest chain of calls that a call waits
    for; null in or behind a cycle.

    Calls that wait for one other form trees; each points to its call, and rounds of pointer
    doubling take all to the tree's root, so that a chain of n calls needs log2(n) rounds. Roots
    wait for none or for several calls; the latter get levels in rounds, one for each step of the
    longest way through them. A round that settles nothing leaves only cycles and what waits for them."""
    ids = calls.where("id is not null").select("conv", "id").distinct()
    edges = calls.select("conv", "id", F.explode("waits_for").alias("to")).where("id is not null").distinct()
    edges = tables.save(edges.join(ids.withColumnRenamed("id", "to"), ["conv", "to"], "left_semi").select("conv", "id", "to"), "edges")
    many = edges.groupBy("conv", "id").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to"))
    node = ids.join(many, ["conv", "id"], "left").select("conv", "id", F.when(F.col("n") == 1, F.col("to")).alias("to"), F.coalesce("n", F.lit(0)).alias("n"))
    # root: the call a pointer has come to if that is a root; steps: how far it is
    node = node.select("conv", "id", "n", "to", F.when(F.col("n") != 1, F.col("id")).alias("root"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("steps"))
    node = tables.save(node, "nodes")
    open_ = node.where("root is null").count()
    while open_:
        next_ = node.select("conv", F.col("id").alias("to"), F.col("to").alias("to_2"), F.col("root").alias("root_2"), F.col("steps").alias("steps_2"))
        left = node.where("root is null").join(next_, ["conv", "to"])
        moved = left.select("conv", "id", "n", F.col("to_2").alias("to"), F.col("root_2").alias("root"), (F.col("steps") + F.col("steps_2")).alias("steps"))
        new = tables.save(node.where("root is not null").unionByName(moved), "nodes")
        tables.drop(node)
        node, before, open_ = new, open_, new.where("root is null").count()
        if open_ == before:
            break
    settled = tables.save(node.where("root is not null and n = 0").select("conv", F.col("id").alias("root"), F.lit(0).cast("long").alias("level")), "levels")
    knots = node.where("n > 1").select("conv", "id").join(edges, ["conv", "id"])
    ways = knots.join(node.select("conv", F.col("id").alias("to"), "root", "steps"), ["conv", "to"]).select("conv", "id", "root", (F.col("steps") + 1).alias("steps"))
    ways = tables.save(ways, "ways")
    while not ways.isEmpty():
        met = ways.join(settled, ["conv", "root"], "left").groupBy("conv", "id").agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        new = tables.save(met.where("open = 0").select("conv", F.col("id").alias("root"), "level"), "settled")
        if new.isEmpty():
            break
        more = tables.save(settled.unionByName(new), "levels")
        rest = tables.save(ways.join(new.withColumnRenamed("root", "id"), ["conv", "id"], "left_anti").select("conv", "id", "root", "steps"), "ways")
        tables.drop(settled, ways, new)
        settled, ways = more, rest
    return node.where("root is not null").join(settled, ["conv", "root"]).select("conv", "id", (F.col("level") + F.col("steps")).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for each call and each result without a call.

    calls: conv_id, call_id, name, arguments (JSON text), seq, waits_for (ids of calls, array).
    results: conv_id, call_id, content. Returns conv_id, call_id, name, level, position (in the
    conversation, from 0: calls by level, seq, id; those in cycles and orphan results last), status
    (linked, no result, no call, repeated: more than one call or result of that id; cycle), errors
    (of the arguments) and json: canonical JSON of the call with its result.

    Calls and results meet in a hash join on conversation and identifier. Null identifiers never
    link and are never repeated. A null conv_id is a conversation like any other. Of results that
    share an identifier the smallest content is taken and the status says so; of calls that do, each
    is kept. A null waits_for is empty; identifiers in it that no call of the conversation has are
    passed over. Texts of any length are taken whole. Equal rows are calls of their own, in the
    order of their JSON. Empty tables give no rows. Other columns are ignored, whatever their names."""
    tables = Tables(calls.sparkSession, "toolcalls")
    # exact, non-null keys: a conversation, and rows without identifier spread by a hash
    conv = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit("0").cast(calls.schema["conv_id"].dataType)).alias("value")).alias("conv")
    spread = lambda c: F.when(F.col("call_id").isNull(), F.pmod(F.xxhash64(c), F.lit(1024)) + 1).otherwise(0).alias("spread")
    key = ["conv", "id", "spread"]
    c = calls.select(conv, F.col("call_id").alias("id"), spread("arguments"), "name", "arguments", F.col("seq").cast("long").alias("seq"), F.coalesce("waits_for", F.array().cast(NO_IDS)).alias("waits_for"))
    c = tables.save(c, "calls")
    r = results.select(conv, F.col("call_id").alias("id"), spread("content"), "content")
    one = F.col("id").isNotNull()
    answer = r.where(one).groupBy(*key).agg(F.count(F.lit(1)).alias("n_results"), F.min("content").alias("content"))
    lost = r.where(~one).select(*key, F.lit(1).cast("long").alias("n_results"), "content")
    counted = c.drop("waits_for").withColumn("n_calls", F.when(one, F.count(F.lit(1)).over(Window.partitionBy(*key))).otherwise(F.lit(1)))
    rows = counted.join(answer, key, "full").unionByName(lost, allowMissingColumns=True).join(_levels(c, tables), ["conv", "id"], "left")
    called = F.col("n_calls").isNotNull()
    status = (
        F.when(~called, "no call")
        .when((F.col("n_calls") > 1) | (F.col("n_results") > 1), "repeated")
        .when(one & F.col("level").isNull(), "cycle")
        .when(F.col("n_results").isNull(), "no result")
        .otherwise("linked")
    )
    parsed = F.coalesce(F.try_parse_json("arguments"), F.parse_json(F.to_json(F.struct("arguments"))))
    as_json = one_number_form(F.to_json(F.struct(parsed.alias("arguments"), "id", "name", F.col("content").alias("result")), {"ignoreNullFields": "false"}))
    errors = F.when(called, violations(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast(NO_IDS))
    level = F.when(one, F.col("level")).otherwise(F.when(called, 0)).cast("long")
    rows = rows.withColumn("level", level).withColumns({"status": status, "errors": errors, "json": as_json})
    # order within a conversation: parts are a level and a run of seq, so that no task holds a whole one
    seq = F.coalesce("seq", F.lit(0).cast("long"))
    part = F.struct((~called).alias("late"), F.coalesce("level", F.lit(LAST)).alias("level"), F.expr("coalesce(seq, 0) div 1024").alias("run"))
    rows = tables.save(rows.withColumn("part", part), "linked")
    out = running_sum(rows, "conv", "part", [seq, F.col("id"), F.col("json")], F.lit(1), "position")
    return tables.keep(out.select(F.when(~F.col("conv.none"), F.col("conv.value")).alias("conv_id"), F.col("id").alias("call_id"), "name", "level", "position", "status", "errors", "json"), "out")


#: The tool that an assistant's turn is taken to answer for, and its arguments.
MAX_TEXT, MAX_TURN = 600, 5
REPLY_SCHEMA = {"reply": {"properties": {"text": {"type": "string", "minLength": 1, "maxLength": MAX_TEXT}, "turn": {"type": "integer", "minimum": 0, "maximum": MAX_TURN}}, "required": ["text", "turn"], "additionalProperties": False}}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations (conv_id, turn, role, text) without tool messages: each user
    turn calls reply with its text and turn, each assistant turn is a result for the last user turn
    before it. Identifiers count the user turns of the conversation; turns before the first are
    results of call 0. Rows of equal turn are ordered by role and text.

    A call waits for the conversation's call before it; one without a result also waits for the call
    after it, which asks again. So a conversation is a chain up to its first such call, and that
    call and all later ones are in a cycle or wait for one."""
    tables = Tables(conversations.sparkSession, "conversations")
    zero = F.lit("0").cast(conversations.schema["conv_id"].dataType)
    conv = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", zero).alias("value"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumns({"conv": conv, "part": F.expr("coalesce(turn, -1) div 1024")})
    is_user = F.coalesce((F.col("role") == "user").cast("int"), F.lit(0))
    rows = running_sum(rows, "conv", "part", [F.col("turn"), F.desc("role"), F.col("text")], is_user, "before")
    ident = lambda k: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), k.cast("string"))
    rows = tables.save(rows.withColumn("k", F.col("before") + is_user).select("conv", "conv_id", "turn", "role", "text", "k"), "turns")
    k = F.col("k")
    results = rows.where(F.col("role") == "assistant")
    answered = results.select("conv", "k").distinct().withColumn("answered", F.lit(True))
    asked = rows.where(F.col("role") == "user").join(answered, ["conv", "k"], "left")
    waits = F.array_compact(F.array(F.when(k > 1, ident(k - 1)), F.when(F.col("answered").isNull(), ident(k + 1))))
    calls = asked.select("conv_id", ident(k).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), F.col("turn").alias("seq"), waits.alias("waits_for"))
    return calls, results.select("conv_id", ident(k).alias("call_id"), F.col("text").alias("content"))
