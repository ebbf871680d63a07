"""Chat formatting with tool-call linking, in DataFrame and SQL functions only.

Turns are (conv_id, turn, role, text). An assistant's text may hold calls,
``<tool_call>{"id": ..., "name": ..., "arguments": {...}, "depends_on": [...]}</tool_call>``; a turn of role ``tool``
holds ``{"tool_call_id": ..., "content": ...}``; a system turn may declare tools,
``<tool>{"name": ..., "parameters": {"properties": {...}, "required": [...]}}</tool>``.

Calls and results meet by a hash join on (conv_id, id). Calls are ordered after the calls they depend on, level by
level: an id's order is the largest turn among its first call's and the orders of all it needs, and a call comes no earlier than its id's
needs. A result comes no earlier than its call's order, at its call's level, behind it. Arguments are validated against the declared
schema, depth by depth: types (one or several), enum, required names, properties and items; and each event is serialised as canonical JSON: sorted keys, no blanks. One row per event:
a turn's own message, with its calls cut out, then each call. Nothing is gathered by conversation, so one of any
length is as good as many; order is given by ``order_turn``, ``level`` and ``step``.

Nulls: a null role is "", a null text empty; null conv_ids are a conversation of their own kind that links nothing.
A call without an id, or whose JSON does not parse, is "malformed"; one whose id another call of the
conversation has, "repeated"; one without a result, "unanswered"; a result without a call, "orphan"; a call on or
behind a cycle, "cyclic". ``valid``: null where no tool of that name is declared; of several declarations the first counts. Equal
calls and equal results are events apiece. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import save

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
TOOL = r"(?s)<tool>(.*?)</tool>"
_CALL = "id string, name string, arguments string, depends_on array<string>"
#: JSON schema types and what Spark calls a variant's types.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}


def canonical(text: Column) -> Column:
    """The JSON text with sorted keys and without blanks; null where it does not parse."""
    return F.to_json(F.try_parse_json(text))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, turn, depends_on) to (conv_id, id, level, before, reach); rows on or behind a cycle are missing.

    ``before`` is the largest order of what the id needs, ``reach`` the larger of that and its first turn. Each round tells the ids that wait for the last round's,
    by a join along the needs, and only ids that wait are written again."""
    nodes = calls.groupBy("conv_id", "id").agg(F.min("turn").alias("first"))
    needs = calls.select("conv_id", "id", F.explode("depends_on").alias("need")).distinct().join(nodes.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"], "left_semi")
    needs = save(needs, "needs")
    nodes = nodes.join(needs.groupBy("conv_id", "id").agg(F.count("*").alias("left")), ["conv_id", "id"], "left")
    state = save(nodes.select("conv_id", "id", "first", F.coalesce("left", F.lit(0)).alias("left"), F.lit(None).cast("long").alias("before")), "levels")
    done, level = [], 0
    while True:
        new = state.where("left = 0").select("conv_id", "id", F.lit(level).alias("level"), "before", F.greatest("first", "before").alias("reach"))
        done.append(new)
        waiting = state.where("left > 0")
        if waiting.isEmpty() or new.isEmpty():
            break
        told = new.select("conv_id", F.col("id").alias("need"), "reach").join(needs, ["conv_id", "need"]).groupBy("conv_id", "id").agg(F.count("*").alias("met"), F.max("reach").alias("reach"))
        state = waiting.join(told, ["conv_id", "id"], "left").select("conv_id", "id", "first", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"), F.greatest("before", "reach").alias("before"))
        state, level = save(state, "levels"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _wrong(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, at, schema, value), both JSON texts, to the distinct (conv_id, turn, at) whose value breaks its schema.

    One round for each depth of nesting: what a node's own schema says is checked, then its properties and items meet theirs."""
    key, found = ["conv_id", "turn", "at"], []
    tvf = rows.sparkSession.tvf
    patterns = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    while True:
        at = rows.select(*key, F.try_parse_json("schema").alias("s"), F.try_parse_json("value").alias("v"))
        at = at.withColumn("kind", F.schema_of_variant("v"))
        one, several = F.try_variant_get("s", "$.type", "string"), F.try_variant_get("s", "$.type", "array<string>")
        types = F.coalesce(several, F.when(one.isNotNull(), F.array(one)))
        typed = F.exists(types, lambda t: F.regexp_like("kind", F.concat(F.lit("^"), F.coalesce(patterns[t], F.lit(".*")), F.lit("$"))))
        named = F.map_keys(F.from_json(F.to_json("v"), "map<string, string>"))
        required = F.try_variant_get("s", "$.required", "array<string>")
        lacking = F.col("kind").startswith("OBJECT") & F.exists(required, lambda r: ~F.array_contains(named, r))
        listed = F.try_variant_get("s", "$.enum", "array<variant>")
        unlisted = listed.isNotNull() & ~F.exists(listed, lambda e: F.to_json(e).eqNullSafe(F.to_json(F.col("v"))))
        bad = ~F.coalesce(typed, F.lit(True)) | F.coalesce(lacking, F.lit(False)) | F.coalesce(unlisted, F.lit(False))
        found.append(save(at.where(bad).select(*key).distinct(), "wrong"))
        inner = at.withColumns({"properties": F.try_variant_get("s", "$.properties", "variant"), "items": F.try_variant_get("s", "$.items", "variant")})
        fields = inner.where("properties is not null and kind like 'OBJECT%'")
        fields = fields.lateralJoin(tvf.variant_explode(F.col("properties").outer()).select(F.col("key").alias("name"), F.to_json("value").alias("schema")))
        fields = fields.lateralJoin(tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("field"), F.to_json("value").alias("value"))).where("name = field")
        parts = inner.where("items is not null and kind like 'ARRAY%'").withColumn("schema", F.to_json("items")).lateralJoin(tvf.variant_explode(F.col("v").outer()).select(F.to_json("value").alias("value")))
        rows = save(fields.select(*key, "schema", "value").unionByName(parts.select(*key, "schema", "value")), "inner")
        if rows.isEmpty():
            out = found[0]
            for more in found[1:]:
                out = out.unionByName(more)
            return out.distinct()


def link(turns: DataFrame) -> DataFrame:
    """One row per event: conv_id, order_turn, level, step, turn, kind, id, status, valid, json."""
    rows = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    raw = rows.where((F.col("role") == "assistant") & F.contains("text", F.lit("<tool_call>"))).select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), 1)).alias("at", "raw"))
    calls = raw.withColumn("call", F.when(F.try_parse_json("raw").isNotNull(), F.from_json("raw", _CALL))).select("conv_id", "turn", "at", "raw", "call.*")
    calls = save(calls.withColumn("arguments", F.coalesce("arguments", F.lit("{}"))), "calls")
    named = calls.where("id is not null and name is not null")
    results = rows.where("role = 'tool'").withColumn("result", F.when(F.try_parse_json("text").isNotNull(), F.from_json("text", "tool_call_id string, content string")))
    results = results.select("conv_id", "turn", "text", F.col("result.tool_call_id").alias("id"))

    # A call's place: after what it depends on.
    levels = _levels(named)
    ids = named.groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"), F.count("*").alias("n")).join(levels, ["conv_id", "id"], "left")
    ids = save(ids.withColumn("reach", F.coalesce("reach", "call_turn")), "ids")
    answered = results.where("id is not null").groupBy("conv_id", "id").agg(F.count("*").alias("answers"))

    # Arguments against declared tools.
    tools = rows.where((F.col("role") == "system") & F.contains("text", F.lit("<tool>"))).select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(TOOL), 1)).alias("at", "raw"))
    tools = tools.withColumn("t", F.try_parse_json("raw")).select("conv_id", "turn", "at", F.try_variant_get("t", "$.name", "string").alias("name"), F.to_json(F.try_variant_get("t", "$.parameters", "variant")).alias("schema")).where("name is not null")
    tools = tools.groupBy("conv_id", "name").agg(F.min_by("schema", F.struct("turn", "at", "schema")).alias("schema"))
    declared = save(named.select("conv_id", "turn", "at", "name", "arguments").join(tools, ["conv_id", "name"]), "declared")
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.lit(False))
    wrong = _wrong(declared.select("conv_id", "turn", "at", F.coalesce("schema", F.lit("{}")).alias("schema"), F.col("arguments").alias("value")))
    checked = declared.select("conv_id", "turn", "at", whole.alias("whole")).join(wrong.withColumn("wrong", F.lit(True)), ["conv_id", "turn", "at"], "left")
    checked = checked.groupBy("conv_id", "turn", "at").agg(F.every(F.col("whole") & F.col("wrong").isNull()).alias("valid"))

    found = calls.join(ids, ["conv_id", "id"], "left").join(answered, ["conv_id", "id"], "left").join(checked, ["conv_id", "turn", "at"], "left")
    status = F.when(F.col("id").isNull() | F.col("name").isNull(), "malformed").when(F.col("n") > 1, "repeated").when(F.col("level").isNull(), "cyclic").when(F.col("answers").isNull(), "unanswered").otherwise("linked")
    out_call = found.select(
        "conv_id", F.greatest("turn", "before").alias("order_turn"), F.coalesce("level", F.lit(0)).alias("level"), (F.col("at") + 1).cast("long").alias("step"), "turn", F.lit("call").alias("kind"), "id", status.alias("status"), "valid",
        F.coalesce(F.when(F.col("id").isNotNull() & F.col("name").isNotNull(), canonical(F.to_json(F.struct(F.col("name"), F.col("id"), F.col("depends_on"), F.try_parse_json("arguments").alias("arguments"))))), canonical(F.to_json(F.struct(F.col("raw").alias("malformed"))))).alias("json"),
    )
    met = results.join(ids.select("conv_id", "id", "call_turn", "reach", F.col("level").alias("call_level")), ["conv_id", "id"], "left")
    out_result = met.select(
        "conv_id", F.greatest("turn", "reach").alias("order_turn"), F.coalesce("call_level", F.lit(0)).alias("level"), F.lit(1 << 40).alias("step"), "turn", F.lit("result").alias("kind"), "id",
        F.when(F.col("call_turn").isNull(), "orphan").otherwise("linked").alias("status"), F.lit(None).cast("boolean").alias("valid"),
        F.coalesce(canonical("text"), canonical(F.to_json(F.struct(F.col("text").alias("content"))))).alias("json"),
    )
    plain = rows.where("role <> 'tool'").select(
        "conv_id", F.col("turn").alias("order_turn"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("step"), "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit("message").alias("status"), F.lit(None).cast("boolean").alias("valid"),
        F.to_json(F.struct(F.trim(F.regexp_replace("text", CALL, "")).alias("content"), F.col("role"))).alias("json"),
    )
    return plain.unionByName(out_call).unionByName(out_result)


def op6_tool_call_linking(spark, sf_dir: str) -> DataFrame:
    from folio.llm.common import table

    return link(table(spark, sf_dir, "conversations"))


OP6_SQL = """
select conv_id, turn as order_turn, 0 as level, cast(0 as bigint) as step, turn, 'message' as kind, cast(null as varchar) as id,
       'message' as status, cast(null as boolean) as valid,
       '{"content":' || cast(to_json(trim(coalesce(text, ''), ' ')) as varchar) || ',"role":' || cast(to_json(coalesce(role, '')) as varchar) || '}' as json
from conversations where coalesce(role, '') <> 'tool'
"""
