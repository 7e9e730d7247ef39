"""Chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON.

Calls and results meet by a hash join on (conversation, call id).  A call may name a parent
call whose result it uses; depths and the latest turn along the chain are found by pointer
doubling, so the rounds grow with the logarithm of the longest chain.  A conversation is
never gathered: each message is one row with its place, from running sums over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .mixing import running

# Tools and their arguments, as name: (type, required).
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", True), "lang": ("string", False)},
    "annotate": {"text": ("string", True), "strict": ("boolean", True), "weight": ("number", False)},
}

_TYPES = {"string": ["STRING"], "boolean": ["BOOLEAN"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"],
          "array": ["ARRAY"], "object": ["OBJECT"]}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys, no blanks and plain numbers; null when it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def problems(name: Column, arguments: Column, schemas: dict) -> Column:
    """Sorted complaints about a call: unknown tool, no object, missing, mistyped or unknown arguments."""
    parsed = F.try_parse_json(arguments)
    kind = F.schema_of_variant(parsed)
    keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
    out = F.array(F.lit("tool:unknown"))
    for tool, fields in sorted(schemas.items()):
        said = []
        for field, (type_, required) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            shape = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
            if required:
                said.append(F.when(value.isNull() | F.is_variant_null(value), f"missing:{field}"))
            said.append(F.when(value.isNotNull() & ~F.is_variant_null(value) & ~shape.isin(_TYPES[type_]), f"type:{field}"))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, sorted(fields)))), lambda k: F.concat(F.lit("unknown:"), k))
        found = F.array_sort(F.concat(F.filter(F.array(*said), lambda x: x.isNotNull()), F.coalesce(extra, F.array().cast("array<string>"))))
        out = F.when(name == tool, found).otherwise(out)
    return F.when(parsed.isNull() | ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.array(F.lit("arguments:no object"))).otherwise(out)


def _chains(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, reach, cyclic) by pointer doubling over parents."""
    nodes = calls.select("conv_id", "call_id", "parent_id", F.greatest("turn", "result_turn").alias("reach"), "turn")
    parent = nodes.select("conv_id", F.col("call_id").alias("parent_id"), F.col("reach").alias("parent_reach"))
    state = stored(nodes.join(parent, ["conv_id", "parent_id"], "left")
                   .select("conv_id", "call_id", F.when(F.col("parent_reach").isNotNull(), F.col("parent_id")).alias("up"),
                           F.when(F.col("parent_reach").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
                           F.greatest("turn", "parent_reach").alias("reach")), "chains")
    count = state.count()
    for _ in range(max(1, count.bit_length() + 1)):
        if state.where("up is not null").isEmpty():
            break
        far = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("reach").alias("reach2"))
        state = stored(state.join(far, ["conv_id", "up"], "left")
                       .select("conv_id", "call_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
                               F.greatest("reach", "reach2").alias("reach")), "chains")
    return state.select("conv_id", "call_id", "depth", "reach", F.col("up").isNotNull().alias("cyclic"))


def format_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row for each message, call and result: (conv_id, position, turn, kind, call_id, status, json).

    messages(conv_id, turn, role, text), calls(conv_id, turn, call_id, parent_id, name,
    arguments) and results(conv_id, turn, call_id, content); other columns are ignored.

    position counts from 0 in each conversation: a message stands at its turn, a call not
    before its parent's result, a result after its call.  status of a call is its complaints
    joined by ';', or ok, with ';open' if no result came; of a repeated call id (all but the
    earliest by turn) duplicate; of a call on a parent cycle cycle; of a result linked or, with
    no call, orphan; a second result of a call is duplicate.  A parent that does not exist is
    no parent.  json is canonical; arguments that are no JSON are written as a string.  Rows
    without a conversation or call id are kept: null conversations count as one, a call
    without id is open, a result without id an orphan.  Empty tables give an empty table.
    """
    schemas = SCHEMAS if schemas is None else schemas
    # "~" cannot begin an encoded key, so null gets a place of its own.
    conv = F.when(F.col("conv_id").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    c = calls.select(conv.alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"),
                     F.col("parent_id").cast("string").alias("parent_id"), F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"))
    r = results.select(conv.alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"),
                       F.col("content").cast("string").alias("content"))
    m = messages.select(conv.alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    calls_ = stored(c.withColumn("_n", F.monotonically_increasing_id()), "calls")
    results_ = stored(r.withColumn("_n", F.monotonically_increasing_id()), "results")

    # The earliest call and result of an id are the ones that are linked.
    place = F.struct(F.col("turn").isNull(), "turn", "_n")
    first_call = calls_.where("call_id is not null").groupBy("conv", "call_id").agg(F.min(place).alias("p")).select("conv", "call_id", F.col("p._n").alias("_n"))
    first_result = results_.where("call_id is not null").groupBy("conv", "call_id").agg(F.min(place).alias("p")) \
        .select("conv", "call_id", F.col("p._n").alias("_rn"), F.col("p.turn").alias("result_turn"))
    heads = stored(calls_.join(first_call, ["conv", "call_id", "_n"]).join(first_result, ["conv", "call_id"], "left"), "heads")
    chains = _chains(heads.select(F.col("conv").alias("conv_id"), "call_id", "parent_id", "turn", "result_turn"))
    facts = heads.select("_n", "conv", "call_id", "_rn").join(chains.withColumnRenamed("conv_id", "conv"), ["conv", "call_id"]).drop("conv", "call_id")

    said = F.array_join(problems(F.col("name"), F.col("arguments"), schemas), ";")
    call_json = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), _text("arguments")),
                         F.lit(',"id":'), _text("call_id"), F.lit(',"name":'), _text("name"), F.lit(',"type":"call"}'))
    call_rows = (calls_.join(facts, "_n", "left")
                 .select("conv", "conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.coalesce("reach", "turn").alias("_at"), F.coalesce("depth", F.lit(0)).alias("_depth"), F.lit(1).alias("_step"),
                         F.when(F.col("call_id").isNotNull() & F.col("depth").isNull(), "duplicate").when(F.col("cyclic"), "cycle")
                         .otherwise(F.concat(F.when(said == "", "ok").otherwise(said), F.when(F.col("_rn").isNull(), ";open").otherwise(""))).alias("status"),
                         call_json.alias("json")))
    linked = facts.where("_rn is not null").select(F.col("_rn").alias("_n"), "reach", "depth", F.lit(True).alias("linked"))
    known = heads.select("conv", "call_id", F.lit(True).alias("called"))
    result_json = F.concat(F.lit('{"content":'), _text("content"), F.lit(',"id":'), _text("call_id"), F.lit(',"type":"result"}'))
    result_rows = (results_.join(linked, "_n", "left").join(known, ["conv", "call_id"], "left")
                   .select("conv", "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.greatest("turn", "reach").alias("_at"), F.coalesce("depth", F.lit(0)).alias("_depth"), F.lit(2).alias("_step"),
                           F.when(F.col("linked"), "linked").when(F.col("called"), "duplicate").otherwise("orphan").alias("status"), result_json.alias("json")))
    message_json = F.concat(F.lit('{"content":'), _text("text"), F.lit(',"role":'), _text("role"), F.lit(',"type":"message"}'))
    message_rows = m.select("conv", "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.col("turn").alias("_at"), F.lit(0).cast("long").alias("_depth"),
                            F.lit(0).alias("_step"), F.lit("ok").alias("status"), message_json.alias("json"))
    every = message_rows.unionByName(call_rows).unionByName(result_rows).withColumn("_one", F.lit(1)).withColumn("_late", F.col("_at").isNull())
    placed = running(every, "conv", ["_late", "_at", "_depth", "_step", "call_id", "json"], "_one", "position")
    return placed.select("conv_id", F.col("position").cast("long").alias("position"), "turn", "kind", "call_id", "status", "json")


def _text(name: str) -> Column:
    """A column as a JSON string, or null."""
    listed = F.to_json(F.array(F.col(name)))
    return listed.substr(F.lit(2), F.length(listed) - 2)
