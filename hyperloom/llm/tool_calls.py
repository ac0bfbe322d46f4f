"""Chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON.

DataFrame functions only. Results join calls by identifier; each call may name the call that it follows, and
its place is the number of calls before it on that way, found by doubling the steps: a chain of n calls takes
log2(n) joins on identifiers, each of which is one row, so that a long conversation is dealt over all tasks.
Calls on a cycle, or behind one, never reach a first call and get no place. Arguments are checked against
their tool's schema as variants, and `to_json` of a variant writes the names of every object in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.shared import Tables

#: The names that Spark gives to the kinds of JSON values.
JSON_KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


@dataclass(frozen=True)
class Tool:
    """A tool's arguments: names and kinds (a key of JSON_KINDS) of those it needs, and of those it may have."""

    needs: dict[str, str]
    may_have: dict[str, str]


def _error(arguments: Column, parsed: Column, tool: Tool) -> Column:
    """What is wrong with arguments, null if nothing is; the first of: no object, unknown names, each name's kind."""
    known = {**tool.needs, **tool.may_have}
    kind = lambda name: F.schema_of_variant(F.try_variant_get(parsed, f"$['{name}']", "variant"))
    checks = [
        (parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object"),
        (F.size(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, known)).cast("array<string>"))) > 0, "unknown argument"),
    ]
    for name, of in known.items():
        absent = kind(name).isNull()
        right = reduce(lambda a, b: a | b, (kind(name).startswith(k) for k in JSON_KINDS[of]))
        checks += [(absent, f"{name}: missing")] if name in tool.needs else []
        checks.append((~absent & ~right, f"{name}: not {of}"))
    return F.coalesce(*(F.when(F.coalesce(wrong, F.lit(False)), F.lit(text)) for wrong, text in checks))


def places(calls: DataFrame, tables: Tables) -> DataFrame:
    """`id` and `place` of calls (`id`, `after`), ids distinct: the calls before each on its way from a first one.

    A call that names no call, or one that there is not, is a first one, with place 0. Calls without a place are
    on a cycle or behind one.
    """
    there = calls.select(F.col("id").alias("after"))
    first = calls.join(there.withColumn("real", F.lit(True)), "after", "left")
    ways = tables.write(first.select("id", F.when(F.col("real"), F.col("after")).alias("to"), F.when(F.col("real"), 1).otherwise(0).cast("long").alias("steps")))
    left = ways.where("to is not null").count()
    rounds = max(1, left).bit_length()
    for _ in range(rounds):
        if not left:
            break
        on = ways.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        old, ways = ways, tables.write(ways.join(on, "to", "left").select("id", F.col("further").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        tables.drop(old)
        left = ways.where("to is not null").count()
    return ways.where("to is null").select("id", F.col("steps").alias("place"))


def link_calls(calls: DataFrame, results: DataFrame, tools: dict[str, Tool]) -> DataFrame:
    """Every call with its result, its place, the verdict on its arguments and its message.

    `calls` has `id`, `after` (another call's id or null), `name` and `arguments` (JSON text); `results` has
    `id` and `content`; all text, other columns stay out. One row per row of `calls`:

    * `result`: the content of the result with the call's id. Of several the least content is taken, and a
      result that is there without content is the empty text. `answered` tells whether there is one.
    * `place`: see `places`; null for cycles, and for calls whose id is null or not theirs alone.
    * `error`: null for good calls, else what is wrong: the id, the tool's name or the arguments.
    * `message`: canonical JSON of name, id and arguments (null if they are no JSON) with the names of all
      objects in order, and with the result for answered calls.

    Empty tables give an empty result.
    """
    tables = Tables(calls.sparkSession)
    own = tables.write(calls.select(*(F.col(c).cast("string").alias(c) for c in ("id", "after", "name", "arguments"))))
    alone = own.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min("after").alias("after"))
    placed = places(alone.where("n = 1").select("id", "after"), tables)
    answers = results.where("id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.coalesce(F.min(F.col("content").cast("string")), F.lit("")).alias("result"))
    facts = alone.select("id", "n").join(placed, "id", "left").join(answers, "id", "left")
    parsed = F.try_parse_json("arguments")
    bad = F.when(F.col("id").isNull(), "id: missing").when(F.col("n") > 1, "id: not unique").when(~F.coalesce(F.col("name").isin(*tools), F.lit(False)), "name: unknown tool")
    wrong = reduce(lambda made, item: made.when(F.col("name") == item[0], _error(F.col("arguments"), parsed, item[1])), tools.items(), F.when(F.col("name").isNull(), F.lit(None).cast("string")))
    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))
    quoted = lambda c: F.when(F.col(c).isNull(), "null").otherwise(text(c))
    parts = [part("arguments", F.coalesce(F.to_json(parsed), F.lit("null"))), part("id", quoted("id")), part("name", quoted("name"))]
    message = F.concat(F.lit("{"), F.concat_ws(",", *parts, F.when(F.col("result").isNotNull(), part("result", quoted("result")))), F.lit("}"))
    joined = own.join(facts, "id", "left")
    return joined.select("id", "after", "name", F.col("result").isNotNull().alias("answered"), F.when(F.col("n") == 1, F.col("place")).alias("place"), F.coalesce(bad, wrong).alias("error"), message.alias("message"))


#: How conversation turns read as calls: what is said is the argument, and the next turn is the result.
TURN_TOOLS = {
    "user": Tool({"text": "string", "turn": "integer"}, {}),
    "system": Tool({"text": "string", "turn": "integer"}, {"level": "string"}),
}


def turns_as_calls(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations: a turn that is not the assistant's calls, and the assistant's next turn answers it.

    A call follows that of two turns before. Ids are conversation and turn; a row without either has none.
    """
    name = lambda n: F.concat_ws("/", F.when(F.col(conv).isNotNull() & F.col(turn).isNotNull(), F.col(conv).cast("string")), (F.col(turn).cast("long") + n).cast("string"))
    ident = lambda n: F.when(F.col(conv).isNotNull() & F.col(turn).isNotNull(), name(n))
    arguments = F.to_json(F.struct(F.col(turn).cast("long").alias("turn"), F.col(text).cast("string").alias("text")))
    said = F.coalesce(F.col(role).cast("string"), F.lit(""))
    calls = turns.where(said != "assistant").select(ident(0).alias("id"), ident(-2).alias("after"), F.col(role).cast("string").alias("name"), arguments.alias("arguments"))
    results = turns.where(said == "assistant").select(ident(-1).alias("id"), F.col(text).cast("string").alias("content"))
    return calls, results


def linked_turns(turns: DataFrame) -> DataFrame:
    """All calls of a table of conversations, linked, ordered, checked and serialised."""
    calls, results = turns_as_calls(turns)
    return link_calls(calls, results, TURN_TOOLS)
