"""Building a benchmark: plans, prompts, wide to long, alignment, chat records, template and bank rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinmark.operators.split import numbered


def plan(slots: DataFrame, difficulties: DataFrame) -> DataFrame:
    """Slots (task, category, ord, is_answerable) joined with as many shuffled difficulties (ord, difficulty)
    by place, with running ids for each task: {task}_{0001}."""
    rows = numbered(slots, ["ord"], "_at", ["task"]).withColumn("pair_id", F.format_string("%s_%04d", "task", "_at"))
    return rows.join(difficulties, "ord").select("pair_id", "task", "category", "difficulty", "is_answerable", "ord")


def item_id(pair: Column, language: Column) -> Column:
    return F.concat_ws("_", pair, language)


def to_long(wide: DataFrame, source: str = "en", target: str = "az") -> DataFrame:
    """Two benchmark rows of each wide row (source_question, source_answer, target_...), shared columns kept."""
    own = ["source_question", "source_answer", "target_question", "target_answer"]
    side = lambda lang, n: F.struct(F.lit(lang).alias("language"), F.col(f"{n}_question").alias("question"), F.col(f"{n}_answer").alias("reference_answer"))
    shared = [c for c in wide.columns if c not in own]
    rows = wide.select(*shared, F.explode(F.array(side(source, "source"), side(target, "target"))).alias("x")).select(*shared, "x.*")
    return rows.withColumn("item_id", item_id(F.col("pair_id"), F.col("language")))


def merge_content(plan_rows: DataFrame, content: DataFrame) -> DataFrame:
    """Plan and content by pair, in the plan's order; check operators.validate.aligned first."""
    return plan_rows.join(content, "pair_id").orderBy("ord")


def in_request_order(requests: DataFrame, content: DataFrame) -> DataFrame:
    """Generated content by pair, numbered and sorted as it was asked for."""
    return requests.select("pair_id", "ord").join(content, "pair_id").orderBy("ord")


def coverage(requests: DataFrame, content: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, key, requested, generated and coverage: how much of what was asked for came back."""
    from twinmark.operators.summaries import by_dimensions

    there = content.select("pair_id").distinct().withColumn("_there", F.lit(1))
    both = requests.join(there, "pair_id", "left")
    n, got = F.count(F.lit(1)), F.count("_there")
    return by_dimensions(both, {"overall": [], **{d: [d] for d in dimensions}}, [n.alias("requested"), got.alias("generated"), F.try_divide(got, n).alias("coverage")])


def prompts(requests: DataFrame, guidance: dict[str, dict[str, str]], template: str = "{task} {category} {difficulty}") -> DataFrame:
    """requests with instruction: the guidance of its task, category and difficulty put into a template."""
    def of(kind: str) -> Column:
        pairs = [x for k, v in guidance.get(kind, {}).items() for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.create_map(*pairs)[F.col(kind)], F.lit("")) if pairs else F.lit("")

    text: list[Column] = []
    rest = template
    while rest:
        head, sep, tail = rest.partition("{")
        if head:
            text.append(F.lit(head))
        if not sep:
            break
        name, _, rest = tail.partition("}")
        text.append(of(name))
    return requests.withColumn("instruction", F.concat(*text))


def chat(df: DataFrame, user: str, assistant: str) -> DataFrame:
    """df with messages: what the user asks and the assistant answers, as an array of role and content."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.withColumn("messages", F.array(say("user", user), say("assistant", assistant)))


#: Fixed value: what a model is told before a question.
SYSTEM = "Answer the user's question accurately and concisely. Do not add unnecessary explanation."


def messages(question: Column, system: str | None = SYSTEM) -> Column:
    """What a chat model is given: the system's word, if there is one, then the question; null for a blank question."""
    if system is not None and not system.strip():
        raise ValueError("the system's word is blank")
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    both = F.array(*([say("system", F.lit(system))] if system is not None else []), say("user", question))
    return F.when(question.rlike(r"(?U)\S"), both)


def generation_arguments(config: dict, pad_token_id: int | None = None, eos_token_id: int | None = None) -> dict:
    """What generation is called with: the temperature only where it samples, token ids only where there are any."""
    out = {"max_new_tokens": config["max_new_tokens"], "do_sample": config["do_sample"]}
    if config["do_sample"]:
        out["temperature"] = config["temperature"]
    return out | {k: v for k, v in (("pad_token_id", pad_token_id), ("eos_token_id", eos_token_id)) if v is not None}


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: each user turn with the assistant turn right after it. Turns are numbered by
    ranges and meet the number before theirs, so one conversation may fill many tasks."""
    rows = numbered(conversations.select("conv_id", "turn", "role", "text"), ["conv_id", "turn"], "_at")
    asked = rows.where("role = 'user'").select("_at", "conv_id", "turn", F.col("text").alias("question"))
    told = rows.where("role = 'assistant'").select((F.col("_at") - 1).alias("_at"), F.col("conv_id").alias("_conv"), F.col("text").alias("answer"))
    return asked.join(told, "_at").where(F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "turn", "question", "answer")


def templates(counts: DataFrame, bank: DataFrame, most: int = 100_000) -> DataFrame:
    """As many rows of each category as counted (category, count), with the templates of the bank
    (category, slot from 0, text) taken in turn. The bank is written by hand: its size is checked."""
    if bank.count() > most:
        raise ValueError("the bank is larger than a bank")
    slots = bank.groupBy("category").agg(F.count(F.lit(1)).alias("slots"))
    rows = counts.join(F.broadcast(slots), "category").where("count > 0").select("category", "slots", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("index"))
    rows = rows.withColumn("slot", (F.col("index") % F.col("slots")).cast("int"))
    return rows.join(F.broadcast(bank), ["category", "slot"]).select("category", "index", "text")


def from_bank(requests: DataFrame, bank: DataFrame) -> DataFrame:
    """Requests (task, index from 1) with the bank's entry (task, index, ...); missing is true past its end."""
    return requests.join(bank.withColumn("_there", F.lit(True)), ["task", "index"], "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def by_language(df: DataFrame, fields: dict[str, dict[str, str]], language: str = "language") -> DataFrame:
    """df with columns taken from the one that a row's language has for them: {"question": {"en": "question_en", ...}}."""
    def pick(own: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for lang, column in own.items():
            out = F.when(F.col(language) == lang, F.col(column)).otherwise(out)
        return out

    return df.withColumns({name: pick(own) for name, own in fields.items()})
