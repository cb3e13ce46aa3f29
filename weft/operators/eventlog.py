"""Dialogues to a process-mining event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import prefix_sums, words

START, END = "START-DIALOGUE-SYTEM", "END-DIALOGUE-SYSTEM"  # fixed values, the first as it is spelt
MS_PER_WORD, MS_THINKING = 400, 1500


def agent(role: Column) -> Column:
    return F.when(role == "assistant", "ai").when(role == "user", "human").otherwise("other")


def timed(turns: DataFrame) -> DataFrame:
    """turns with words and clock: the simulated milliseconds from the dialogue's start to the end of the turn."""
    spent = words(F.col("text")) * MS_PER_WORD + MS_THINKING
    run = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("words", words(F.col("text"))).withColumn("clock", F.sum(spent).over(run))


def flatten(turns: DataFrame) -> DataFrame:
    """Messages with START and END events of every dialogue and event ids over all of them, in the order of dialogues."""
    t = timed(turns).select("conv_id", F.lit(1).alias("kind"), "turn", agent(F.col("role")).alias("agent"), "text", "clock")
    ends = t.groupBy("conv_id").agg(F.min("clock").alias("lo"), F.max("clock").alias("hi"), F.count(F.lit(1)).alias("n"))
    edge = lambda kind, text, clock: ends.select("conv_id", F.lit(kind).alias("kind"), F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("agent"), F.lit(text).alias("text"), clock.alias("clock"))
    rows = t.unionByName(edge(0, START, F.col("lo") - 1000)).unionByName(edge(2, END, F.col("hi")))
    base = prefix_sums(ends.select("conv_id", (F.col("n") + 2).alias("n")), "conv_id", "n")
    own = F.row_number().over(Window.partitionBy("conv_id").orderBy("kind", "turn")) - 1
    return rows.withColumn("own", own).join(base, "conv_id").withColumn("event_id", F.col("base") + F.col("own")).drop("own", "base")


def dialogue_events(messages: DataFrame) -> DataFrame:
    """The event rows of exported dialogues: case_id, event_id (over all, in the order of ord), speaker, text, at, resource, agent, activity.

    messages(ord, case_id, index, type, content, simulated_timestamp, banco_timestamp, sources). A dialogue's START is one second before its
    first time that isn't empty, and absent if it has none; END has the time of the last message, and is absent if that is empty.
    """
    own = F.when(F.col("type") == "ai", F.nullif("banco_timestamp", F.lit("")))
    at = F.coalesce(own, F.nullif("simulated_timestamp", F.lit("")))
    m = messages.select("ord", "case_id", F.lit(1).alias("kind"), "index", "type", F.coalesce("content", F.lit("")).alias("text"), at.alias("at"), F.coalesce(F.array_join("sources", ", "), F.lit("")).alias("resource"))
    first = F.coalesce(F.when(F.col("type") == "ai", F.nullif("banco_timestamp", F.lit(""))).otherwise(F.nullif("simulated_timestamp", F.lit(""))))
    firsts = messages.groupBy("ord", "case_id").agg(F.min_by(first, F.when(first.isNotNull(), F.col("index"))).alias("f"))
    ends = m.groupBy("ord", "case_id").agg(F.max_by("at", "index").alias("l"), F.count(F.lit(1)).alias("n")).join(firsts, ["ord", "case_id"])
    start = F.date_format(F.try_to_timestamp("f") - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss")
    edge = lambda rows, kind, text, time: rows.select("ord", "case_id", F.lit(kind).alias("kind"), F.lit(-1).alias("index"), F.lit("system").alias("type"), F.lit("").alias("text"), time.alias("at"), F.lit("").alias("resource"), F.lit(text).alias("activity"))
    rows = m.withColumn("activity", F.lit(None).cast("string")).unionByName(edge(ends.where("f IS NOT NULL"), 0, START, start)).unionByName(edge(ends.where("l IS NOT NULL"), 2, END, F.col("l")))
    sizes = ends.select("ord", (F.col("n") + F.col("f").isNotNull().cast("long") + F.col("l").isNotNull().cast("long")).alias("n"))
    place = F.row_number().over(Window.partitionBy("ord").orderBy("kind", "index")) - 1
    out = rows.withColumn("own", place).join(prefix_sums(sizes, "ord", "n"), "ord")
    speaker = F.when(F.col("type") == "system", "system").when(F.col("type") == "ai", "Bot").otherwise("Usuário")
    return out.select("case_id", (F.col("base") + F.col("own")).alias("event_id"), speaker.alias("speaker"), "text", "at", "resource", F.col("type").alias("agent"), "activity")


def touchpoint_prompt(actor: str, text: Column, touchpoints: list[str]) -> Column:
    """The prompt by which a model names one touchpoint of the catalog."""
    listed = "\n".join(f"- {t.upper()}" for t in touchpoints)
    head = f"Classifique a mensagem de um {actor.lower()} em um chatbot bancário com UM dos touchpoints da lista, em letras maiúsculas e sem explicações.\n\nMENSAGEM:\n{actor}: "
    return F.concat(F.lit(head), text, F.lit(f"\n\nTOUCHPOINTS DISPONÍVEIS:\n{listed}\n\nTOUCHPOINT:"))


def touchpoint_of(answer: Column, touchpoints: list[str]) -> Column:
    """The touchpoint that a model's answer names, without quotes and in any case; empty if the catalog has none such, or the model failed."""
    clean = F.upper(F.trim(F.translate(F.trim(answer), "\"'", "")))
    return F.when(clean.isin(*[t.upper() for t in touchpoints]), clean).otherwise("")


def classified(rows: DataFrame, bot: list[str], user: list[str], model) -> DataFrame:
    """dialogue_events with the activity that the model gives each distinct (case, speaker, text) once; system events keep theirs."""
    from weft.operators.ragflow import asked

    open_ = rows.where("agent <> 'system'").groupBy("case_id", "speaker", "text").agg(F.min("event_id").alias("first"))
    is_bot = F.col("speaker") == "Bot"
    prompt = F.when(is_bot, touchpoint_prompt("Bot", F.col("text"), bot)).otherwise(touchpoint_prompt("Usuário", F.col("text"), user))
    answers = asked(open_, model, "touchpoint", F.lit("touchpoint"), prompt, "_a")
    named = answers.select("case_id", "speaker", "text", F.when(is_bot, touchpoint_of(F.col("_a"), bot)).otherwise(touchpoint_of(F.col("_a"), user)).alias("_t"))
    return rows.join(named, ["case_id", "speaker", "text"], "left").withColumn("activity", F.coalesce("activity", "_t")).drop("_t")


def final_log(rows: DataFrame) -> DataFrame:
    """The seven columns of the event log: rows with an activity (an empty one counts) or of the system, each from the end of the one before it."""
    kept = rows.where(F.col("activity").isNotNull() | (F.col("agent") == "system"))
    before = F.lag("at").over(Window.partitionBy("case_id").orderBy("event_id"))
    start = F.when(F.col("agent") == "system", F.col("at")).otherwise(F.coalesce(before, F.col("at")))
    who = F.when(F.col("agent") == "system", "syst").otherwise(F.col("agent"))
    return kept.select(
        F.col("case_id").alias("CASE_ID"), F.col("event_id").alias("EVENT_ID"), F.col("activity").alias("ACTIVITY"), start.alias("START_TIMESTAMP"),
        F.col("at").alias("END_TIMESTAMP"), F.col("resource").alias("RECURSO"), who.alias("AGENTE"),
    )


def classify(rows: DataFrame, catalog: list[str]) -> DataFrame:
    """rows with activity: a rule's label, kept if the catalog has it, else empty; the first label of (case, agent, text) holds for all; events of the system are their own."""
    rule = F.when(F.col("text").contains("?"), "PERGUNTA").when(F.length("text") < 120, "RESPOSTA_CURTA").when(F.length("text") < 600, "RESPOSTA").otherwise("EXPLICACAO")
    label = F.when(rule.isin(catalog), rule).otherwise("")
    first = Window.partitionBy("conv_id", "agent", "text").orderBy("event_id")
    return rows.withColumn("activity", F.when(F.col("agent") == "system", F.col("text")).otherwise(F.first(label).over(first)))


def finish(rows: DataFrame) -> DataFrame:
    """Kept rows with the start of each event, the end of the one before it; system events start when they end."""
    kept = rows.where(F.col("activity").isNotNull() | (F.col("agent") == "system"))
    before = F.lag("clock").over(Window.partitionBy("conv_id").orderBy("event_id"))
    start = F.when(F.col("agent") == "system", F.col("clock")).otherwise(F.coalesce(before, F.col("clock")))
    who = F.when(F.col("agent") == "system", "syst").otherwise(F.col("agent"))
    return kept.select(F.col("conv_id").alias("case_id"), "event_id", "activity", start.alias("start_ms"), F.col("clock").alias("end_ms"), who.alias("agente"))


def case_summary(log: DataFrame, top: int = 10) -> DataFrame:
    real = F.col("agente") != "syst"
    by = log.groupBy("case_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(real).alias("real_events"), F.count_if(~real).alias("system_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    return by.orderBy(F.col("events").desc(), "case_id").limit(top)
