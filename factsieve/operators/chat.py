"""Chat rendering, loss masking, length statistics and padding.

Rendered turns end in a newline and tokens are whitespace-separated words, so no token
spans two turns: a conversation is rendered and tokenised turn by turn, in parallel, and a
conversation of any length never has to fit in one row. Records of our own corpus (two
turns) use the array form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factsieve import settings
from factsieve.functions.hashing import hash32
from factsieve.functions.hooks import word_ids
from factsieve.functions.text import WHITESPACE_CLASS, WORD_CLASS
from factsieve.operators.ranking import index_quantiles

OPEN, CLOSE = settings.TURN_OPEN, settings.TURN_CLOSE
SYSTEM_SEGMENT = f"{OPEN}system\n{settings.DEFAULT_SYSTEM}{CLOSE}\n"
GENERATION = f"{OPEN}assistant\n"
LONG_TEXT = 8_192  # characters from which a text is cut to the words that count before it goes to Python


def segment(role: Column, content: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), content, F.lit(f"{CLOSE}\n"))


def render_messages(messages: Column, generation_prompt: bool = False) -> Column:
    """Whole rendered text of a ``messages`` array column."""
    body = F.array_join(F.transform(messages, lambda m: segment(m["role"], m["content"])), "")
    lead = F.when(F.get(messages, F.lit(0))["role"] == "system", "").otherwise(SYSTEM_SEGMENT)
    return F.concat(lead, body, F.lit(GENERATION if generation_prompt else ""))


def render_turns(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> rendered segments in turn order.

    The default system segment gets turn -1 where the first turn is not a system turn. The
    text of a conversation is the concatenation of its segments by turn.
    """
    first = turns.groupBy("conv_id").agg(F.min_by("role", "turn").alias("_first"))
    lead = first.filter(F.col("_first") != "system").select(
        "conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"),
        F.lit(SYSTEM_SEGMENT).alias("segment"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role",
                        segment(F.col("role"), F.col("text")).alias("segment")).unionByName(lead)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD_CLASS})"), F.lit(1))


def masked_labels(ids: Column, prompt_tokens: Column) -> Column:
    """Ids with the first ``prompt_tokens`` of them replaced by -100."""
    masked = F.least(prompt_tokens, F.size(ids))
    return F.concat(F.array_repeat(F.lit(settings.MASKED_LABEL).cast("long"), masked),
                    F.slice(ids, masked + 1, F.size(ids) - masked))


def tokenize_records(examples: DataFrame, max_length: int = settings.MAX_TOKENS) -> DataFrame:
    """Token rows (input_ids, attention_mask, labels) of records with a ``messages`` array.

    Labels are the ids of the last turn's content, -100 before it; the prompt ends in a
    newline, so its word count is the mask boundary. Words are numbered in Python by the Arrow batch, as a worker
    remembers the numbers of words it has met. Records of fewer than two messages or
    not ending in an assistant turn are left out, as they have nothing to learn from.
    """
    messages = F.col("messages")
    usable = (F.size(messages) >= 2) & (F.element_at(messages, -1)["role"] == "assistant")
    system = SYSTEM_SEGMENT.split()
    own_system = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    whole = ~F.exists(messages, lambda m: m["role"].isNull() | m["content"].isNull())

    def text(some: Column) -> Column:
        return F.when(whole, F.array_join(F.transform(some, lambda m: segment(m["role"], m["content"])), ""))

    def short(name: str) -> Column:
        # of a text far too long, a list of many names, only the words that count are kept
        head = F.array_join(F.slice(F.split(name, WHITESPACE_CLASS, max_length + 2), 1, max_length + 1), " ")
        return F.when(F.length(name) > LONG_TEXT, head).otherwise(F.col(name))

    before = F.slice(messages, 1, F.size(messages) - 1)
    lead = F.when(F.col("_own"), F.array().cast("array<bigint>")).otherwise(F.array(*[hash32(F.lit(w)) for w in system]))
    return (
        examples.filter(usable)
        .select("record_id", own_system.alias("_own"), text(before).alias("_before"), text(F.slice(messages, -1, 1)).alias("_last"))
        .select("record_id", "_own", word_ids(short("_before"), short("_last"), max_length).alias("_t"))
        # the prompt also holds the opening word of the last turn
        .select("record_id", F.slice(F.concat(lead, "_t.ids"), 1, max_length).alias("input_ids"),
                (F.col("_t.n_prompt") + 1 + F.when(F.col("_own"), 0).otherwise(len(system))).alias("_prompt"))
        .select("record_id", "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"),
                masked_labels(F.col("input_ids"), F.col("_prompt")).alias("labels"))
    )


def mask_with_offsets(ids: Column, starts: Column, prompt_length: Column, max_length: int) -> Column:
    """Labels for a real tokenizer's (ids, start offsets): mask tokens starting inside the prompt."""
    return F.slice(F.zip_with(ids, starts, lambda i, s: F.when(
        s < prompt_length, F.lit(settings.MASKED_LABEL).cast("long")).otherwise(i)), 1, max_length)


def conversation_lengths(turns: DataFrame) -> DataFrame:
    """Per conversation: words in all, words of the prompt, turns, last role, status."""
    turn_words = F.size(words(segment(F.col("role"), F.col("text"))))
    last = F.struct("turn", "role")
    per = turns.withColumn("_w", turn_words).groupBy("conv_id").agg(
        F.sum("_w").alias("_words"), F.max_by("_w", "turn").alias("_last_words"), F.max(last).alias("_last"),
        F.min_by("role", "turn").alias("_first"), F.count(F.lit(1)).alias("n_turns"))
    lead = F.when(F.col("_first") == "system", 0).otherwise(F.lit(len(SYSTEM_SEGMENT.split())))
    status = F.when(F.col("n_turns") < 2, "too_short").when(
        F.col("_last.role") != "assistant", "invalid_last_role").otherwise("ok")
    # the prompt also holds the opening word of the last turn
    return per.select(
        "conv_id", "n_turns", F.col("_last.turn").alias("last_turn"), status.alias("status"),
        (F.col("_words") + lead).alias("n_tokens"),
        (F.col("_words") + lead - F.col("_last_words") + 1).alias("n_prompt_tokens"))


def tokenize_and_mask(turns: DataFrame, max_length: int = settings.MAX_TOKENS) -> DataFrame:
    """Token rows of conversations given as turns, truncated to ``max_length``.

    Every rendered turn has at least one word, so the first ``max_length`` turns are enough;
    the ranking filter prunes the rest before the shuffle.
    """
    segments = render_turns(turns)
    order = Window.partitionBy("conv_id").orderBy("turn")
    head = (
        segments.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max_length)
        .withColumn("_ids", F.transform(F.slice(words(F.col("segment")), 1, max_length), hash32))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "_ids"))).alias("_t"))
        .select("conv_id", F.slice(F.flatten(F.col("_t._ids")), 1, max_length).alias("input_ids"))
    )
    shape = conversation_lengths(turns).filter(F.col("status") == "ok")
    return head.join(shape, "conv_id").select(
        "conv_id", "n_tokens", "n_prompt_tokens", "input_ids",
        F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"),
        masked_labels(F.col("input_ids"), F.col("n_prompt_tokens").cast("int")).alias("labels"))


def length_stats(lengths: DataFrame, column: str = "n_tokens", max_length: int = settings.MAX_TOKENS) -> DataFrame:
    """n, p50, p90, p99, max by floor index, zeros when empty, and the over-length warning."""
    n = F.col("n")

    def at(p: float) -> Column:
        return F.least(n, F.floor(n * F.lit(p)) + 1)

    stats = index_quantiles(lengths, [], column, {"p50": at(0.5), "p90": at(0.9), "p99": at(0.99), "max": n})
    return stats.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "p50", "p90", "p99", "max")]).withColumn(
        "too_long", F.col("p99") > max_length)


def pad_batches(rows: DataFrame, batch: str = "batch_id", pad_id: int = 0) -> DataFrame:
    """Pad the three arrays to the longest row of their batch (a batch is a few rows)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))

    def pad(column: str, value) -> Column:
        missing = F.col("_longest") - F.size(column)
        return F.concat(column, F.array_repeat(value, missing)).alias(column)

    others = [c for c in rows.columns if c not in ("input_ids", "attention_mask", "labels")]
    return rows.withColumn("_longest", longest).select(
        *others, pad("input_ids", F.lit(pad_id).cast("long")), pad("attention_mask", F.lit(0)),
        pad("labels", F.lit(settings.MASKED_LABEL).cast("long")))
