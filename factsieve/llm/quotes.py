"""Quotation linking: conversations in reply order, without quotes.

Lines led by ``>`` are quotes; their number of marks is the nesting level. Runs of lines at one level are
passages. A passage is looked up by the hash of its normalised text (A-Z lower-cased, blanks collapsed):
first among what the same conversation said before, then among all messages. Both tables hold one
original per hash, the earliest, so a passage that thousands quote or say makes no pairs. Both know whole
messages and single lines; a passage of several lines that is neither is looked up once more among the
runs of consecutive lines that begin with its first line and have its number of lines. The original of
a message's first passage at level 1, if the conversation has it, is the message it replies to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from factsieve.llm.common import bounded, stage
from factsieve.operators import skew

MARKS = re.compile(r"^(?:[ \t]?>)+[ \t]?")
ATTRIBUTION = "wrote:"  # a line that ends so, right before a quote, belongs to the quote
PARSED = "conv long, turn long, role string, text string, own array<long>, lines array<long>, quotes array<struct<level:int,hash:long,lines:array<long>>>"


def normalised(text: str) -> bytes:
    return b" ".join(text.encode().lower().split())


def passage_hash(text: str) -> int | None:
    data = normalised(text)
    return int.from_bytes(xxhash.xxh3_64_digest(data), "big", signed=True) if data else None


def line_hashes(text: str) -> list[int]:
    """Of the lines that have words."""
    return [h for line in text.split("\n") if (h := passage_hash(line)) is not None]


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes and its quoted passages as (level, passage)."""
    own, passages = [], []
    for line in (text or "").split("\n"):
        if not (mark := MARKS.match(line)):
            own.append(line)
            passages.append(None)
            continue
        if own and own[-1].rstrip().endswith(ATTRIBUTION) and passages[-1] is None:
            own.pop()
        level, rest = mark[0].count(">"), line[mark.end():]
        if passages and passages[-1] and passages[-1][0] == level:
            passages[-1][1].append(rest)
        else:
            passages.append((level, [rest]))
    return "\n".join(own).strip(" \t\n\v\f\r"), [(p[0], "\n".join(p[1])) for p in passages if p]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            own, quotes = parse(text)
            units = {h for part in [own, *own.split("\n")] if (h := passage_hash(part)) is not None}
            rows.append((own, sorted(units), line_hashes(own), [
                {"level": n, "hash": h, "lines": line_hashes(p)} for n, p in quotes if (h := passage_hash(p)) is not None]))
        out = batch[["conv", "turn", "role"]].copy()
        out[["text", "own", "lines", "quotes"]] = pd.DataFrame(rows, columns=["text", "own", "lines", "quotes"], index=out.index)
        yield out


def said_runs(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv, turn, hash): the first turn of every conversation that says a wanted passage as a run of lines.

    ``wanted`` has hash and lines. Runs are spelled out for the distinct lengths of wanted passages with
    the same first line, whatever the number of passages, and looked up by their own hash.
    """
    lengths = wanted.groupBy(F.element_at("lines", 1).alias("line")).agg(F.collect_set(F.size("lines")).alias("lengths"))
    lines = parsed.select("id", F.posexplode("lines").alias("at", "line"))
    counts = lines.groupBy("line").agg(F.count(F.lit(1)).alias("_n"))
    begun = skew.attach(lines, stage(lengths.join(counts, "line"), "run-lengths"), ["line"], F.struct("id", "at"), F.col("_n"), {"lengths": "lengths"})
    begun = begun.filter("lengths IS NOT NULL").groupBy("id").agg(F.collect_list(F.struct("at", "lengths")).alias("begun"))
    run = parsed.select("id", "conv", "turn", "lines").join(begun, "id").withColumn("b", F.explode("begun")).withColumn(
        "n", F.explode("b.lengths")).filter(F.col("b.at") + F.col("n") <= F.size("lines")).select(
        "conv", "turn", F.xxhash64(F.slice("lines", F.col("b.at") + 1, F.col("n"))).alias("run"))
    runs = stage(run.groupBy("conv", "run").agg(F.min("turn").alias("turn")), "runs")
    names = wanted.groupBy(F.xxhash64("lines").alias("run")).agg(F.min("hash").alias("hash"))
    known = stage(names.join(runs.groupBy("run").agg(F.count(F.lit(1)).alias("_n")), "run"), "run-names")
    return skew.attach(runs, known, ["run"], F.struct("conv", "turn"), F.col("_n"), {"hash": "hash"}).filter(
        "hash IS NOT NULL").select("conv", "turn", "hash")


def link_passages(parsed: DataFrame) -> DataFrame:
    """(conv, turn, place, level, hash, here, elsewhere): the originals of every quoted passage.

    ``here`` is the first turn of the conversation that says it, if it came before; ``elsewhere`` the
    least (conv, turn) of all messages that say it, if ``here`` is null. Messages and lines that are the
    passage come before runs of lines.
    """
    quotes = parsed.select("conv", "turn", F.posexplode("quotes").alias("place", "q")).select(
        "conv", "turn", "place", F.col("q.level").alias("level"), F.col("q.hash").alias("hash"), F.col("q.lines").alias("lines"))
    linked = _attached(quotes, parsed.select("conv", "turn", F.explode("own").alias("hash")), "here", "elsewhere")
    linked = stage(linked, "links")
    wanted = linked.filter("here IS NULL AND size(lines) > 1").select("hash", "lines")
    if wanted.limit(1).count():
        linked = _attached(linked, stage(said_runs(parsed, stage(wanted.distinct(), "wanted")), "said-runs"), "_here", "_elsewhere")
        linked = linked.withColumns({"here": F.coalesce("here", "_here"), "elsewhere": F.coalesce("elsewhere", "_elsewhere")})
    return linked.select("conv", "turn", "place", "level", "hash", "here",
                         F.when(F.col("here").isNull(), F.col("elsewhere")).alias("elsewhere"))


def _attached(quotes: DataFrame, said: DataFrame, here: str, elsewhere: str) -> DataFrame:
    """The originals of quotes in (conv, turn, hash) rows."""
    inside = said.groupBy("conv", "hash").agg(F.min("turn").alias("_turn"), F.count(F.lit(1)).alias("_n"))
    anywhere = said.groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    spread = F.struct("conv", "turn", "place")
    linked = skew.attach(quotes, inside, ["conv", "hash"], spread, F.col("_n"), {"_turn": here})
    linked = linked.withColumn(here, F.when(F.col(here) < F.col("turn"), F.col(here)))
    return skew.attach(linked, anywhere, ["hash"], spread, F.col("_n"), {"_first": elsewhere})


def _paths(parents: DataFrame) -> DataFrame:
    """(conv, turn, path) for (conv, turn, parent), each turn once: the turns from the first message of the
    thread to the message. Every round doubles how far up a path reaches, so rounds are few."""
    now = stage(parents.select("conv", "turn", F.col("parent").alias("up"), F.array("turn").alias("path")), "paths")
    while now.filter("up IS NOT NULL").limit(1).count():
        above = now.select(F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        now = stage(now.join(above, (F.col("conv") == F.col("_conv")) & (F.col("up") == F.col("_turn")), "left").select(
            "conv", "turn", F.col("_up").alias("up"), F.concat(F.coalesce("_path", F.array().cast("array<bigint>")), "path").alias("path")), "paths")
    return now.select("conv", "turn", "path")


def _positions(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``position``, 0 up within ``key``. Ranges of (key, order) are numbered on their own, so a key of
    any size is spread; only keys that cross a range need the rows of the ranges before."""
    ranged = stage(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ordered")
    counts = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    crossing = stage(counts.withColumn("_before", F.sum("_n").over(before)).filter("_before IS NOT NULL").select(
        F.col(key).alias("_key"), F.col("_range").alias("_r"), "_before"), "crossing")
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(
        bounded(crossing), (F.col(key) == F.col("_key")) & (F.col("_range") == F.col("_r")), "left").withColumn(
        "position", (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_range", "_inside", "_key", "_r", "_before")


def thread(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position, turn, role, text, parent_turn, depth, n_quotes, n_linked: one row per message.

    Positions follow the replies: a message comes after the one it replies to and before later messages of
    other threads; replies to one message stand by turn. Messages that quote nothing from their conversation
    start threads. ``n_linked`` counts passages with an original anywhere. Null and empty texts quote and
    are nothing; passages without words are ignored. Repeated (conv_id, turn) rows are messages of their own
    with the earliest of their parents, in any order among each other. Rows with a null conv_id or turn have
    no position, parent or depth and are no originals. Other columns are not read.
    """
    rows = messages.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                           F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").alias("text"))
    parsed = stage(rows.mapInPandas(_parsed, PARSED).withColumn("id", F.monotonically_increasing_id()), "parsed")
    placed = parsed.filter("conv IS NOT NULL AND turn IS NOT NULL")
    links = link_passages(placed)
    found = F.col("here").isNotNull() | F.col("elsewhere").isNotNull()
    replies = links.groupBy("conv", "turn").agg(
        F.min_by("here", F.when((F.col("level") == 1) & F.col("here").isNotNull(), F.col("place"))).alias("parent"),
        F.count_if(found).alias("n_linked"))
    threads = stage(placed.select("conv", "turn").distinct().join(replies, ["conv", "turn"], "left").select(
        "conv", "turn", "parent", F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "replies")
    paths = _paths(threads)
    known = threads.join(paths, ["conv", "turn"])
    ordered = _positions(placed.drop("own", "lines", "id").join(known, ["conv", "turn"]), "conv", "path")

    def result(df: DataFrame, position: Column, parent: Column, depth: Column, linked: Column) -> DataFrame:
        return df.select(F.col("conv").alias("conv_id"), position.cast("long").alias("position"), "turn", "role", "text",
                         parent.cast("long").alias("parent_turn"), depth.cast("int").alias("depth"),
                         F.size("quotes").alias("n_quotes"), linked.cast("long").alias("n_linked"))

    none = F.lit(None)
    return result(ordered, F.col("position"), F.col("parent"), F.size("path") - 1, F.col("n_linked")).unionByName(
        result(parsed.filter("conv IS NULL OR turn IS NULL"), none, none, none, F.lit(0)))


# ---------------------------------------------------------------- messages that quote, from plain ones

def quoted(text: Column) -> Column:
    return F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))


def with_quotes(conversations: DataFrame) -> DataFrame:
    """Turns as mail: by (conv_id + turn) mod 4 a turn quotes nothing, the turn before, that one with the
    quote of the one before it, or only the one two before."""
    def earlier(n: int) -> DataFrame:
        return conversations.select(F.col("conv_id").alias(f"_c{n}"), (F.col("turn") + n).alias(f"_t{n}"),
                                    F.coalesce("text", F.lit("")).alias(f"_text{n}"), F.col("role").alias(f"_role{n}"))

    rows = conversations
    for n in (1, 2):
        rows = rows.join(earlier(n), (F.col("conv_id") == F.col(f"_c{n}")) & (F.col("turn") == F.col(f"_t{n}")), "left")
    rule, one, two = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)), F.col("_text1"), F.col("_text2")
    line = F.lit("\n")
    quote = F.when((rule == 1) | ((rule == 2) & two.isNull()), F.concat("_role1", F.lit(" wrote:\n"), quoted(one), line)).when(
        rule == 2, F.concat("_role1", F.lit(" wrote:\n"), quoted(F.concat(quoted(two), line, one)), line)).when(
        rule == 3, F.concat("_role2", F.lit(" wrote:\n"), quoted(two), line))
    return rows.select("conv_id", "turn", "role", F.concat(F.coalesce(quote, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
