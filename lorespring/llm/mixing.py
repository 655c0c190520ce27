"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of every source are cut into shards (documents by a seeded hash). Blocks of BLOCK
words are the seats, the shards are the parties, and a shard's votes are its part of its
source's target: each seat goes to the highest quotient votes / (2 * seats + 1). The integer
quotas say how many blocks each shard gives. In a shard the documents stand in a seeded order
on a ring of words; a quota takes whole rounds of the ring and then a run of blocks from a
seeded start, so every word is taken a number of times that differs by one at most, and never
more than twice.

Targets: source k (in the order of code points, null last) weighs WEIGHTS[k mod 3], all
share SHARE times all words, none gets more than CAP times its own words; what it would
get beyond is shared again by weight.

There may be any number of sources and shards: up to LOCAL_ROWS of them the driver finds the
level of the targets and the divisor of the seats, beyond that aggregations do. The mix
itself is a map over the documents: of a shard it needs the rounds, the two ranges of its order
that are taken once more and the documents that are taken in part (three at most), which is
broadcast up to BROADCAST_ROWS shards and joined by shuffle beyond.

Cases: null text has size 0 and takes 0; a null source is a source of its own; documents
without words and sources of size 0 have target 0 or take nothing; an empty table gives no
rows; repeated rows (equal doc_id too) are documents of their own, told apart by file and
place. A doc_id that has over HOT_ROWS rows is spread over shards by place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ._spark import located, mark, written

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
BLOCK = 16
#: Words of a shard, more where there would be over MOST_SHARDS besides one a source; rows of a table that is broadcast; rows of one that the driver works on; rows of a doc_id that are spread.
SHARD_WORDS, MOST_SHARDS, BROADCAST_ROWS, LOCAL_ROWS, HOT_ROWS = 1 << 20, 1 << 16, 1 << 17, 1 << 20, 1 << 14
_WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with __rank from 0 on, without gathering it: ranges of the order, and the counts of the ranges before."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranges = written(ranges.withColumns({"__part": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at"), "ranges")
    counts = ranges.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(W.Window.orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    # one row a partition
    return ranges.join(F.broadcast(before), "__part").withColumn("__rank", F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def water_level(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, cap: float = CAP) -> float:
    """The level at which min(cap * size, level * weight) add up to share * sum(sizes). It rises from what it would be without the cap, as sources meet theirs."""
    level, before, some = 0.0, None, sizes > 0
    while level != before:
        before = level
        over = some & (level * weights >= cap * sizes)
        if not (rest := weights[some & ~over].sum()):
            break
        level = float(share * sizes.sum() - cap * sizes[over].sum()) / float(rest)
    return level


def water_level_of(known: DataFrame, share: float = SHARE, cap: float = CAP) -> float:
    """water_level() of a table (source_size, weight), by one aggregation a step."""
    total, level, before, some = known.agg(F.sum("source_size")).first()[0] or 0, 0.0, None, F.col("source_size") > 0
    while level != before:
        before = level
        over = some & (F.lit(level) * F.col("weight") >= cap * F.col("source_size"))
        full, rest = known.agg(F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(some & ~over, F.col("weight")))).first()
        if not rest:
            break
        level = (share * total - cap * (full or 0)) / rest
    return level


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size) with weight and target."""
    sources = written(sources, "sources")
    if sources.count() <= LOCAL_ROWS:
        table = sources.toArrow()
        names, sizes = table.column("source").to_pylist(), table.column("source_size").to_numpy()
        order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
        weights = np.array(WEIGHTS)[np.arange(len(names)) % len(WEIGHTS)]
        level = water_level(sizes[order], weights, share, cap)
        known = sources.sparkSession.createDataFrame([(names[i], int(sizes[i]), int(w)) for i, w in zip(order, weights)], "source string, source_size long, weight int")
    else:
        weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("__rank") % len(WEIGHTS) + 1).cast("int"))
        known = written(ranked(sources, F.col("source").isNull(), F.col("source")).withColumn("weight", weight).drop("__rank"), "ranked")
        level = water_level_of(known, share, cap)
    return known.withColumn("target", F.when(F.col("source_size") > 0, F.least(cap * F.col("source_size"), F.lit(level) * F.col("weight"))).otherwise(0.0))


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / 1, 3, 5 ...; of equal quotients the earlier party's comes first."""
    quotas = np.zeros(len(votes), np.int64)
    total = votes.sum()
    if seats <= 0 or total <= 0:
        return quotas
    # every party surely gets what it would at a slightly larger divisor; the rest is dealt by quotients
    low, high = 0.0, 4 * total / seats + votes.max()
    for _ in range(200):
        middle = (low + high) / 2
        if np.floor(votes / (2 * middle) + 0.5).sum() > seats:
            low = middle
        else:
            high = middle
    quotas = np.floor(votes / (2 * high) + 0.5).astype(np.int64)
    # what is left are seats whose quotients are equal, one a party
    quotas[np.argsort(-votes / (2 * quotas + 1), kind="stable")[: seats - int(quotas.sum())]] += 1
    return quotas


def sainte_lague_of(parties: DataFrame, seats: int) -> DataFrame:
    """sainte_lague() of a table (source, shard, votes): the divisor is found by passes that try 64 each."""
    got = lambda d: F.floor(F.col("votes") / (2 * F.lit(d)) + 0.5).cast("long")
    total, most = parties.agg(F.sum("votes"), F.max("votes")).first()
    if not total or seats <= 0:
        return parties.withColumn("seats", F.lit(0).cast("long"))
    low, high, have = 0.0, 4 * total / seats + most, 0
    for _ in range(12):
        tries = sorted({x for k in range(1, 64) if low < (x := low + (high - low) * k / 64) < high})
        if have == seats or not tries:
            break
        tried = parties.select(F.explode(F.array(*map(F.lit, tries))).alias("d"), "votes").groupBy("d").agg(F.sum(F.floor(F.col("votes") / (2 * F.col("d")) + 0.5).cast("long")).alias("n"))
        for d, n in sorted(tuple(r) for r in tried.collect()):
            if n > seats:
                low = d
            else:
                high, have = d, n
                break
    sure = parties.withColumn("seats", got(high))
    have = sure.agg(F.sum("seats")).first()[0]
    # what is left are seats whose quotients are equal, one a party
    more = written(sure.orderBy(F.desc(F.col("votes") / (2 * F.col("seats") + 1)), F.asc_nulls_last("source"), "shard").limit(seats - have).select(F.col("source").alias("__source"), F.col("shard").alias("__shard")), "seats")
    on = sure["source"].eqNullSafe(more["__source"]) & (sure["shard"] == more["__shard"])
    return sure.join(more, on, "left").withColumn("seats", F.col("seats") + F.col("__shard").isNotNull().cast("long")).drop("__source", "__shard")


def seated(parties: DataFrame, seats: int) -> DataFrame:
    """parties (source, shard, words, votes) with seats."""
    if parties.count() > LOCAL_ROWS:
        return sainte_lague_of(parties, seats)
    table = parties.toPandas()
    table = table.assign(null=table["source"].isna()).sort_values(["null", "source", "shard"], ignore_index=True).drop(columns="null")
    got = sainte_lague(table["votes"].to_numpy(), seats)
    rows = [(None if pd.isna(s) else s, int(k), int(w), float(v), int(n)) for s, k, w, v, n in zip(table["source"], table["shard"], table["words"], table["votes"], got)]
    return parties.sparkSession.createDataFrame(rows, "source string, shard long, words long, votes double, seats long")


def _ring(docs: DataFrame, seed: int) -> tuple[DataFrame, list[str], DataFrame, DataFrame | None, DataFrame, DataFrame]:
    """docs of located(), the names of its places, and tables: rows (file, row, doc_id, tag, hot, source, size), hot ids (None: there are none), sources (source, source_size, target, n_shards) and shards (source, shard, words, quota)."""
    placed, names = located(docs)
    rows = placed.select(F.col(names[0]).alias("file"), F.col(names[1]).alias("row"), "doc_id", F.xxhash64("text").alias("tag"), "source", n_words(F.col("text")).alias("size"))
    rows = written(rows, "mix")
    hot = written(rows.groupBy("doc_id").count().where(F.col("count") > HOT_ROWS).select("doc_id"), "hot")
    hot = None if hot.isEmpty() else hot
    rows = _marked(rows, hot)
    known = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    size, n, seats = known.agg(F.sum("source_size"), F.count("*"), F.sum("target")).first()
    per_shard = max(SHARD_WORDS, -(-(size or 0) // MOST_SHARDS))
    known = written(known.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_shard)).cast("long")), "targets")
    known = bounded(known, n)
    words = _sharded(rows.where("size > 0"), known, seed).groupBy("source", "shard", "target", "source_size").agg(F.sum("size").alias("words"))
    shards = written(words.select("source", "shard", "words", (F.col("target") * F.col("words") / F.col("source_size")).alias("votes")), "shards")
    quota = F.least(F.col("seats") * BLOCK, F.floor(CAP * F.col("words"))).cast("long")
    shards = written(seated(shards, round((seats or 0) / BLOCK)).select("source", "shard", "words", quota.alias("quota")), "quotas")
    return placed, names, rows, hot, known, shards


def _marked(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    return rows.withColumn("hot", F.lit(False)) if hot is None else mark(rows, [F.col("doc_id")], hot, [F.col("doc_id")], "hot")


def _sharded(rows: DataFrame, known: DataFrame, seed: int) -> DataFrame:
    """rows with what is known of their source, their shard and `key`, their place in the order of its ring."""
    k = known.withColumnRenamed("source", "__source")
    salt = F.when(F.col("hot"), F.col("row"))
    joined = rows.join(k, rows["source"].eqNullSafe(k["__source"])).drop("__source")
    return joined.withColumn("shard", F.pmod(F.xxhash64("doc_id", salt, F.lit(seed)), F.col("n_shards"))).withColumn("key", F.struct(F.xxhash64("doc_id", salt, F.lit(seed + 1)).alias("h"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("tag"), F.col("file"), F.col("row")))


def _taken(rows: DataFrame, known: DataFrame, shards: DataFrame, seed: int) -> DataFrame:
    """Every row with words and what of it is taken: `rounds` times the whole, and the words from `a` to `b` and from 0 to `c` once more."""
    q = shards.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "words", "quota")
    ring = _sharded(rows.where("size > 0"), known, seed)
    ring = ring.join(q, ring["source"].eqNullSafe(q["__source"]) & (ring["shard"] == q["__shard"])).drop("__source", "__shard")
    at = W.Window.partitionBy("source", "shard").orderBy("key").rowsBetween(W.Window.unboundedPreceding, 0)
    ring = ring.withColumns({"begin": F.sum("size").over(at) - F.col("size"), "rounds": F.expr("quota div words"), "rest": F.expr("quota % words"), "first": F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), F.col("words"))})
    cut = lambda x: F.greatest(F.lit(0), F.least(F.col("size"), x - F.col("begin")))
    end = F.col("first") + F.col("rest")
    return ring.withColumns({"a": cut(F.col("first")), "b": cut(F.least(end, F.col("words"))), "c": cut(F.greatest(F.lit(0), end - F.col("words")))})


def op4(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    _, _, rows, _, known, shards = _ring(docs, seed)
    taken = (F.col("rounds") * F.col("size") + (F.col("b") - F.col("a")) + F.col("c")).cast("long")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    k = known.withColumnRenamed("source", "__source")
    without = rows.where("size = 0").join(k, F.col("source").eqNullSafe(F.col("__source"))).withColumn("taken", F.lit(0).cast("long"))
    return _taken(rows, known, shards, seed).withColumn("taken", taken).select(*columns).unionByName(without.select(*columns))


def mixed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mix itself: docs with each row as often as whole rounds take it, and a row of its own for each part that is taken beside, with text and n_chars of that part. Columns are those of docs. Texts aren't shuffled."""
    columns = docs.columns
    placed, names, rows, hot, known, shards = _ring(docs, seed)
    taken = _taken(rows, known, shards, seed)
    full_1, full_2 = F.col("b") - F.col("a") == F.col("size"), F.col("c") == F.col("size")
    part = F.filter(F.array(F.struct("file", "row", "a", "b"), F.struct("file", "row", F.lit(0).cast("long").alias("a"), F.col("c").alias("b"))), lambda p: (p["b"] > p["a"]) & (p["b"] - p["a"] < F.col("size")))
    ends = lambda full: [f(F.when(full, F.col("key"))) for f in (F.min, F.max)]
    lows = [c.alias(x) for c, x in zip((*ends(full_1), *ends(full_2)), ("from_1", "to_1", "from_2", "to_2"))]
    # a few documents a shard are taken in part
    plan = taken.groupBy("source", "shard").agg(F.max("rounds").alias("rounds"), *lows, F.flatten(F.collect_list(F.when(F.size(part) > 0, part))).alias("parts"))
    plan = written(plan.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "rounds", "from_1", "to_1", "from_2", "to_2", "parts"), "mix-plan")
    plan = bounded(plan, plan.count())

    # docs as rows have them, beside their own columns
    own = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own")
    again = placed.select(own, F.col(names[0]).alias("file"), F.col(names[1]).alias("row"), "doc_id", F.xxhash64("text").alias("tag"), "source")
    ring = _sharded(_marked(again, hot), known, seed)
    ring = ring.join(plan, ring["source"].eqNullSafe(plan["__source"]) & (ring["shard"] == plan["__shard"]))
    within = lambda k: F.coalesce(F.col("key").between(F.col(f"from_{k}"), F.col(f"to_{k}")), F.lit(False)).cast("long")
    pieces = F.filter("parts", lambda p: (p["file"] == F.col("file")) & (p["row"] == F.col("row")))
    whole = F.array_repeat(F.struct(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b")), (F.col("rounds") + within(1) + within(2)).cast("int"))
    text = F.col("own.text")
    has_words = n_words(text) > 0
    out = ring.where(has_words).select("own", F.explode(F.concat(whole, F.transform(pieces, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))))).alias("p"))
    cut = F.when(F.col("p.a") < 0, text).otherwise(_words(text, F.col("p.a"), F.col("p.b")))
    made = {"text": cut}
    if "n_chars" in columns:
        made["n_chars"] = F.when(F.col("p.a") < 0, F.col("own.n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return out.select(*[made[c].alias(c) if c in made else F.col("own").getField(c).alias(c) for c in columns])


def _words(text: Column, a: Column, b: Column) -> Column:
    """The text from its word a to its word b - 1, with what stands between them."""
    each = F.regexp_extract_all(text, F.lit(f"{_WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    return F.regexp_replace(F.array_join(F.slice(each, (a + 1).cast("int"), (b - a).cast("int")), ""), "[\\x20\\x09-\\x0D]+$", "")
