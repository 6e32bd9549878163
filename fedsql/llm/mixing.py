"""Records of several sources combined to target shares of tokens.

1. Every document's tokens are counted.  A source's documents are laid end to
   end in the order of a pseudorandom number, and the tokens are packed into
   blocks of fixed length: block b of a source holds its tokens
   [b*L, (b+1)*L).  Places are running totals, taken over small buckets first
   and inside the buckets then, so no task sorts a source.
2. The mix has as many slots as the wanted tokens fill.  Output shards draw
   their sources' slot counts from a multinomial over the target shares; what
   a source cannot give within its cap goes, in shares, to those that can.
   The shares reported, and the sources reported short, are counted in the
   slots as drawn and joined to their blocks.
3. A source's slots are numbered through the shards.  Slot i takes block
   P(i mod B), where P is a keyed pseudorandom permutation of the source's B
   blocks that changes with each round i div B: within a round no block comes
   twice, and no source has more rounds than its cap.
4. Slots and blocks are joined by (source, block).

Sources are compared without regard to case and surrounding white space.
Documents without text, or whose source has no target, are in no mix.  A
null share or cap counts as zero; sources without documents stay in the
report.  Rows with one id are copies only if ``docs`` has them; the caller
removes those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fedsql.llm.tokens import counter
from fedsql.session import written

BLOCK = 2048
#: Documents of a source in one bucket of :func:`placed`, about; a bucket's running totals are one task's work.
BUCKET_DOCS = 50_000
#: Slots unrolled from one row of the plan at most.
PAGE = 65_536
#: Tokens that one batch of encoded documents holds, about.
HELD_TOKENS = 1_000_000
#: Output shards at most: the plan, one row for each shard and source, is drawn on the driver.
MOST_SHARDS = 10_000


def source_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


def token_counts(docs: DataFrame, vocabulary: str, ids: bool = False) -> DataFrame:
    """(doc_id, source, n_tokens) of documents with a source and a text; with ``ids``, the tokens too."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(vocabulary)
        for f in frames:
            if not ids:
                yield f[["doc_id", "source"]].assign(n_tokens=[c.count(t) for t in f["text"]])
                continue
            tokens, first, held = [], 0, 0
            for k, t in enumerate(f["text"], 1):
                tokens.append(np.array(c.encode(t), np.int32))
                held += len(tokens[-1])
                if held >= HELD_TOKENS or k == len(f):
                    yield f.iloc[first:k][["doc_id", "source"]].assign(n_tokens=[len(t) for t in tokens], tokens=tokens)
                    tokens, first, held = [], k, 0

    own = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text").filter("source is not null and source <> '' and text is not null and text <> ''")
    return own.mapInPandas(run, "doc_id bigint, source string, n_tokens bigint" + (", tokens array<int>" if ids else ""))


def placed(counts: DataFrame, seed: int = 0, buckets: int = 64) -> DataFrame:
    """``counts`` with ``start``: where each document's tokens begin in its source's stream."""
    keyed = counts.withColumn("r", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("r", F.lit(buckets)))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # at most `buckets` rows
    bases = totals.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "bucket").orderBy("r", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return keyed.join(bases.hint("merge"), ["source", "bucket"]).withColumn("start", start).select(*counts.columns, "start")


def blocks(places: DataFrame, length: int = BLOCK) -> DataFrame:
    """(source, block, doc_id, at, from_token, n_tokens): the parts of documents that fill each block, and where in it.

    Where ``places`` has ``tokens``, each part has its own.
    """
    end = F.col("start") + F.col("n_tokens")
    parts = (
        places.filter("n_tokens > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length))))
        .withColumn("at", F.greatest(F.col("start") - F.col("block") * length, F.lit(0)))
        .withColumn("from_token", F.greatest(F.col("block") * length - F.col("start"), F.lit(0)))
        .withColumn("n_tokens", F.least(end, (F.col("block") + 1) * length) - F.greatest("start", F.col("block") * length))
    )
    own = [F.slice("tokens", (F.col("from_token") + 1).cast("int"), F.col("n_tokens").cast("int")).alias("tokens")] if "tokens" in places.columns else []
    return parts.select("source", "block", "doc_id", "at", "from_token", "n_tokens", *own)


@dataclass(frozen=True)
class Source:
    name: str
    share: float
    cap: int
    tokens: int

    def blocks(self, length: int) -> int:
        return -(-self.tokens // length)


def quotas(sources: list[Source], slots: int, size: int, length: int = BLOCK) -> dict[str, float]:
    """Each source's expected slots: its share, or its cap and the rest in shares among those below theirs.

    A source whose tokens times its cap are fewer than its share of ``size`` always gives all it has.
    """
    most = {s.name: s.cap * s.blocks(length) for s in sources}
    free, left, out = [s for s in sources if most[s.name] and s.share > 0], float(slots), {s.name: 0.0 for s in sources}
    while free and left > 1e-9:
        weight = sum(s.share for s in free)
        full = [s for s in free if left * s.share / weight >= most[s.name] or s.tokens * s.cap < s.share * size]
        for s in full or free:
            out[s.name] = float(most[s.name]) if full else left * s.share / weight
        if not full:
            break
        left -= sum(most[s.name] for s in full)
        free = [s for s in free if s not in full]
    return out


def _spread(rng: np.random.Generator, n: int, room: np.ndarray) -> np.ndarray:
    """``n`` items drawn into places by their room, never more in one than it has."""
    out = np.zeros_like(room)
    while n:
        left = room - out
        got = np.minimum(rng.multinomial(n, left / left.sum()), left)
        out += got
        n -= int(got.sum())
    return out


def draw(sources: list[Source], slots: int, shards: int, size: int, seed: int = 0, length: int = BLOCK) -> np.ndarray:
    """Slots of each output shard (rows) and source (columns).

    Each shard's counts are a multinomial draw over the expected slots.  A source that gives all it has, or would
    have to give more, is then set to its cap: the slots too many or too few are taken from, and given to, shards at
    random, so that the shards' sizes stay.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    want = quotas(sources, slots, size, length)
    expected = np.array([want[s.name] for s in sources])
    most = np.array([s.cap * s.blocks(length) if s.share > 0 else 0 for s in sources], np.int64)
    full = (expected >= most) & (most > 0)
    slots = int(max(min(slots, most.sum()), most[full].sum()))  # last blocks that are short may make some more
    sizes = np.full(shards, slots // shards, np.int64)
    sizes[: slots % shards] += 1
    if not slots:
        return np.zeros((shards, len(sources)), np.int64)
    counts = rng.multinomial(sizes, expected / expected.sum()).astype(np.int64)
    goal = counts.sum(axis=0)
    goal[full] = most[full]
    goal = np.minimum(goal, most)
    short = slots - int(goal.sum())
    if short > 0:  # to sources with room, by shares
        while short:
            room = most - goal
            p = np.where((room > 0) & ~full, np.where(expected > 0, expected, 1e-9), 0.0)
            got = np.minimum(rng.multinomial(short, p / p.sum()), room)
            goal += got
            short -= int(got.sum())
    elif short < 0:
        goal -= _spread(rng, -short, np.where(full, 0, goal))
    over = counts.sum(axis=0) - goal
    holes = np.zeros(shards, np.int64)
    for k in np.flatnonzero(over > 0):
        gone = _spread(rng, int(over[k]), counts[:, k])
        counts[:, k] -= gone
        holes += gone
    for k in np.flatnonzero(over < 0):
        got = _spread(rng, int(-over[k]), holes)
        counts[:, k] += got
        holes -= got
    return counts


def permuted(i: Column, n: Column, key: Column) -> Column:
    """A keyed pseudorandom permutation of 0..n-1, applied to i: a Feistel network over the least even number
    of bits that hold n, repeated until the value is below n (cycle walking)."""
    half = F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double")) / 2), F.lit(1)).cast("int")
    mask = F.expr("cast(1 as bigint)")
    mask = F.call_function("shiftleft", mask, half) - 1

    def once(v: Column) -> Column:
        left, right = F.call_function("shiftright", v, half), v.bitwiseAND(mask)
        for r in range(4):
            left, right = right, left.bitwiseXOR(F.xxhash64(right, key, F.lit(r)).bitwiseAND(mask))
        return F.call_function("shiftleft", left, half).bitwiseOR(right)

    # the domain is less than 4 n, so 64 steps leave a value outside with probability below (3/4)**64
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(i), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return walk


def slots_of(spark: SparkSession, sources: list[Source], drawn: np.ndarray, seed: int = 0, length: int = BLOCK) -> DataFrame:
    """(shard, source, slot, round, block) of every slot of the mix."""
    rows = []
    for k, s in enumerate(sources):
        ends = np.cumsum(drawn[:, k])
        rows += [(int(j), s.name, int(ends[j] - drawn[j, k]), int(ends[j]) - 1, s.blocks(length)) for j in np.flatnonzero(drawn[:, k])]
    total = int(drawn.sum())
    plan = spark.createDataFrame(rows, "shard int, source string, lo bigint, hi bigint, n bigint")
    # a run of slots is cut into pages and these are spread before they are unrolled; a number given is kept by adaptive execution
    pages = plan.withColumn("page", F.explode(F.sequence(F.floor(F.col("lo") / PAGE), F.floor(F.col("hi") / PAGE))))
    tasks = max(1, min(len(rows) + total // PAGE, max(spark.sparkContext.defaultParallelism, total // 4_000_000)))
    out = pages.repartition(tasks, "source", "shard", "page").select(
        "shard", "source", "n", F.explode(F.sequence(F.greatest("lo", F.col("page") * PAGE), F.least("hi", F.col("page") * PAGE + (PAGE - 1)))).alias("slot")
    )
    turn = F.floor(F.col("slot") / F.col("n"))
    return out.select("shard", "source", "slot", turn.alias("round"), permuted(F.col("slot") % F.col("n"), F.col("n"), F.xxhash64("source", turn, F.lit(seed))).alias("block"))


@dataclass(frozen=True)
class Mix:
    slots: DataFrame
    parts: DataFrame
    sources: list[Source]
    size: int
    length: int

    def rows(self) -> DataFrame:
        """(shard, source, slot, round, block, doc_id, at, from_token, n_tokens): the mix, as parts of documents."""
        return self.slots.join(self.parts.drop("tokens").hint("merge"), ["source", "block"])

    def report(self) -> DataFrame:
        """(source, target_share, actual_share, n_tokens, n_slots, n_rounds, exhausted, short) of the slots as drawn and joined to their blocks.

        One row for each source with a target.  ``exhausted``: every block stands in the mix as often as the cap
        allows; ``short``: and yet its tokens in the mix are fewer than its target share of the size.
        """
        spark = self.slots.sparkSession
        sizes = self.parts.groupBy("source", "block").agg(F.sum("n_tokens").alias("n_tokens"))
        used = self.slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n_slots"), F.max("round").alias("round"))
        # both sides grow with the tokens, so neither is ever broadcast
        got = used.join(sizes.hint("merge"), ["source", "block"]).groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("n_slots")).alias("n_tokens"), F.sum("n_slots").alias("n_slots"), (F.max("round") + 1).alias("n_rounds"))
        total = got.agg(F.sum("n_tokens").alias("all_tokens"))
        plan = spark.createDataFrame([(s.name, s.share, s.share * self.size, s.cap * s.blocks(self.length)) for s in self.sources], "source string, target_share double, wanted double, most bigint")
        none = F.lit(0).cast("bigint")
        return plan.join(got, "source", "left").crossJoin(total).select(  # total is one row
            "source", "target_share", F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("n_tokens", none).alias("n_tokens"), F.coalesce("n_slots", none).alias("n_slots"), F.coalesce("n_rounds", none).alias("n_rounds"),
            (F.coalesce("n_slots", none) >= F.col("most")).alias("exhausted"),
            ((F.coalesce("n_slots", none) >= F.col("most")) & (F.coalesce("n_tokens", none) < F.col("wanted"))).alias("short"),
        )


def mix(docs: DataFrame, weights: DataFrame, vocabulary: str, size: int | None = None, shards: int | None = None, seed: int = 0, length: int = BLOCK, tokens: bool = False) -> Mix:
    """A mix of ``size`` tokens (all documents' with a source, if not given) of ``docs``(doc_id, source, text)
    by ``weights``(source, target_share, max_repeats), one row for each source, a small fixed table.

    ``shards``: output shards (one for each 4,096 slots if not given, :data:`MOST_SHARDS` at most); with ``tokens``
    the token ids are kept for :func:`materialise`, so that no text is encoded twice.
    """
    spark = docs.sparkSession
    counts = written(token_counts(docs, vocabulary, tokens), "tokens")
    per = {r.source: (r.n, r.d) for r in counts.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("d")).collect()}  # one row for each source
    sources = []
    for r in weights.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null").groupBy("source").agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("m")).orderBy("source").collect():
        share = r.t if r.t is not None and math.isfinite(r.t) and r.t > 0 else 0.0
        sources.append(Source(r.source, float(share), max(int(r.m or 0), 0), int(per.get(r.source, (0, 0))[0])))
    size = sum(n for n, _ in per.values()) if size is None else size
    slots = -(-size // length)
    shards = min(max(16, -(-slots // 4096)), MOST_SHARDS) if shards is None else shards
    if not 0 < shards <= MOST_SHARDS:
        raise ValueError(f"shards must be 1 to {MOST_SHARDS}")
    drawn = draw(sources, slots, shards, size, seed, length)
    wanted = [s.name for s in sources if s.share > 0]
    buckets = max([64, *(-(-d // BUCKET_DOCS) for _, d in per.values())])
    parts = blocks(placed(counts.filter(F.col("source").isin(wanted)), seed, buckets), length)
    return Mix(slots_of(spark, sources, drawn, seed, length), parts, sources, size, length)


def materialise(mixed: Mix) -> DataFrame:
    """(shard, source, slot, tokens): the blocks of a mix made with ``tokens=True``; the last block of a source may be short."""
    if "tokens" not in mixed.parts.columns:
        raise ValueError("the mix was made without its tokens")
    # a block has at most its length in tokens, so the list is bounded
    whole = mixed.parts.groupBy("source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    return mixed.slots.join(whole.hint("merge"), ["source", "block"]).select("shard", "source", "slot", "tokens")
