"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents that belong to the same set of sources are one pattern. Each pattern offers its words once for each allowed
epoch, at a cost that grows with the epoch (convex), and sources ask for their quotas. A min-cost flow routes words from
patterns to sources; what flows out of a pattern is then taken as whole documents, in the order of a seeded hash: all of
them for each full epoch, and a prefix of that order for the rest.

Only sums for each pattern and each hash bucket of a pattern are gathered; the prefix is found on those sums, and exactly
within the one bucket in which it ends. No task sees all documents of a source. Targets are found on the table of sources.
Sources that share documents, directly or over others, are a group, and no word flows between groups; so the flow of each
group is solved by itself in a task, from its patterns. Their number doesn't grow with documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.llm.components import components
from kerbline.llm.shared import columns, dropped, stored

#: Fixed values of the mix: weights of the sources by code point, repeating; the share of all sizes; copies of a document at most.
WEIGHTS, SHARE, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2, "mix-1"
#: Hash buckets of a pattern: the prefix ends within one of them. A power of 16, being leading hexadecimal digits.
BUCKET_DIGITS = 3
#: Rows of a plan of patterns that are broadcast at most; with more, both sides of its joins are shuffled.
MOST_SENT = 200_000


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (source, ...) with rank, from 0 in the order of code points, null last: sorted in ranges, and counted on from range to range."""
    place = F.monotonically_increasing_id()
    ordered = sources.orderBy(F.col("source").isNull(), "source").select("*", F.spark_partition_id().alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_at"))
    ordered = stored(ordered, "mix-sources")
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    return ordered.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn("rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = EPOCHS) -> DataFrame:
    """``sources`` (source, size) with target: a weighted share of ``share`` of all sizes, none above ``most`` times its size; the excess is shared anew by weight.

    A source is full where its share by weight reaches its most. Sharing anew only raises the share of a unit of weight, so
    that full sources stay full and the sums of two columns, over and over, lead to the end.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = _ranked(sources)
    weighed = stored(ranked.withColumn("_w", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))), "mix-weights")
    dropped(ranked)
    cap = F.lit(float(most)) * F.col("size")
    total, open_ = (float(x or 0) for x in weighed.agg(F.sum("size"), F.sum(F.when(F.col("size") > 0, F.col("_w")))).first())
    full, seen = 0.0, None
    while open_ and (full, open_) != seen:
        seen, unit = (full, open_), (share * total - full) / open_
        reached = F.lit(unit) * F.col("_w") >= cap
        full, open_ = (float(x or 0) for x in weighed.agg(F.sum(F.when(reached, cap)), F.sum(F.when(~reached, F.col("_w")))).first())
    by_weight = F.lit(unit) * F.col("_w") if open_ else cap
    return weighed.select("source", "size", F.least(cap, by_weight).alias("target"))


def routed(patterns: dict[tuple, float], target: dict, epochs: int = EPOCHS) -> dict[tuple, float]:
    """Words that leave each pattern, at the least cost: epoch e of a pattern costs e a word; unmet quotas are left where capacity ends.

    Successive shortest paths from the patterns over the bipartite graph of patterns and sources with residual arcs.
    """
    members = {s: [p for p in patterns if s in p] for s in target}
    flow: dict[tuple, dict] = {p: {} for p in patterns}
    out = dict.fromkeys(patterns, 0.0)
    need = dict(target)
    for source in sorted(target, key=lambda x: (x is None, x or "")):
        while need[source] > 1e-6:
            # Dijkstra from the source back to a pattern with a free epoch: over a pattern one of its other sources may be rerouted.
            best, came, heap = {source: 0.0}, {}, [(0.0, 0, source)]
            found, tie = None, 0
            ends: tuple[float, tuple | None] = (float("inf"), None)
            while heap:
                cost, _, s = heapq.heappop(heap)
                if cost > best.get(s, float("inf")) or cost >= ends[0]:
                    continue
                for p in members[s]:
                    e = int(out[p] / patterns[p] + 1e-9) if patterns[p] else epochs
                    if e < epochs and cost + e < ends[0]:
                        ends = (cost + e, p)
                        came[p] = s
                        found = p
                    for other, moved in flow[p].items():
                        if moved > 1e-6 and other != s and cost < best.get(other, float("inf")):
                            best[other] = cost
                            came[other] = (p, s)
                            tie += 1
                            heapq.heappush(heap, (cost, tie, other))
            if found is None:
                break
            p = found
            amount = min(need[source], (int(out[p] / patterns[p] + 1e-9) + 1) * patterns[p] - out[p])
            s, steps = came[p], []
            while s != source:  # the way back: s gets from p, and gives up what it had from a further pattern
                via, nearer = came[s]
                steps.append((via, s, nearer))
                amount = min(amount, flow[via][s])
                s = nearer
            flow[p][came[p]] = flow[p].get(came[p], 0.0) + amount
            for via, s, nearer in steps:
                flow[via][s] -= amount
                flow[via][nearer] = flow[via].get(nearer, 0.0) + amount
            out[p] += amount
            need[source] -= amount
    return out


def _routes(wanted: DataFrame, epochs: int) -> DataFrame:
    """Words that leave each pattern by the flow of its group: rows (_group, _sources, _n, source, size, target) of a group are one problem."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = [(tuple(sources), float(n), source, int(size), float(target)) for sources, n, source, size, target in zip(rows["_sources"], rows["_n"], rows["source"], rows["size"], rows["target"], strict=True)]
        sums = {sources: n for sources, n, *_ in rows}
        size, target = {x[2]: x[3] for x in rows}, {x[2]: x[4] for x in rows}
        flow = routed(sums, target, epochs)
        out = [(list(p), n, flow[p], sum(size[s] for s in p), float(sum(target[s] for s in p))) for p, n in sums.items()]
        return pd.DataFrame(out, columns=["_sources", "_n", "_taken", "source_size", "target"])

    return wanted.groupBy("_group").applyInPandas(solve, "_sources array<string>, _n double, _taken double, source_size long, target double")


def _planned(patterns: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """Of each pattern (_sources, _n words): full epochs, words of one more, and the size and target of its sources."""
    each = patterns.select("_sources", "_n", F.explode("_sources").alias("source"))
    found = targets(each.groupBy("source").agg(F.sum("_n").alias("size")), weights, share, epochs)
    wanted = stored(found, "mix-targets")
    dropped(found)
    # A source is a node by its hash; two that had one hash would only be solved together.
    node = lambda c: F.xxhash64(c)
    links = patterns.select(F.explode(F.slice("_sources", 2, 1 << 20)).alias("b"), node(F.element_at("_sources", 1)).alias("a"))
    groups = components(links.select("a", node(F.col("b")).alias("b")))
    rows = each.join(wanted.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).withColumn("node", node(F.col("source")))
    rows = rows.join(groups, "node", "left").select(F.coalesce("component", "node").alias("_group"), "_sources", "_n", "source", "size", "target")
    out = _routes(rows, epochs)
    whole = F.when(F.col("_n") > 0, F.least(F.floor(F.col("_taken") / F.col("_n") + 1e-9), F.lit(epochs))).otherwise(0).cast("int")
    rest = F.col("_taken") - F.col("_full") * F.col("_n")
    return out.withColumn("_full", whole).select("_sources", "_full", F.when(rest > 0.5, rest).otherwise(0.0).alias("_rest"), "source_size", "target")


def mix(docs: DataFrame, sources: Column, size: Column, key: Column, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, also: Sequence[str] = ()) -> DataFrame:
    """Each row of ``docs`` with doc_id, ``also``, size, sources (array), target (of its sources) and taken (words).

    ``sources`` gives a row's array of sources (its set of members; null is a source of its own), ``size`` its words and
    ``key`` what is hashed with the seed; rows with the same key and pattern are in the order of their ids and are ties
    otherwise, all taken or none; rows with a null id are ties by their key. Documents without words are taken 0 words; a
    row with an empty array of sources is in no mix and left out; an empty table gives no rows.
    """
    named = docs.select(*[F.col(f"`{x}`") for x in ("doc_id", *also)], F.array_sort(F.array_distinct(sources)).alias("_sources"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), F.md5(F.concat(F.lit(seed + ":"), key)).alias("_key"))
    named = named.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    kept = stored(named.select("doc_id", "_sources", "_size", "_key", "_bucket") if also else named, "mix-sizes")
    by_bucket = stored(kept.groupBy("_sources", "_bucket").agg(F.sum("_size").alias("_sum")), "mix-buckets")
    patterns = stored(by_bucket.groupBy("_sources").agg(F.sum("_sum").alias("_n")), "mix-patterns")
    planned = _planned(patterns, weights, share, epochs)
    plan = stored(planned, "mix-plan")
    dropped(planned)
    few = plan.count() <= MOST_SENT
    small = lambda df: F.broadcast(df) if few else df  # noqa: E731  a row for each pattern at most
    plan = small(plan)
    order = Window.partitionBy("_sources").orderBy("_bucket")
    before = F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = by_bucket.withColumn("_before", before).join(plan, "_sources").where("_rest > _before").withColumn("_whole", F.col("_before") + F.col("_sum") <= F.col("_rest"))
    edge = marks.where("not _whole").select("_sources", "_bucket", "_before", "_rest")
    # One bucket of each pattern at most, of one in 16 ** BUCKET_DIGITS of its documents.
    last = kept.join(small(edge), ["_sources", "_bucket"]).where("_size > 0")
    run = Window.partitionBy("_sources", "_bucket").orderBy("_key", "doc_id")
    upto = last.withColumn("_upto", F.col("_before") + F.coalesce(F.sum("_size").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # A document whose middle lies before the end of the prefix is within it: the sum is then off by half a document at most.
    cut = upto.where(F.col("_upto") + F.col("_size") / 2 <= F.col("_rest")).groupBy("_sources", "_bucket").agg(F.max("_key").alias("_last"))
    marks = marks.join(small(cut), ["_sources", "_bucket"], "left").select("_sources", "_bucket", "_whole", "_last")
    ends = marks.groupBy("_sources").agg(F.max(F.when(F.col("_whole"), F.col("_bucket"))).alias("_through"), F.max("_last").alias("_last"))
    # Further columns, such as texts, are not written once more: what the rows were named by is worked out again.
    rows = (named if also else kept).join(plan, "_sources").join(small(ends), "_sources", "left")
    more = F.coalesce(F.col("_bucket") <= F.col("_through"), F.lit(False)) | F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False))
    return rows.select("doc_id", *[F.col(f"`{x}`") for x in also], F.col("_size").alias("size"), F.col("_sources").alias("sources"), "source_size", "target", (F.col("_size") * (F.col("_full") + F.when(more, 1).otherwise(0))).alias("taken"))


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``mix`` of documents that belong to the one source of their ``source`` column."""
    docs = columns(docs, "doc_id", "text", "source")
    return mix(docs, F.array(F.col("source").cast("string")), word_count(F.col("text")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), also=["source"], **options)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text, source and any other columns) with each row as often as the mix takes it, which may be never."""
    whole = docs.select("doc_id", F.struct("*").alias("row"))
    found = mix(whole, F.array(F.col("row.source").cast("string")), word_count(F.col("row.text")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), also=["row"], **options)
    return found.where("taken > 0").select("row", F.explode(F.sequence(F.lit(1), F.expr("cast(taken div size as int)")))).select("row.*")
