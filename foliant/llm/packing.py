"""Problem 8: filling fixed-capacity containers with whole items at a controlled mixture of sources.

Deficit round-robin: every container adds each source's share of the capacity to that source's deficit, and a packed
item takes its size from it. The source that is owed most goes next, with its largest item that still fits; when no
source is owed that much space any more, the item that leaves the least room closes the container. What a source is owed
carries over to the next container, and from partition to partition as prefix sums: a partition's sources and sizes are
known before it is packed, so all partitions pack at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.tokens import DEFAULT, counter
from foliant.operators.ranking import prefix_sums
from foliant.tables import materialize

CAPACITY = 4096
#: Tasks that pack, at least; there are as many as partitions if those are more.
LEAST_TASKS = 32
ROWS_PER_PARTITION = 20_000


def token_sizes(df: DataFrame, key: str, text: str, source: str, tokenizer: str | None = DEFAULT) -> DataFrame:
    """(key, source, tokens): sizes of whole texts; null and empty texts have 0 tokens, a null source becomes ''."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = counter(tokenizer)
        for f in frames:
            yield pd.DataFrame({key: f[key], "source": f["source"], "tokens": tokens(f["text"].tolist())})

    rows = df.select(F.col(key), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(count, f"{key} {df.schema[key].dataType.simpleString()}, source string, tokens long")


def fill(sizes: list[int], sources: list[int], owed: list[float], shares: list[float], capacity: int) -> tuple[list[int], list[int]]:
    """Container and place in it for every item of one partition. `sources` index `owed` (the deficits so far) and
    `shares`. Items must be no larger than `capacity`."""
    import heapq
    from bisect import bisect_right, insort

    n = len(shares)
    queues: list[list[int]] = [[] for _ in range(n)]
    stacks: list[list[list[int]]] = [[] for _ in range(n)]  # per source: items by size; sizes and items run in parallel
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        queues[sources[i]].append(sizes[i])
        stacks[sources[i]].append(i)
    live = {s for s in range(n) if queues[s]}
    heads: list[tuple[int, int]] = sorted((queues[s][0], s) for s in live)  # smallest item of each source
    container, place, at = [0] * len(sizes), [0] * len(sizes), 0
    debt = [o - sh * capacity for o, sh in zip(owed, shares)]  # deficit = debt + share x capacity x containers begun

    def take(s: int, j: int) -> int:
        q = queues[s]
        if j == 0:
            heads.remove((q[0], s))
        size = q.pop(j)
        i = stacks[s].pop(j)
        if not q:
            live.discard(s)
        elif j == 0:
            insort(heads, (q[0], s))
        debt[s] -= size
        container[i], place[i] = at, k
        return size

    while live:
        room, k = capacity, 0
        begun = (at + 1) * capacity
        order = [(-(debt[s] + shares[s] * begun), s) for s in live]
        heapq.heapify(order)
        while order and room:
            owe, s = heapq.heappop(order)
            if owe >= 0 and room < capacity:
                break  # nobody is owed anything any more
            j = bisect_right(queues[s], room) - 1
            if j < 0:
                continue
            size = take(s, j)
            room, k = room - size, k + 1
            if s in live and owe + size < 0:
                heapq.heappush(order, (owe + size, s))
        while room and heads and heads[0][0] <= room:  # close with what leaves the least room; of equals, who is owed most
            best = (-1, 0.0, 0, 0)
            for low, s in heads:
                if low > room:
                    break
                j = bisect_right(queues[s], room) - 1
                x = (queues[s][j], debt[s] + shares[s] * begun, -s, j)
                if x > best:
                    best = x
            room, k = room - take(-best[2], best[3]), k + 1
        at += 1
    return container, place


def pack(items: DataFrame, key: str, capacity: int = CAPACITY, shares: Mapping[str, float] | None = None, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """(key, source, piece, n_pieces, first_token, tokens, container, place) for `items` (key, source, tokens).

    Every item lies whole in one container; only an item larger than `capacity` is cut, into full containers and one
    remainder that is packed like any item. `shares` are the target token proportions by source, by default those of
    `items`; sources without a target follow when nobody is owed. An item of 0 tokens lies in some container too.
    Rows are dealt to partitions by a hash of the key, so that a source with a third of all rows is in every partition
    and only keys and sizes are shuffled. An empty table gives no rows.
    """
    items = materialize(items)
    rows = items.count()
    parts = max(1, -(-rows // rows_per_partition))
    pieces = items.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    totals = materialize(pieces.groupBy("part", "source").agg(F.sum("tokens").alias("tokens")))
    if shares is None:
        of = totals.groupBy("source").agg(F.sum("tokens").alias("t"))
        all_tokens = totals.agg(F.sum("tokens").alias("all_t"))
        target = of.crossJoin(F.broadcast(all_tokens)).select("source", F.coalesce(F.try_divide(F.col("t").cast("double"), F.col("all_t")), F.lit(0.0)).alias("share"))
    else:
        whole = float(sum(shares.values())) or 1.0
        target = items.sparkSession.createDataFrame([(s, x / whole) for s, x in shares.items()], "source string, share double")
    # what a source is owed when a partition begins: its share of all tokens before, less its own tokens before
    per_part = totals.groupBy("part").agg(F.sum("tokens").alias("t"), F.lit(0).alias("all"))
    all_before = prefix_sums(per_part, ["all"], "part", "t", "all_before").select("part", "all_before")
    owed = (
        prefix_sums(totals, ["source"], "part", "tokens", "own_before")
        .join(all_before, "part")
        .join(target, "source", "left")
        .select(F.col("part").alias("o_part"), F.col("source").alias("o_source"), F.coalesce("share", F.lit(0.0)).alias("share"), (F.coalesce("share", F.lit(0.0)) * F.col("all_before") - F.col("own_before")).alias("owed"))
    )

    def run(k: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(key, kind="stable").reset_index(drop=True)
        state = docs.drop_duplicates("source").sort_values("source").reset_index(drop=True)
        index = {s: i for i, s in enumerate(state["source"])}
        owed_now, share = state["owed"].tolist(), state["share"].tolist()
        n = docs["n_pieces"].to_numpy()
        full = np.maximum(n - 1, 0)
        rest = docs["tokens"].to_numpy() - full * capacity
        source = [index[s] for s in docs["source"]]
        for s, f in zip(source, full):  # full containers of oversized items: the others' share of them is owed
            if f:
                owed_now[s] -= int(f) * capacity
        extra = int(full.sum())
        owed_now = [o + sh * capacity * extra for o, sh in zip(owed_now, share)]
        at, place = fill(rest.tolist(), source, owed_now, share, capacity)
        base = int(k[0]) << 32
        out = pd.DataFrame({key: docs[key], "source": docs["source"], "piece": full, "n_pieces": n, "first_token": full * capacity, "tokens": rest, "container": base + extra + np.asarray(at, dtype="int64"), "place": place})
        over = np.flatnonzero(full)
        if len(over):
            i = np.repeat(over, full[over])
            piece = np.concatenate([np.arange(full[j]) for j in over])
            out = pd.concat([out, pd.DataFrame({key: docs[key].to_numpy()[i], "source": docs["source"].to_numpy()[i], "piece": piece, "n_pieces": n[i], "first_token": piece * capacity, "tokens": capacity, "container": base + np.arange(extra), "place": 0})])
        return out

    schema = f"{key} {items.schema[key].dataType.simpleString()}, source string, piece int, n_pieces int, first_token long, tokens long, container long, place int"
    ready = pieces.join(owed, (F.col("part") == F.col("o_part")) & (F.col("source") == F.col("o_source")))
    # a number of partitions is named, else few bytes but much work would end in one task
    ready = ready.select("part", key, "source", "tokens", "n_pieces", "share", "owed").repartition(max(LEAST_TASKS, parts), "part")
    return ready.groupBy("part").applyInPandas(run, schema)


def pack_texts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, tokenizer: str | None = DEFAULT, shares: Mapping[str, float] | None = None, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """`pack` for texts sized by a public tokenizer. Extra columns of `df` are ignored; `key` must be unique and not null."""
    return pack(token_sizes(df.filter(F.col(key).isNotNull()), key, text, source, tokenizer), key, capacity, shares, rows_per_partition)


def container_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: tokens, fill, items, and how many sources it mixes."""
    return packed.groupBy("container").agg(
        F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.lit(capacity)).alias("fill"), F.count("*").alias("items"), F.countDistinct("source").alias("sources")
    )
