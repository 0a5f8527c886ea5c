"""Problem 9: passages of held-out items inside a corpus.

A prefix-filtered set join. A passage is half an item's words in one stretch, in which at most one word in CHANGE_WITHIN
is changed, lost or doubled. Items and documents are cut into shingles of five words whose middle word is free, so that
a change spoils at most four of them; a passage must therefore share a known number of its window's shingles, and at
least one of the window's rarest ones, ordered by their count over the whole corpus. Those prefix shingles open a pair of
document and item, the number of shared shingles near one diagonal bounds it, and an alignment of the words inside one
item-sized window of the document verifies it.

Documents are split into words once, whatever the number of items. What that pass hands on of a document are the places
of those shingles that pass a filter of fixed size made of all items; counts and joins see nothing else. The items' side
of the join is sent to the workers in blocks of bounded size, as a document's places lie together. Texts are met again
for the documents of bounded pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.tables import materialize

N = 5
SHARE = 0.5
#: At most one changed word in so many makes a passage.
CHANGE_WITHIN = 6
#: Words left out of a shingle's place in an item, and in documents: its middle word as it is, lost, or doubled.
OUTER = (0, 1, 3, 4)
VARIANTS = (OUTER, (0, 1, 2, 3), (0, 1, 4, 5))
#: Skips in the item and in the document at a change: a changed, lost or doubled word, one of which a wrong character
#: made two, two that became one, or the two parts of a number. A change of two of the item's words counts twice.
#: A change is followed by RESYNC equal words, the last one before a passage's edge by EDGE.
NUMBER = 2
GAPS = ((1, 1), (1, 0), (0, 1), (1, 2), (2, 1), (2, 2), (2, 0), (0, 2))
RESYNC, EDGE = 3, 2
#: Bits of the filter of item shingles, in words of 32, and rows of a side up to which a join is told to broadcast it.
FILTER_BITS, BROADCAST_ROWS = 1 << 25, 500_000
#: Item shingles in a block that is sent to the workers, and places of documents that a worker takes at a time.
BLOCK, PLACES = 2_000_000, 1_000_000
#: Distinct words whose hashes a worker remembers at a time.
REMEMBERED = 1_000_000
WORD = re.compile(r"[^\W_]+")
MARKUP = re.compile(r"<[^<>\n]{1,200}>|\]\([^()\s]{1,300}\)|\\[a-zA-Z]{2,20}\*?(?=[{\s])|&[a-zA-Z]{2,8};")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-cased words without punctuation, spacing and markup."""
    if "<" in text or "](" in text or "\\" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return WORD.findall(text.lower())


class WordHashes(dict):
    """Hashes of words, 63 bits and never 0, remembered while a worker runs. The bit of NUMBER is set in those of numbers."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) >> 3 << 2 | (NUMBER if word.isdigit() else 0) | 1
        return h


def bounds(n: int) -> tuple[int, int, int]:
    """Of an item of `n` words: the words of a passage, the changes that may be in it, the shingles that then survive.

    A passage of w words has w - 4 shingles, of which a change spoils at most four; the changes are as many as the
    density allows and still leave one. Passages of fewer words than a shingle allow none and are one shingle.
    """
    need = max(1, -(-n // 2))
    if need < N:
        return need, 0, 1
    changes = min(need // CHANGE_WITHIN, (need - N) // len(OUTER))
    return need, changes, need - N + 1 - len(OUTER) * changes


def combined(ids: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """One hash per place of `ids`, of the words at `offsets` from it; 0 where one of them is missing (0)."""
    k = len(ids) - offsets[-1]
    if k <= 0:
        return np.zeros(0, dtype="uint64")
    h, known = np.full(k, len(offsets), dtype="uint64"), np.ones(k, dtype=bool)
    for o in offsets:
        x = ids[o : o + k]
        h = (h ^ x) * MULTIPLIER
        h ^= h >> np.uint64(29)
        known &= x != 0
    h |= np.uint64(1)
    h[~known] = 0
    return h


def item_offsets(need: int) -> tuple[int, ...]:
    """The shingle of an item: OUTER, or for passages shorter than that all their words."""
    return OUTER if need >= N else tuple(range(need))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view("int64")


def _grow(item: list[int], doc: list[int], i: int, j: int, step: int) -> tuple[int, list[int]]:
    """From the places i, j on: the last item place reached, and the item places of the changes on the way."""
    n, m, last, changes = len(item), len(doc), i - step, []

    def resumed(x: int, y: int) -> int:
        """Equal words from x, y on, RESYNC at most; those beyond the item's end count as equal."""
        for k in range(RESYNC):
            u, v = x + k * step, y + k * step
            if not 0 <= u < n:
                return RESYNC if k else 0
            if not 0 <= v < m or item[u] != doc[v]:
                return k
        return RESYNC

    while 0 <= i < n and 0 <= j < m:
        if item[i] == doc[j]:
            last, i, j = i, i + step, j + step
            continue
        far = (0, 0, 0)
        for a, b in GAPS:
            if (a, b) in ((2, 2), (2, 0), (0, 2)):
                skipped = item[i : i + a] + doc[j : j + b] if step > 0 else item[max(0, i - a + 1) : i + 1] + doc[max(0, j - b + 1) : j + 1]
                if not all(x & NUMBER for x in skipped):
                    continue
            r = resumed(i + a * step, j + b * step)
            if r == RESYNC:
                far = (r, a, b)
                break
            if r >= EDGE and a < 2 and b < 2 and r > far[0]:
                far = (r, a, b)
        r, a, b = far
        if not r:
            break
        changes += [i] * (2 if a == 2 or a == 0 and b == 2 else 1)
        i, j = i + a * step, j + b * step
        if r < RESYNC:  # the passage's edge: a change with few words after it, and no further
            last = i + (r - 1) * step
            break
    return last, changes


def longest_stretch(item: list[int], doc: list[int], seeds: list[tuple[int, int]], need: int, allowed: int) -> int:
    """Most words of the item spanned by one in-order stretch through a seed (place in item, place in document), if `need`
    words of it in one piece hold no more than `allowed` changes; else 0.

    From a seed the alignment grows both ways. At a mismatch it skips what GAPS say if RESYNC words agree after it, or all
    up to the item's end; the last change before a passage's edge needs EDGE of them.
    """
    best, done = 0, []
    for p, q in seeds:
        if any(low <= p <= high and abs(q - p - shift) <= slack for low, high, shift, slack in done):
            continue
        high, after = _grow(item, doc, p, q, 1)
        low, before = _grow(item, doc, p - 1, q - 1, -1)
        done.append((low, high, q - p, len(before) + len(after)))
        changes = sorted(before + after)
        # the windows worth a look begin at the stretch's start or right after a change
        starts = [low] + [c + 1 for c in changes]
        if any(s + need - 1 <= high and sum(s <= c < s + need for c in changes) <= allowed for s in starts):
            best = max(best, high - low + 1)
    return best


# ---------------------------------------------------------------------------------------------- the join


def item_shingles(items: DataFrame) -> DataFrame:
    """(item, n, pos, shingle, size) of `items` (item, t): the shingles of every item; `size` is the number of its words
    where passages are shorter than a shingle, else 5."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for f in frames:
            out = []
            for i, t in zip(f["item"], f["t"]):
                ids = np.fromiter(map(known.__getitem__, words_of(t)), dtype="uint64")
                need = bounds(len(ids))[0]
                h = combined(ids, item_offsets(need))
                out.append(pd.DataFrame({"item": i, "n": len(ids), "pos": np.arange(len(h)), "shingle": as_long(h), "size": min(need, N)}))
            yield pd.concat(out) if out else pd.DataFrame({"item": [], "n": [], "pos": [], "shingle": [], "size": []})

    return items.mapInPandas(run, "item long, n int, pos int, shingle long, size int")


def _places(corpus: DataFrame, filter_words: dict[int, int], sizes: list[int]) -> DataFrame:
    """(doc, at, shingle) of `corpus` (doc, t): the places of the shingles that pass the filter, and those, as arrays."""
    bits = np.zeros(FILTER_BITS // 32, dtype="uint32")
    for w, b in filter_words.items():
        bits[w] = b & 0xFFFFFFFF
    shared = corpus.sparkSession.sparkContext.broadcast(bits)  # fixed size
    kinds = [v for v in VARIANTS if N in sizes] + [tuple(range(s)) for s in sizes if s < N]
    doc_type = corpus.schema["doc"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, table, space = WordHashes(), shared.value, np.zeros(N + 1, dtype="uint64")
        for f in frames:
            ids, starts, total = [], [0], 0
            for t in f["t"]:
                w = words_of(t)
                ids += [np.fromiter(map(known.__getitem__, w), dtype="uint64", count=len(w)), space]  # shingles end with their document
                total += len(w) + len(space)
                starts.append(total)
            flat, starts = np.concatenate(ids) if ids else space, np.array(starts)
            found, hashes = [np.zeros(0, dtype="int64")], [np.zeros(0, dtype="uint64")]
            for kind in kinds:
                h = combined(flat, kind)
                at = np.flatnonzero((table[(h >> np.uint64(8)) % np.uint64(FILTER_BITS // 32)] >> (h >> np.uint64(3) & np.uint64(31)).astype("uint32")) & 1 & (h != 0))
                found.append(at)
                hashes.append(h[at])
            at, h = np.concatenate(found), np.concatenate(hashes)
            order = np.argsort(at, kind="stable")
            at, h = at[order], as_long(h[order])
            cuts = np.searchsorted(at, starts)
            some = np.flatnonzero(np.diff(cuts))
            if len(some):
                yield pd.DataFrame({"doc": f["doc"].to_numpy()[some], "at": [(at[cuts[i] : cuts[i + 1]] - starts[i]).astype("int32") for i in some], "shingle": [h[cuts[i] : cuts[i + 1]] for i in some]})

    return corpus.mapInPandas(run, f"doc {doc_type}, at array<int>, shingle array<long>")


def with_prefixes(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """`shingles` with `prefix`: whether it is, in a window of its item that a passage may be, among as many of the
    rarest shingles as may be spoiled and one more. One item's shingles are brought together, never more."""
    ranked = shingles.join(counts.hint("merge"), "shingle", "left")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        need, changes, survive = bounds(int(f["n"].iloc[0]))
        window = min(len(f), max(1, need - N + 1))
        rarity = f["seen"].fillna(0).to_numpy()
        order = np.argsort(np.lib.stride_tricks.sliding_window_view(rarity, window), axis=1, kind="stable")[:, : window - survive + 1]
        prefix = np.zeros(len(f), dtype=bool)
        prefix[np.unique(order + np.arange(len(order))[:, None])] = True
        return f[["item", "n", "pos", "shingle"]].assign(prefix=prefix)

    return ranked.groupBy("item").applyInPandas(run, "item long, n int, pos int, shingle long, prefix boolean")


def _small(df: DataFrame) -> DataFrame:
    """A table that is written already, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


class Block:
    """Shingles of some items in sorted arrays."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["shingle", "item", "pos"])
        self.ids, self.item = np.unique(rows["item"].to_numpy(), return_inverse=True)
        n = np.zeros(len(self.ids), dtype="int64")
        n[self.item] = rows["n"].to_numpy()
        limits = np.array([bounds(x) for x in n.tolist()], dtype="int64").reshape(-1, 3)
        self.window = np.maximum(1, limits[:, 0] - N + 1)
        self.width = limits[:, 1] + 2  # a change shifts by one word, and a middle word may be lost or doubled
        self.survive = limits[:, 2]
        self.pos, self.prefix = rows["pos"].to_numpy().astype("int64"), rows["prefix"].to_numpy()
        self.keys, self.begin = np.unique(rows["shingle"].to_numpy(), return_index=True)
        self.size = np.diff(np.append(self.begin, len(rows)))

    def arrays(self) -> tuple:
        return (self.ids, self.item, self.window, self.width, self.survive, self.pos, self.prefix, self.keys, self.begin, self.size)


def _pairs(block: tuple, doc: np.ndarray, at: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, item, first diagonal and width of the bands of diagonals in which a document and an item share a
    prefix shingle and as many shingles of one window as survive a passage's changes."""
    ids, item, window, width, survive, pos, prefix, keys, begin, size = block
    k = np.minimum(np.searchsorted(keys, shingle), len(keys) - 1)
    hit = keys[k] == shingle
    k, doc, at = k[hit], doc[hit], at[hit]
    wide = size[k]
    entry = np.repeat(begin[k] - np.append(0, np.cumsum(wide)[:-1]), wide) + np.arange(wide.sum())
    doc, at = np.repeat(doc, wide), np.repeat(at, wide)
    own = item[entry]
    band = (at - pos[entry]) // width[own]
    # every range of `width` diagonals lies in one of the overlapping bands: a shingle is in two
    key = (doc * len(ids) + own << 32) + (band + (1 << 30))
    opened = np.unique(key[prefix[entry]])
    opened = np.unique(np.append(opened, opened - 1))
    both, place = np.append(key, key - 1), np.append(pos[entry], pos[entry])
    j = np.minimum(np.searchsorted(opened, both), max(0, len(opened) - 1))
    good = opened[j] == both if len(opened) else np.zeros(len(both), dtype=bool)
    span = int(place.max(initial=0)) + 1
    rows = np.unique(j[good] * span + place[good])  # a shingle of the item counts once in a band
    key, place = opened[rows // span], rows % span
    i = (key >> 32) % len(ids)
    last = np.arange(len(key)) + survive[i] - 1
    inside = last < len(key)
    inside[inside] = (key[last[inside]] == key[inside]) & (place[last[inside]] - place[inside] < window[i[inside]])
    key = np.unique(key[inside])
    i = (key >> 32) % len(ids)
    return (key >> 32) // len(ids), ids[i], ((key & 0xFFFFFFFF) - (1 << 30)) * width[i], width[i]


def candidates(places: DataFrame, shingles: DataFrame, block: int) -> DataFrame:
    """(doc, item, low, width): pairs that share a prefix shingle and, near the same diagonals and in one window of the
    item, as many shingles as survive a passage's changes; the diagonals are those from `low` to `low` + 2 x `width`."""
    spark, doc_type = places.sparkSession, places.schema["doc"].dataType.simpleString()
    counts = places.select(F.explode("shingle").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("seen"))
    ready = materialize(with_prefixes(shingles, counts))
    blocks = max(1, -(-ready.count() // block))
    schema, out = f"doc {doc_type}, item long, low long, width int", None
    for b in range(blocks):
        own = ready.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toPandas()  # about `block` rows
        if not len(own):
            continue
        shared = spark.sparkContext.broadcast(Block(own).arrays())

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for f in frames:
                sizes = f["at"].map(len).to_numpy()
                for _, part in f.groupby(np.cumsum(sizes) // PLACES, sort=False):
                    n = part["at"].map(len).to_numpy()
                    d, i, low, width = _pairs(shared.value, np.repeat(np.arange(len(part)), n), np.concatenate(part["at"].to_numpy()).astype("int64"), np.concatenate(part["shingle"].to_numpy()))
                    yield pd.DataFrame({"doc": part["doc"].to_numpy()[d], "item": i, "low": low, "width": width})

        found = places.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def places_of(item: np.ndarray) -> dict[int, list[int]]:
    """Where the shingles of an item stand in it."""
    at: dict[int, list[int]] = {}
    for p, h in enumerate(combined(item, item_offsets(bounds(len(item))[0])).tolist()):
        at.setdefault(h, []).append(p)
    return at


def verify(words: np.ndarray, item: np.ndarray, at: dict[int, list[int]], low: int, width: int) -> int:
    """The stretch of an item in the window of a document that the diagonals from `low` on reach; 0 without a passage."""
    need, allowed, _ = bounds(len(item))
    begin = max(0, low - N)
    part = words[begin : low + 2 * width + len(item) + 2 * allowed + N]
    seeds = []
    for v in VARIANTS if need >= N else (item_offsets(need),):
        for q, h in enumerate(combined(part, v).tolist()):
            if h in at:
                seeds += [(p, q) for p in at[h]]
    found = longest_stretch(item.tolist(), part.tolist(), sorted(seeds), need, allowed)
    return found if found >= need else 0


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, item, item_words, stretch_words, share): every document with every item of which it holds at least half.

    The share is of the item's words, in one stretch and in order, apart from case, punctuation, spacing, markup and
    single changed, lost or doubled words, at most one in CHANGE_WITHIN of half the item's words. Items with equal words
    are all reported. Items of fewer than nine words, half of which is no shingle, need that half without a change.
    Items without words, null and empty texts and null keys give no rows; neither does an empty table.
    """
    key_type, item_type = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    corpus = documents.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("doc"), F.col(text).alias("t"))
    asked = items.filter(F.col(item).isNotNull() & (F.length(item_text) > 0)).select(F.col(item).alias("id"), F.col(item_text).alias("t"))

    def normal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["id"]].assign(t=[" ".join(words_of(t)) for t in f["t"]])

    # items with equal words are one
    named = materialize(asked.mapInPandas(normal, f"id {item_type}, t string").filter("t != ''").select("id", F.xxhash64("t").alias("item"), "t"))
    distinct = materialize(named.groupBy("item").agg(F.min("t").alias("t")))
    shingles = materialize(item_shingles(distinct))
    place = F.pmod(F.shiftrightunsigned("shingle", 8), F.lit(FILTER_BITS // 32))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(shingle, 3) & 31 as int))")
    words = {r.w: r.b for r in shingles.groupBy(place.alias("w")).agg(F.bit_or(bit).alias("b")).toLocalIterator()}  # at most FILTER_BITS / 32 rows
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())
    places = materialize(_places(corpus, words, sizes))
    pairs = materialize(candidates(places, shingles, block))
    met = pairs.join(_small(distinct), "item").groupBy("doc").agg(F.collect_list(F.struct("item", "t", "low", "width")).alias("asked"))
    texts = corpus.join(_small(materialize(pairs.select("doc").distinct())), "doc", "left_semi")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        hashed = lambda words: np.fromiter(map(known.__getitem__, words), dtype="uint64", count=len(words))
        for f in frames:
            out, items = [], {}
            for d, t, questions in zip(f["doc"], f["t"], f["asked"]):
                ids, best = hashed(words_of(t)), {}
                for x in questions:
                    if x["item"] not in items:
                        own = hashed(x["t"].split(" "))
                        items[x["item"]] = own, places_of(own)
                    own, places = items[x["item"]]
                    s = verify(ids, own, places, int(x["low"]), int(x["width"]))
                    if s > best.get(x["item"], (0, 0))[1]:
                        best[x["item"]] = (len(own), s)
                out += [(d, i, n, s) for i, (n, s) in best.items()]
            yield pd.DataFrame(out, columns=["doc", "item", "item_words", "stretch_words"])

    found = texts.join(met, "doc").select("doc", "t", "asked").mapInPandas(check, f"doc {key_type}, item long, item_words int, stretch_words int")
    out = found.join(_small(named.select("id", "item")), "item").select(F.col("doc").alias(key), F.col("id").alias(item), "item_words", "stretch_words")
    return out.withColumn("share", F.col("stretch_words") / F.col("item_words"))


def leak_report(leaks: DataFrame, items: DataFrame, item: str = "item_id") -> DataFrame:
    """Every item with the number of documents that hold it and the largest share found (0 where none)."""
    per = leaks.groupBy(item).agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))
    return items.select(item).distinct().join(per, item, "left").select(item, F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("largest_share", F.lit(0.0)).alias("largest_share"))
