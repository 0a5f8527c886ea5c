"""Problem 4: cutting oversized items at natural boundaries, by ranges.

No worker ever holds a whole item. An item is a row of ranges; a worker sees one range and a halo on either side, lists
the natural boundaries whose position falls in its range, and counts the range's characters. The per-range tables are
stitched by prefix sums of those counts, which turn positions in a range into positions in the item. Every range also
names one anchor, its strongest late boundary, where a piece always ends; so the stretch between two anchors is cut on
its own, and the length of an item never bounds the parallelism. Items no longer than one range have no inner anchor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.ranking import prefix_sums
from foliant.tables import materialize

LIMIT, OVERLAP, RANGE, HALO = 900, 100, 65536, 64
PARAGRAPH, SENTENCE, LINE, CLAUSE, WORD = 5, 4, 3, 2, 1
#: A boundary is the position after the match: what follows starts there.
BOUNDARY = re.compile(
    r"(?P<paragraph>\n[ \t]*\n\s*)"
    r"|(?P<sentence>(?<=[.!?…。！？])[\"'”’»)\]]{0,3}(?:[ \t]+(?=[^a-zà-ÿ])|\n+)|(?<=[。！？])(?=\S))"
    r"|(?P<line>\n)"
    r"|(?P<clause>(?<=[;:,，；：、])\s)"
    r"|(?P<word>\s+)"
)
CLASS = {"paragraph": PARAGRAPH, "sentence": SENTENCE, "line": LINE, "clause": CLAUSE, "word": WORD}
TABLE = "part int, n_chars long, anchor long, positions array<int>, classes array<int>"



def range_table(window: str, core: int, length: int) -> tuple[int, list[int], list[int]]:
    """Boundaries of one range: (anchor, positions, classes), positions counted from the range's first character.

    `window` is the range with its halos, `core` the place of the range's first character in it. A boundary belongs to
    the range that holds the last character before it, so each is reported once.
    """
    positions, classes = [], []
    for m in BOUNDARY.finditer(window):
        at = m.end() - core
        if at > length:
            break
        if at > 0:
            positions.append(at)
            classes.append(CLASS[m.lastgroup])
    late = [(c, p) for p, c in zip(positions, classes) if p > length // 2]
    return (max(late)[1] if late else length), positions, classes


def cut(begin: int, end: int, positions: list[int], classes: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of [begin, end) of at most `limit`, in one pass over the sorted boundaries.

    A piece ends at the latest boundary of the strongest class found in its last two thirds (strong classes count from
    a third of the limit, words from half of it), else at the limit. The next piece starts at the first boundary within
    the last `overlap` characters, else exactly `overlap` before the end.
    """
    from bisect import bisect_left, bisect_right

    pieces, at = [], begin
    while True:
        if end - at <= limit:
            pieces.append((at, end))
            return pieces
        least = at + max(overlap + 1, limit // 3)
        lo, hi = bisect_left(positions, least), bisect_right(positions, at + limit)
        best = max(((c if c >= LINE or positions[i] >= at + limit // 2 else 0, positions[i]) for i, c in enumerate(classes[lo:hi], lo)), default=(0, 0))
        stop = best[1] if best[0] else (positions[hi - 1] if hi > lo else at + limit)
        pieces.append((at, stop))
        i = bisect_left(positions, stop - overlap)
        at = positions[i] if i < len(positions) and positions[i] < stop else stop - overlap


def _offsets(tables: DataFrame, key: str) -> DataFrame:
    """(key, part, before): the characters before each range, as prefix sums of the ranges' counts."""
    return prefix_sums(tables.select(key, "part", "n_chars"), [key], "part", "n_chars", "before").drop("n_chars")


def _pieces(tables: DataFrame, offsets: DataFrame, key: str, limit: int, overlap: int) -> DataFrame:
    """Range tables (`key` and TABLE, written already) and `offsets` (key, part, before) to (key, piece, start, end);
    positions in characters of the item."""
    placed = tables.join(offsets, [key, "part"])
    # what lies before a range's anchor ends the stretch that began in the range before; the rest begins the next one
    split = placed.select(
        key,
        "before",
        "n_chars",
        "anchor",
        F.explode(
            F.array(
                F.struct(F.col("part").alias("stretch"), F.lit(0).cast("long").alias("lo"), F.col("anchor").alias("hi")),
                F.struct((F.col("part") + 1).alias("stretch"), F.greatest(F.col("anchor") - overlap, F.lit(0)).alias("lo"), F.col("n_chars").alias("hi")),
            )
        ).alias("s"),
        "positions",
        "classes",
        "last",
    ).filter("s.hi > s.lo and not (last and s.stretch > part)").select(
        key,
        "s.stretch",
        (F.col("before") + F.col("s.lo")).alias("lo"),
        (F.col("before") + F.col("s.hi")).alias("hi"),
        F.filter(
            F.transform(F.arrays_zip("positions", "classes"), lambda b: F.struct((b.positions + F.col("before")).alias("p"), b.classes.alias("c"))),
            lambda b: (b.p >= F.col("before") + F.col("s.lo")) & (b.p <= F.col("before") + F.col("s.hi")),
        ).alias("b"),
    )
    stretches = split.groupBy(key, "stretch").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.flatten(F.collect_list("b"))).alias("b")
    ).select(key, "stretch", "lo", "hi", F.col("b.p").alias("p"), F.col("b.c").alias("c"))  # arrays of numbers reach Python as they are

    def cut_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, stretch, lo, hi, p, c in zip(f[key], f["stretch"], f["lo"], f["hi"], f["p"], f["c"]):
                positions = p.tolist()
                # the first piece repeats the end of the stretch before, from a natural boundary on
                if stretch and positions and positions[0] < lo + overlap:
                    lo = positions[0]
                for i, (s, e) in enumerate(cut(lo, hi, positions, c.tolist(), limit, overlap)):
                    out.append((k, stretch, i, s, e))
            yield pd.DataFrame(out, columns=[key, "stretch", "i", "start", "end"])

    kind = tables.schema[key].dataType.simpleString()
    cuts = materialize(stretches.mapInPandas(cut_all, f"{key} {kind}, stretch int, i long, start long, end long"))
    counts = cuts.groupBy(key, "stretch").agg(F.count("*").alias("n"))
    numbered = cuts.join(prefix_sums(counts, [key], "stretch", "n", "pieces_before").drop("n"), [key, "stretch"])
    return numbered.select(key, (F.col("pieces_before") + F.col("i")).alias("piece"), "start", "end")


def _ranges(df: DataFrame, key: str, text: str, limit: int, range_chars: int, halo: int) -> DataFrame:
    """(key, part, core, n_chars, window, last): the ranges of every text longer than `limit`, each with its halos.

    One pass over a text cuts it; each range takes its halos from its neighbours, the right one long enough for a piece
    that begins in the range's last character.
    """
    big = df.filter(F.col(key).isNotNull() & (F.length(text) > limit)).select(key, F.col(text).alias("__text"))
    cores = F.regexp_extract_all("__text", F.lit(f"(?s)(.{{1,{range_chars}}})"), F.lit(1))
    before = lambda i: F.when(i > 0, F.right(F.element_at("cores", i.cast("int")), F.lit(halo))).otherwise("")
    after = lambda i: F.when(i + 1 < F.size("cores"), F.left(F.element_at("cores", (i + 2).cast("int")), F.lit(max(halo, limit)))).otherwise("")
    windows = F.transform(
        "cores",
        lambda c, i: F.struct(i.cast("int").alias("part"), F.length(before(i)).alias("core"), F.length(c).cast("long").alias("n_chars"), F.concat(before(i), c, after(i)).alias("window"), (i + 1 == F.size("cores")).alias("last")),
    )
    return big.select(key, cores.alias("cores")).select(key, F.explode(windows).alias("r")).select(key, "r.*")


def piece_bounds(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE, halo: int = HALO) -> DataFrame:
    """(key, piece, start, end): the pieces of `split_texts` without their texts."""
    if not 0 <= overlap < limit // 3 or range_chars < limit:
        raise ValueError("overlap must be at least 0 and below a third of the limit, a range no shorter than the limit")

    def detect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [range_table(w, c, n) for w, c, n in zip(f["window"], f["core"], f["n_chars"])]
            yield pd.DataFrame({key: f[key], "part": f["part"], "n_chars": f["n_chars"], "anchor": [n if z else x[0] for x, n, z in zip(found, f["n_chars"], f["last"])], "positions": [x[1] for x in found], "classes": [x[2] for x in found], "last": f["last"]})

    tables = materialize(_ranges(df, key, text, limit, range_chars, halo).mapInPandas(detect, f"{key} {df.schema[key].dataType.simpleString()}, {TABLE}, last boolean"))
    return _pieces(tables, _offsets(tables, key), key, limit, overlap)


def split_texts(
    df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE, halo: int = HALO
) -> DataFrame:
    """(key, piece, start, end, text): pieces of every text longer than `limit` code points; shorter ones are left out.

    `key` must be unique. Positions count code points from 0, pieces from 0. Consecutive pieces overlap by `overlap`
    characters or less, down to a natural boundary. Null texts and keys give no rows.
    """
    pieces = piece_bounds(df, key, text, limit, overlap, range_chars, halo).withColumn("part", F.floor(F.col("start") / range_chars).cast("int"))
    at = F.col("core") + F.col("start") - F.col("part") * range_chars + 1
    # a range meets its pieces as one array, so its text is moved once
    own = pieces.groupBy(key, "part").agg(F.collect_list(F.struct("piece", "start", "end")).alias("pieces"))
    ranges = _ranges(df, key, text, limit, range_chars, halo).select(key, "part", "core", "window")
    return ranges.join(own, [key, "part"]).select(key, "part", "core", "window", F.explode("pieces").alias("p")).select(key, "part", "core", "window", "p.*").select(
        key, "piece", "start", "end", F.substring("window", at.cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("text")
    )


def _open(path: str):
    """A file of any file system that the workers know by its address, for reading at any place."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def split_files(spark: SparkSession, paths: Sequence[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 1 << 20) -> DataFrame:
    """(path, piece, start, end, text) of UTF-8 files of any size, read by byte ranges only.

    `paths` are absolute paths or addresses of a file system that all workers see. The driver asks for sizes; workers
    seek to their range, read it with a halo, and keep the characters whose first byte lies in it. A range is read once
    more for all pieces that start in it. Bytes that are no UTF-8 count as one replacement character each.
    """
    halo = 4 * HALO
    sizes = []
    for p in paths:
        with _open(p) as h:
            sizes.append((p, h.size()))
    plan = spark.createDataFrame(sizes, "path string, size long").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("size") / range_bytes) - 1)))).select(
        "path", F.col("part").cast("int").alias("part"), (F.col("part") * range_bytes).alias("begin"), "size"
    )
    ranges = plan.repartition(max(1, min(10_000, sum(-(-n // range_bytes) for _, n in sizes))), "path", "part")

    def first_char(raw: bytes, at: int) -> int:
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    def detect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, part, begin, size in zip(f["path"], f["part"], f["begin"], f["size"]):
                low = max(0, begin - halo)
                with _open(path) as h:
                    h.seek(low)
                    raw = h.read(begin - low + range_bytes + halo)
                a, b = first_char(raw, begin - low) if begin else 0, first_char(raw, min(len(raw), begin - low + range_bytes))
                head = raw[first_char(raw, 0) if low else 0 : a].decode("utf-8", "replace")
                core = raw[a:b].decode("utf-8", "replace")
                anchor, positions, classes = range_table(head + core + raw[b:].decode("utf-8", "ignore"), len(head), len(core))
                out.append((path, part, len(core), len(core) if begin + range_bytes >= size else anchor, positions, classes, begin + range_bytes >= size, low + a, low + b))
            yield pd.DataFrame(out, columns=["path", "part", "n_chars", "anchor", "positions", "classes", "last", "byte_from", "byte_to"])

    tables = materialize(ranges.mapInPandas(detect, f"path string, {TABLE}, last boolean, byte_from long, byte_to long"))
    offsets = materialize(_offsets(tables, "path"))
    pieces = _pieces(tables.drop("byte_from", "byte_to"), offsets, "path", limit, overlap)
    spans = tables.select("path", "part", "n_chars", "byte_from", "byte_to").join(offsets, ["path", "part"])
    # a piece starts in exactly one range; both sides meet by buckets of characters, whatever the number of ranges
    met = _by_bucket(pieces, spans).groupBy("path", "part", "before", "byte_from", "byte_to").agg(F.sort_array(F.collect_list(F.struct("piece", "start", "end"))).alias("pieces"))
    beyond = 4 * limit

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, before, low, high, own in zip(f["path"], f["before"], f["byte_from"], f["byte_to"], f["pieces"]):
                with _open(path) as h:
                    h.seek(low)
                    chars = h.read(high - low + beyond).decode("utf-8", "replace")
                rows = [(path, p["piece"], p["start"], p["end"], chars[p["start"] - before : p["end"] - before]) for p in own]
                yield pd.DataFrame(rows, columns=["path", "piece", "start", "end", "text"])

    return met.mapInPandas(read, "path string, piece long, start long, end long, text string")


def _by_bucket(pieces: DataFrame, spans: DataFrame, width: int = 1 << 18) -> DataFrame:
    wide = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("n_chars")) / width))))
    return pieces.withColumn("bucket", F.floor(F.col("start") / width)).join(wide, ["path", "bucket"]).filter("start >= before and start < before + n_chars").drop("bucket")


def page_extents(segments: DataFrame) -> DataFrame:
    """(doc_id, page, page_start, page_end): where each segment lies in its document's text, joined by blank lines.

    A page is a segment, numbered from 1; of repeated (doc_id, seg_index) rows the smallest segment_id counts.
    """
    once = segments.filter("doc_id is not null and seg_index is not null").groupBy("doc_id", "seg_index").agg(
        F.min_by(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 2, "segment_id").alias("size")
    )
    ends = prefix_sums(once, ["doc_id"], "seg_index", "size", "page_start")
    return ends.select("doc_id", (F.col("seg_index") + 1).alias("page"), "page_start", (F.col("page_start") + F.col("size")).alias("page_end"))


def split_chunks(chunks: DataFrame, segments: DataFrame | None = None, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE, bucket: int = 8192) -> DataFrame:
    """(chunk_id, doc_id, piece, start, first_page, last_page, text) for every chunk longer than `limit`.

    `start` is the piece's offset in the document. Pages come from the extents of the document's segments, met by
    (document, offset bucket) so that no page is compared with pieces far from it; where the segments don't reach, they
    are interpolated from the chunk's own pages, and null if those are null.
    """
    pieces = split_texts(chunks, "chunk_id", "text", limit, overlap, range_chars)
    own = chunks.filter(F.length("text") > limit).select(
        "chunk_id", "doc_id", F.col("start").alias("chunk_start"), F.col("first_page").alias("p1"), F.col("last_page").alias("p2"), F.length("text").alias("n")
    )
    placed = pieces.join(own, "chunk_id").withColumns(
        {"at": F.col("chunk_start") + F.col("start"), "to": F.col("chunk_start") + F.col("end") - 1}
    )
    share = lambda x: (F.col("p1") + F.floor((F.col("p2") - F.col("p1") + 1) * x / F.col("n"))).cast("int")
    first, last = F.least(share(F.col("start")), F.col("p2")), F.least(share(F.col("end") - 1), F.col("p2"))
    if segments is not None:
        extents = page_extents(segments).withColumn(
            "bucket", F.explode(F.sequence(F.floor(F.col("page_start") / bucket), F.floor((F.col("page_end") - 1) / bucket)))
        )
        for end, name in (("at", "fp"), ("to", "lp")):
            e = extents.select(F.col("doc_id").alias("e_doc"), F.col("bucket").alias("e_bucket"), F.col("page").alias(name), F.col("page_start").alias("e_from"), F.col("page_end").alias("e_to"))
            placed = placed.join(e, (F.col("doc_id") == F.col("e_doc")) & (F.floor(F.col(end) / bucket) == F.col("e_bucket")) & (F.col(end) >= F.col("e_from")) & (F.col(end) < F.col("e_to")), "left").drop("e_doc", "e_bucket", "e_from", "e_to")
        first, last = F.coalesce(F.col("fp"), first), F.coalesce(F.col("lp"), last)
    return placed.select("chunk_id", "doc_id", "piece", F.col("at").alias("start"), first.alias("first_page"), last.alias("last_page"), "text")
