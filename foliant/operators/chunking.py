"""Page-aware overlapping chunks in closed form.

With pages joined by a blank line after each, L characters in all, chunk size C and stride S = C - overlap, there are
1 + max(0, ceil((L - C) / S)) chunks and chunk k covers the C characters from k S on. So every page knows by itself which
chunks it touches: pages are cut and sent to their chunks, and no document is ever assembled in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import PAGE_BREAK, chunk_name
from foliant.operators.ranking import prefix_sums
from foliant.tables import materialize

CHUNK_CHARS, OVERLAP = 900, 100


def chunk_pages(pages: DataFrame, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, name, text, first_page, last_page, is_reference, start) from `pages` (doc_id, page, text, title).

    `page` must be unique in a document; a null text counts as empty. The first page of a chunk after the first is the
    one that holds the cut before it, the last page of one before the last is the one that holds its own cut. A chunk
    is a reference if the title of a page from first to last names references or a bibliography.
    """
    if not 0 <= overlap < chunk_chars:
        raise ValueError(f"need 0 <= overlap < chunk_chars, got {overlap} and {chunk_chars}")
    stride = chunk_chars - overlap
    sized = pages.filter("doc_id is not null and page is not null").select(
        "doc_id", F.col("page").cast("bigint").alias("page"), F.concat(F.coalesce("text", F.lit("")), F.lit(PAGE_BREAK)).alias("joined"),
        F.coalesce(F.col("title").rlike("(?i)reference|bibliograph"), F.lit(False)).alias("refs"),
    ).withColumn("size", F.length("joined").cast("bigint"))
    # sizes alone are placed and summed; texts are met once, when they are cut
    narrow = materialize(sized.select("doc_id", "page", "size"))
    begins = prefix_sums(narrow, ["doc_id"], "page", "size", "begin").drop("size")
    placed = sized.join(begins, ["doc_id", "page"]).withColumn("end", F.col("begin") + F.col("size"))
    whole = narrow.groupBy("doc_id").agg(F.sum("size").alias("total"), F.min("page").alias("page_a"), F.max("page").alias("page_z"))
    last_chunk = F.greatest(F.lit(0), F.ceil((F.col("total") - chunk_chars) / stride)).cast("bigint")
    low = F.greatest(F.lit(0), F.ceil((F.col("begin") - chunk_chars) / stride)).cast("bigint")
    high = F.least(F.floor((F.col("end") - 1) / stride), F.col("last_chunk")).cast("bigint")
    # a page is cut once into blocks of a stride; each chunk takes its part from the few blocks it reaches, and only parts
    # are multiplied, never the page
    blocks = F.regexp_extract_all(F.concat(F.repeat(F.lit(" "), (F.col("begin") % stride).cast("int")), F.col("joined")), F.lit(f"(?s)(.{{1,{stride}}})"), F.lit(1))
    met = placed.join(whole.withColumn("last_chunk", last_chunk), "doc_id").filter(low <= high).withColumns({"low": low, "high": high, "block": F.floor(F.col("begin") / stride), "blocks": blocks})
    reach = -(-chunk_chars // stride) + 1

    def part_of(chunk: Column) -> Column:
        start = chunk * stride
        a, z = F.greatest(start, F.col("begin")), F.least(start + chunk_chars, F.col("end"))
        i = F.greatest(chunk - F.col("block"), F.lit(0))
        near = F.array_join(F.slice("blocks", (i + 1).cast("int"), F.lit(reach)), "")
        return F.substring(near, (a - (F.col("block") + i) * stride + 1).cast("int"), F.greatest(F.lit(0), z - a).cast("int"))

    pieces = F.transform(F.sequence("low", "high"), lambda k: F.struct(k.alias("chunk"), part_of(k).alias("part")))
    touched = met.select("doc_id", "last_chunk", "page_a", "page_z", "page", "begin", "end", "refs", F.explode(pieces).alias("x")).select("*", "x.chunk", "x.part")
    start, stop = F.col("chunk") * stride, F.col("chunk") * stride + chunk_chars
    holds = lambda at: (F.col("begin") <= at) & (at < F.col("end"))
    grouped = touched.groupBy("doc_id", "chunk", "last_chunk", "page_a", "page_z").agg(
        F.sort_array(F.collect_list(F.struct("page", "part", "refs"))).alias("parts"),
        F.max(F.when(holds(start + overlap), F.col("page"))).alias("cut_before"),
        F.max(F.when(holds(stop), F.col("page"))).alias("cut_after"),
    )
    first = F.when(F.col("chunk") == 0, F.col("page_a")).otherwise(F.col("cut_before"))
    last = F.when(F.col("chunk") == F.col("last_chunk"), F.col("page_z")).otherwise(F.col("cut_after"))
    return grouped.withColumns({"first_page": first, "last_page": last}).select(
        "doc_id", "chunk", chunk_name(F.col("doc_id"), F.col("first_page"), F.col("last_page")).alias("name"),
        F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"), "first_page", "last_page",
        F.exists("parts", lambda p: p["refs"] & p["page"].between(F.col("first_page"), F.col("last_page"))).alias("is_reference"),
        (F.col("chunk") * stride).alias("start"),
    )


def content_keys(pages: DataFrame, width: int = 1024) -> DataFrame:
    """(doc_id, key): SHA-256 over the digests of ranges of `width` page numbers, each over page numbers, lengths and
    page digests in order.

    Texts enter by their digests and ranges by theirs, so neither a long page nor a document of very many pages is
    brought together in one place.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.concat(F.lpad(F.col("page").cast("string"), 9, "0"), F.lit(":"), F.length(text).cast("string"), F.lit(":"), F.sha2(text, 256))
    placed = pages.filter("doc_id is not null and page is not null").select("doc_id", F.floor(F.col("page") / width).alias("range"), digest.alias("digest"))
    ranges = placed.groupBy("doc_id", "range").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256).alias("digest"))
    entry = F.concat(F.lpad(F.col("range").cast("string"), 9, "0"), F.lit(":"), F.col("digest"))
    return ranges.groupBy("doc_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), ""), 256).alias("key"))


def token_windows(df: DataFrame, key: str, tokens: str, size: int, overlap: int = 32) -> DataFrame:
    """(key, window, start, tokens): overlapping windows over arrays of tokens, by the same closed form as chunks."""
    if not 0 <= overlap < size:
        raise ValueError(f"need 0 <= overlap < size, got {overlap} and {size}")
    stride = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / stride)).cast("int")
    rows = df.filter(F.size(tokens) > 0).select(key, tokens, F.explode(F.sequence(F.lit(0), last)).alias("window"))
    return rows.select(key, "window", (F.col("window") * stride).alias("start"), F.slice(F.col(tokens), F.col("window") * stride + 1, F.lit(size)).alias(tokens))
