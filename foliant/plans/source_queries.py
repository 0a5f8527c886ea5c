"""Sources, sinks, suites and the index applied to whole tables: inputs that no table holds are made from its rows."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.vectors import decoded_base64
from foliant.operators import corpus, evaluation, index, statistics, telemetry
from foliant.plans import pipeline as P
from foliant.plans import report
from foliant.sources import crawl, files, headings, latex, logs, pages, papers, store
from foliant.tables import load, load_even, scratch

Query = Callable[[SparkSession, str], DataFrame]


def _simple(text: Column) -> Column:
    """A text of ASCII letters, digits, commas and full stops, in one line."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9.,]+", " "))


# ------------------------------------------------------------------------------------------------- inputs


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a file per manifest whose first bytes are those of its kind."""
    kind, name = F.col("source_kind"), F.encode(F.coalesce("title", F.lit("untitled")), "utf-8")
    head = F.when(kind == "pdf", F.lit("255044462D312E370A")).when(kind == "image", F.lit("49492A00"))
    return load(spark, d, "manifests").select(F.col("source_path").alias("path"), "source_kind", F.when(head.isNotNull(), F.concat(F.unhex(head), name)).otherwise(name).alias("content"))


def q_detected(spark: SparkSession, d: str) -> DataFrame:
    """Kinds and types of input files, by their bytes before their names."""
    return files.detected(_inputs(spark, d).drop("source_kind")).groupBy("kind", "mime", "problem").agg(F.count("*").alias("files"))


def q_renamed(spark: SparkSession, d: str) -> DataFrame:
    """The same files under names without suffix: only those that their bytes give away are known."""
    bare = _inputs(spark, d).drop("source_kind").withColumn("path", F.regexp_replace("path", r"\.[^./]*$", ""))
    return files.detected(bare).groupBy("kind", "mime", "problem").agg(F.count("*").alias("files"))


def _zipped(df: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(content=[gzip.compress(bytes(c)) for c in f["content"]])

    return df.mapInPandas(run, df.schema)


def q_gzip(spark: SparkSession, d: str) -> DataFrame:
    """What gzipped inputs hold, and what plain ones are."""
    rows = _inputs(spark, d).select("path", "source_kind", "content")
    both = rows.withColumn("zipped", F.lit(False)).unionByName(_zipped(rows).withColumn("zipped", F.lit(True)))
    return both.select("source_kind", "zipped", F.coalesce(files.container_kind("content"), F.lit("none")).alias("box")).groupBy("source_kind", "zipped", "box").agg(F.count("*").alias("files"))


def q_text_heads(spark: SparkSession, d: str) -> DataFrame:
    """Inputs whose first bytes are text."""
    rows = _inputs(spark, d).select("source_kind", files.text_head(F.substring("content", 1, files.HEAD)).alias("is_text"))
    return rows.groupBy("source_kind", "is_text").agg(F.count("*").alias("files"))


def q_identity(spark: SparkSession, d: str) -> DataFrame:
    """Identity of segments as files: the SHA-256 of their bytes; equal texts are one file."""
    rows = load(spark, d, "segments").filter("text is not null").select(F.col("segment_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    return files.with_identity(rows).groupBy("doc_id").agg(F.count("*").alias("files"))


def q_plain_files(spark: SparkSession, d: str) -> DataFrame:
    """Segments written as files, with dot files and sidecars beside them, listed and read back as text."""
    folder = scratch(spark)
    rows = load_even(spark, d, "segments").filter("text is not null").select("segment_id", "text")
    named = rows.select(F.concat(F.lit("s"), F.pmod("segment_id", F.lit(16))).alias("name"), F.struct(F.col("segment_id").alias("i"), _simple(F.col("text")).alias("t")).alias("x"))
    whole = named.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("value"))
    for ending in (".txt", ".meta.json"):
        whole.select("value", F.concat("name", F.lit(ending)).alias("file")).write.partitionBy("file").option("lineSep", "\u0001").text(folder + ("/texts" if ending == ".txt" else "/sidecars"))
    # Spark names files itself; a folder named like a sidecar stands for one
    listed = files.list_inputs(spark, [folder + "/texts"]).filter(F.col("path").contains("/part-"))
    texts = files.plain_texts(listed).select(F.regexp_extract("path", r"file=([^/]+)\.txt/", 1).alias("name"), F.regexp_replace("text", "\u0001$", "").alias("text"))
    return texts.select("name", F.md5("text").alias("digest"))


def q_sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Input files with the title of their sidecar, where there is one."""
    rows = load(spark, d, "manifests")
    sidecars = rows.filter("title is not null").groupBy(F.col("source_path").alias("path")).agg(F.min("title").alias("title"))
    joined = files.with_sidecars(rows.select(F.col("source_path").alias("path"), "doc_id"), sidecars)
    return joined.groupBy("title").agg(F.count("*").alias("files"))


def q_first_pages(spark: SparkSession, d: str) -> DataFrame:
    return corpus.first_pages(P.pages_of(load(spark, d, "segments")), 3).groupBy("page").agg(F.count("*").alias("pages"))


def q_page_range(spark: SparkSession, d: str) -> DataFrame:
    """Pages 2 to 4 of every document, told whether one is larger than a limit."""
    some = corpus.page_range(P.pages_of(load(spark, d, "segments")), 2, 4, 4_000)
    return some.groupBy("page", "too_large").agg(F.count("*").alias("pages"))


def _recorded(spark: SparkSession, d: str) -> str:
    """Scanned documents as a reader would record them: each page holds an image that is scaled, turned for every third
    page and moved, in part over the page's edge."""
    m = lambda **v: F.struct(*((v[n] if isinstance(v.get(n), Column) else F.lit(float(v.get(n, 0)))).cast("double").alias(n) for n in "abcdef"))
    i = F.col("page_no").cast("double")
    turned = F.when(F.col("page_no") % 3 == 0, m(b=1, c=-1, e=1)).otherwise(m(a=1, d=1))
    image = F.array(turned, m(a=i * 40 + 100, d=400), m(a=1, d=1, e=i * 30, f=i * 50 - 100))
    rows = load(spark, d, "ocr_results").filter("doc_id is not null and page_no is not null").groupBy("doc_id", "page_no").agg(F.min_by("text", "result_id").alias("text"))
    page = F.struct("page_no", "text", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.array(image).alias("images"))
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(page)).alias("p"))
    path = scratch(spark) + "/recorded"
    docs.select(F.col("doc_id").alias("path"), F.lit("scan").alias("title"), F.transform("p", lambda x: F.struct(x["text"].alias("text"), x["width"].alias("width"), x["height"].alias("height"), x["images"].alias("images"))).alias("pages")).write.json(path)
    return path


def q_measured(spark: SparkSession, d: str) -> DataFrame:
    """Pages of recorded documents with the signals that routing asks for."""
    rows = pages.measured(pages.recorded_pages(spark, _recorded(spark, d)))
    return rows.select("path", "page", "n_pages", "n_images", "image_coverage", "garbage_ratio", "alpha_ratio")


def q_image_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Where images lie on recorded pages, after nested placements."""
    rows = pages.recorded_pages(spark, _recorded(spark, d)).select("path", "page", pages.bounds(F.col("images")[0]).alias("b"))
    return rows.select("path", "page", *(F.round(f"b.{c}", 3).alias(c) for c in ("left", "bottom", "right", "top")))


def q_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of recorded images with several; an image per scanned manifest."""
    path = scratch(spark) + "/frames"
    m = load(spark, d, "manifests").filter("source_kind = 'image'")
    frames = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_pages"))), lambda i: F.struct((i * 10).alias("width"), F.lit(800).alias("height")))
    m.select(F.concat_ws("#", "source_path", F.col("created_at").cast("string")).alias("path"), frames.alias("frames")).write.json(path)
    return pages.recorded_frames(spark, path).groupBy("frame", "width").agg(F.count("*").alias("images"))


def q_html_converted(spark: SparkSession, d: str) -> DataFrame:
    """Segments as HTML pages with a title, a heading, a list and a script, converted to Markdown."""
    from foliant.sources import html

    t = _simple(F.col("text"))
    page = F.concat(F.lit("<html><head><title>Page</title><script>x < y</script></head><body><h2>Part</h2><p>"), t, F.lit("</p><ul><li>one</li><li>two</li></ul></body></html>"))
    done = html.converted(load_even(spark, d, "segments").select("segment_id", page.alias("page")), "segment_id", "page")
    return done.select("segment_id", "title", F.md5("text").alias("digest"))


# ------------------------------------------------------------------------------------------------- LaTeX


def _archives(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a tar per document, gzipped for every other one; a main file includes its segments, the second one
    hides its end, and a picture lies beside them."""
    pages = P.pages_of(load(spark, d, "segments")).select("doc_id", F.struct("page", _simple(F.col("text")).alias("text")).alias("p"))
    docs = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("pages"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, pages in zip(f["doc_id"], f["pages"]):
                parts = [(f"parts/p{p['page']}.tex", p["text"] + " % remark\n\\endinput\nnever read") for p in pages]
                body = "\n".join(f"\\section{{Part {p['page']}}}\n\\input{{parts/p{p['page']}}}" for p in pages)
                parts += [("main.tex", f"\\documentclass{{article}}\n\\begin{{document}}\n{body}\n\\end{{document}}\n"), ("figure.png", "none")]
                raw = io.BytesIO()
                with tarfile.open(fileobj=raw, mode="w") as tar:
                    for name, text in parts:
                        info = tarfile.TarInfo(name)
                        info.size = len(text.encode())
                        tar.addfile(info, io.BytesIO(text.encode()))
                data = raw.getvalue()
                out.append((doc, gzip.compress(data) if doc[0] in "02468ace" else data))
            yield pd.DataFrame(out, columns=["path", "content"])

    return docs.mapInPandas(run, "path string, content binary")


def q_unpacked(spark: SparkSession, d: str) -> DataFrame:
    """Members with text of every archive, and its warnings."""
    return latex.unpack(_archives(spark, d)).groupBy("path").agg(F.count("data").alias("members"), F.count("warning").alias("warnings"))


def q_main_files(spark: SparkSession, d: str) -> DataFrame:
    return latex.main_files(latex.decoded(latex.unpack(_archives(spark, d))))


def q_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Every source as one text, cut into its sections."""
    rows = latex.unpack(_archives(spark, d))
    flat = latex.flat_sources(rows, latex.main_files(latex.decoded(rows)))
    return flat.select("path", "title", F.md5("text").alias("digest"), F.size("warnings").alias("warnings"))


def q_conversions(spark: SparkSession, d: str) -> DataFrame:
    """Which text stands where a converter gave those of one candidate and a fallback those of another."""
    rows = P.page_scores(load(spark, d, "ocr_results"), F.coalesce("text", F.lit(""))).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("candidate", "value"))).alias("c")).filter(F.size("c") > 1)
    pairs = rows.select("unit", F.col("c")[0]["value"].alias("converted"), F.col("c")[1]["value"].alias("fallback"))
    return pairs.select("unit", latex.conversion_choice(F.col("converted"), F.col("fallback"), F.lit(4000)).alias("choice")).groupBy("choice").agg(F.count("*").alias("pages"))


def q_environmental(spark: SparkSession, d: str) -> DataFrame:
    """Exit codes that point at the machine; the number of tokens stands for one."""
    code = F.col("gen_tokens") % 140 - 20
    return load(spark, d, "ocr_results").groupBy(telemetry.environmental(code).alias("environmental")).agg(F.count("*").alias("runs"))


def q_classified(spark: SparkSession, d: str) -> DataFrame:
    """What downloads are, by their bytes: the inputs as they are, and gzipped."""
    rows = _inputs(spark, d).select("path", "source_kind", "content")
    both = rows.withColumn("zipped", F.lit(False)).unionByName(_zipped(rows).withColumn("zipped", F.lit(True)))
    return both.groupBy("source_kind", "zipped", crawl.download_kind("content", F.col("path")).alias("format")).agg(F.count("*").alias("files"))


def q_tex_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Sources in two encodings, decoded."""
    t = F.concat(_simple(F.col("text")), F.lit(" \u00e9\u00fc"))
    rows = load_even(spark, d, "segments").select("segment_id", F.when(F.col("segment_id") % 2 == 0, F.encode(t, "utf-8")).otherwise(F.encode(t, "iso-8859-1")).alias("b"))
    return rows.select("segment_id", F.md5(latex.decoded_tex("b")).alias("digest"))


def q_latex_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages as small papers, read without a converter: title and authors, abstract, a section with a list."""
    t, i = _simple(F.col("text")), F.col("page").cast("string")
    source = F.concat(
        F.lit("\\documentclass{article}\n\\title{Paper "), i, F.lit("\\thanks{by all}}\n\\author{Ann \\and Bob}\n\\begin{document}\n\\maketitle\n\\begin{abstract}Sum "), i,
        F.lit("\\end{abstract}\n\\section{Part}\nx "), t, F.lit(" y.\n\n\\begin{itemize}\\item one\\item \\emph{two}\\end{itemize}\n\\end{document}\n"),
    )
    pages = P.pages_of(load_even(spark, d, "segments")).select(F.concat_ws("#", "doc_id", i).alias("paper"), source.alias("source"))
    return latex.readable(pages, "paper", "source").select("paper", "ord", "title", F.md5("text").alias("digest"))


# ------------------------------------------------------------------------------------------------- headings, papers


def q_headings(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown with a chapter for every third page and a fence that holds a false heading, cut at headings."""
    pages = P.pages_of(load(spark, d, "segments")).select("doc_id", "page", _simple(F.col("text")).alias("t"))
    marked = F.concat(F.when(F.col("page") % 3 == 1, F.concat(F.lit("# C"), F.col("page").cast("string"), F.lit("\n\n"))).otherwise(F.lit("")), F.lit("## P"), F.col("page").cast("string"), F.lit("\n\n```\n\n# no heading\n```\n\n."), F.col("t"))
    docs = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", marked.alias("m")))), lambda x: x["m"]), "\n\n").alias("md"))
    return headings.split_markdown(docs, "doc_id", "md").select("doc_id", "ord", "title", F.md5("text").alias("digest"))


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    """(xml): an answer per kind of source with an entry per manifest, and one that is broken."""
    m = load(spark, d, "manifests")
    people = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit("<author><name>"), _simple(a), F.lit("</name></author>"))), "")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), F.substring("doc_id", 1, 12), F.lit("v2</id><title> "), _simple(F.col("title")), F.lit("\n</title><published>"),
        F.coalesce(F.col("pub_year").cast("string"), F.lit("1999")), F.lit("-05-01T00:00:00Z</published>"), people, F.lit("</entry>"),
    )
    own = m.select("doc_id", "created_at", F.floor(F.conv(F.substring("doc_id", 1, 2), 16, 10).cast("int") / 4).alias("answer"), entry.alias("e"))
    once = own.groupBy("doc_id", "answer").agg(F.min_by("e", "created_at").alias("e"))
    total = F.count("*").cast("string")
    feeds = once.groupBy("answer").agg(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:o="http://a9.com/-/spec/opensearch/1.1/"><o:totalResults>'), total, F.lit("</o:totalResults>"), F.array_join(F.collect_list("e"), ""), F.lit("</feed>")).alias("xml"))
    return feeds.select("xml").unionByName(spark.createDataFrame([("<feed><broken",)], "xml string"))


def q_feeds(spark: SparkSession, d: str) -> DataFrame:
    found = papers.records_of(_feeds(spark, d))
    return found.select("key", "arxiv_id", "version", "title", F.size("authors").alias("authors"), "year")


def q_licenses(spark: SparkSession, d: str) -> DataFrame:
    """Licences of metadata records; those that a new look-up lacks are carried over."""
    best = corpus.best_variant(load(spark, d, "manifests"), [F.asc("created_at"), F.asc("source_path")])
    xml = F.concat(F.lit('<r xmlns:a="urn:a"><a:license> http://creativecommons.org/'), F.col("source_kind"), F.lit(" </a:license></r>"))
    fresh = best.select(F.col("doc_id").alias("key"), papers.license_of(F.when(F.col("n_pages") % 2 == 0, xml).otherwise("<r/>")).alias("license"))
    stored = best.filter("n_pages % 3 = 0").select(F.col("doc_id").alias("key"), F.lit("stored").alias("license"))
    return papers.carried_license(fresh, stored).groupBy("license").agg(F.count("*").alias("papers"))


def q_paper_names(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers, versions, file names and lists of identifiers out of addresses."""
    n = F.lpad(F.col("size_bytes").cast("string"), 9, "0")
    url = F.concat(F.lit("https://arxiv.org/pdf/24"), F.substring(n, 1, 2), F.lit("."), F.substring(n, 5, 5), F.when(F.col("n_pages") > 3, "v3").otherwise(""), F.lit(".PDF"))
    wanted = F.concat(F.lit("ids: "), url, F.lit(", hep-th/9901001 ,"), url)
    return load(spark, d, "manifests").select("source_path", "created_at", T.arxiv_id(url).alias("arxiv_id"), T.arxiv_version(url).alias("version"), T.safe_file_name(F.col("source_path")).alias("file"), F.array_join(T.id_list(wanted), "|").alias("ids"))


def q_headers(spark: SparkSession, d: str) -> DataFrame:
    """What headers of answers say: a file's name, a bare tag, seconds to wait; and an address with parameters."""
    m = load(spark, d, "manifests")
    disposition = F.concat(F.lit('attachment; filename="'), F.col("source_name"), F.lit('"'))
    return m.select(
        "source_path", "created_at", T.disposition_name(disposition).alias("name"), T.bare_etag(F.concat(F.lit('W/"'), F.substring("doc_id", 1, 8), F.lit('"'))).alias("tag"),
        T.retry_after_seconds(F.col("n_pages").cast("string"), F.col("created_at")).alias("wait"), T.retry_after_seconds(F.lit("soon"), F.col("created_at")).alias("no_wait"),
        T.with_query(F.lit("http://x/q?a=1"), name=F.substring("doc_id", 1, 8), n=F.concat(F.col("n_pages").cast("string"), F.lit(" %"))).alias("url"),
    )


def q_retitled(spark: SparkSession, d: str) -> DataFrame:
    """Rendered documents whose title is exchanged; those that do not begin with the old one stay as they are stored."""
    m = load(spark, d, "manifests").filter("title is not null")
    rendered = F.concat(F.lit("# "), F.when(F.col("n_pages") % 2 == 0, F.col("title")).otherwise(F.lit("Other")), F.lit("\n\nbody"))
    return m.select("source_path", "created_at", T.retitled(rendered, F.col("title"), F.lit("New")).alias("text"))


# ------------------------------------------------------------------------------------------------- store


def _stored(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "manifests")
    return m.withColumns({"degraded": F.col("total_seconds") > 60, "ocr_all": F.col("n_pages") % 5 == 0, "config_hash": T.config_hash(F.col("pipeline_version"), F.col("source_kind"))})


def q_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Manifests written to the store by tier, one tier written again, and read back."""
    path = scratch(spark) + "/store"
    rows = _stored(spark, d)
    store.save(rows, path)
    store.save(store.tier(rows).filter("tier = 'variant'").drop("tier").withColumn("title", F.lit("again")), path)
    back = spark.read.parquet(path)
    return back.groupBy("tier").agg(F.count("*").alias("manifests"), F.sum((F.col("title") == "again").cast("long")).alias("again"))


def q_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The best stored variant of every document, complete ones first."""
    return store.corpus(store.tier(_stored(spark, d))).select("doc_id", "tier", "n_pages", "created_at")


def q_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Inputs that need no work: they are stored complete under the same settings."""
    rows = store.tier(_stored(spark, d))
    early = rows.filter("created_at < timestamp_ntz'2024-06-01'")
    return store.cache_hits(rows.select("doc_id", "config_hash", "ocr_all", "source_path", "created_at"), early).select("doc_id", "source_path", "created_at")


def q_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows under the newest title that any manifest of their document gives."""
    rows = load(spark, d, "manifests")
    newest = corpus.latest(rows.filter("title is not null").select("doc_id", "created_at", "source_path", "title"), ["doc_id"], ["created_at"], "source_path").select("doc_id", F.concat(F.lit("new: "), F.col("title")).alias("title"))
    return store.refreshed(rows.select("doc_id", "source_path", "created_at", "title"), newest).groupBy("title").agg(F.count("*").alias("rows"))


def q_found_document(spark: SparkSession, d: str) -> DataFrame:
    """The document that a beginning of its id names."""
    rows = load(spark, d, "manifests")
    prefix = rows.agg(F.min("doc_id")).first()[0][:12]
    return spark.createDataFrame([(prefix, store.find_document(rows, prefix))], "prefix string, doc_id string")


def q_telemetry_files(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry appended to files of JSON lines in two runs and read back."""
    path = scratch(spark) + "/telemetry"
    rows = load(spark, d, "ocr_results").select("sample_id", "category", "seconds", "gen_tokens", "finish_reason", "error", "candidate")
    for failed in (True, False):
        store.append_telemetry(rows.filter(F.col("error").isNotNull() == failed), path)
    back = store.read_telemetry(spark, path)
    return back.groupBy("category").agg(F.count("*").alias("records"), F.count("error").alias("errors"), F.round(F.sum("seconds"), 3).alias("seconds"), F.sum("gen_tokens").alias("tokens"))


# ------------------------------------------------------------------------------------------------- index


def _versions(spark: SparkSession, d: str, then: bool) -> DataFrame:
    c = load(spark, d, "chunks").filter("doc_id is not null").select("doc_id", "chunk_id", F.col("start"), "text", "indexed_at")
    c = c.filter("indexed_at < timestamp_ntz'2024-09-01'") if then else c
    return c.join(c.groupBy("doc_id").agg(F.concat(F.max("indexed_at").cast("string"), F.lit("#"), F.count("*").cast("string")).alias("key")), "doc_id").drop("indexed_at")


def q_index_run(spark: SparkSession, d: str) -> DataFrame:
    """An index built at a date, committed, then brought to the present: the report, and what is searchable before and
    after the commit."""
    made = index.ChunkIndex(spark, scratch(spark) + "/index")
    then, now = _versions(spark, d, True), _versions(spark, d, False)
    index.update_index(made, then.drop("key"), then.select("doc_id", "key").distinct())
    before = made.stats().first()
    gone = now.select("doc_id").distinct().filter(F.col("doc_id").startswith("0"))
    made.remove(gone)
    waiting = made.pending()
    kept = now.join(gone, "doc_id", "left_anti")
    done = index.update_index(made, kept.drop("key"), kept.select("doc_id", "key").distinct()).first().asDict()
    row = {"documents_before": before.searchable_documents, "chunks_before": before.searchable_chunks, "waiting": waiting} | done | made.stats().first().asDict()
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long'}" for k, v in row.items()))


def q_newest_versions(spark: SparkSession, d: str) -> DataFrame:
    """Of chunk versions in batches of months those of each document's last batch; a document may be removed by it."""
    c = load(spark, d, "chunks").filter("doc_id is not null").select("doc_id", "chunk_id", F.date_format("indexed_at", "yyyyMM").cast("bigint").alias("seq"))
    rows = c.withColumns({"stem": F.lit("s"), "deleted": (F.conv(F.substring("doc_id", 1, 1), 16, 10).cast("int") + F.col("seq")) % 5 == 0})
    return index.newest_versions(rows).select("doc_id", "chunk_id", "seq")


# ------------------------------------------------------------------------------------------------- scorer logs


def _log(spark: SparkSession, d: str) -> DataFrame:
    """(log, line, text): a scorer's log per category, with a section per candidate and a summary."""
    rows = load(spark, d, "ocr_results").filter("candidate is not null and category is not null and sample_id is not null")
    own = rows.groupBy("category", "candidate").agg(F.count("*").alias("n"), F.count("error").alias("bad"), F.sort_array(F.collect_set(F.when(F.col("error").isNotNull(), F.col("sample_id")))).alias("failed"))
    good = F.format_string("%d.%d", F.floor((F.col("n") - F.col("bad")) * 100 / F.col("n")), F.floor((F.col("n") - F.col("bad")) * 1000 / F.col("n")) % 10)
    c = F.col("candidate")
    section = F.concat(
        F.array(F.concat(F.lit("Candidate: "), c)),
        F.transform("failed", lambda x: F.concat(F.lit("  [FAIL] Test "), x, F.lit(" on "), c, F.lit(" on page 1"))),
        F.array(F.concat(F.lit("  [ERROR] no answer for "), c), F.concat(F.lit("  Average Score: "), good, F.lit("% (95% CI: [1.5%, 98.5%]) over "), F.col("n").cast("string"), F.lit(" tests."))),
    )
    summary = F.array(
        F.concat(c, F.lit(" : Average Score: "), good, F.lit("% ± 2.5%")), F.concat(F.lit("    table : "), good, F.lit("% average pass rate over "), F.col("n").cast("string"), F.lit(" tests")),
        F.concat(F.lit("        pages.jsonl : "), good, F.lit("% ("), (F.col("n") - F.col("bad")).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" tests)")),
    )
    parts = own.select(F.col("category").alias("log"), F.explode(F.array(F.struct(F.lit(0).alias("part"), section.alias("ls")), F.struct(F.lit(2).alias("part"), summary.alias("ls")))).alias("x"), "candidate")
    middle = own.select(F.col("category").alias("log"), F.struct(F.lit(1).alias("part"), F.array(F.lit("Final Summary with 95% CI")).alias("ls")).alias("x"), F.lit("").alias("candidate")).distinct()
    whole = parts.unionByName(middle).groupBy("log").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("x.part", "candidate", "x.ls"))), lambda y: y["ls"])).alias("ls"))
    return whole.select("log", F.posexplode("ls").alias("line", "text")).withColumn("line", F.col("line") + 1)


def q_log_scores(spark: SparkSession, d: str) -> DataFrame:
    return logs.scores(_log(spark, d))


def q_log_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return logs.breakdown(_log(spark, d)).na.fill({"rate": -1.0, "passed": -1})


def q_log_failures(spark: SparkSession, d: str) -> DataFrame:
    return logs.failed_tests(_log(spark, d), load(spark, d, "ocr_results").select("sample_id"))


def q_log_errors(spark: SparkSession, d: str) -> DataFrame:
    return logs.errors(_log(spark, d))


# ------------------------------------------------------------------------------------------------- suites and scores


def _tests(spark: SparkSession, d: str) -> DataFrame:
    """Test rows: one per page and candidate that read it."""
    rows = load(spark, d, "ocr_results").filter("doc_id is not null and sample_id is not null and category is not null and candidate is not null")
    kind = F.when((F.col("page_no") == 1) & (F.col("candidate") == "pica-7b"), "baseline").otherwise("present")
    return rows.select(F.col("doc_id").alias("pdf"), "category", F.concat_ws("#", "sample_id", "candidate", "result_id").alias("id"), kind.alias("type"))


def q_samples(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.samples(_tests(spark, d), ["two_column", "tiny_print", "archive_scans"])


def q_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Tests by type, after files without a baseline test got one."""
    return evaluation.with_baseline(_tests(spark, d)).groupBy("category", "type").agg(F.count("*").alias("tests"))


def q_unit_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pass rates of candidates by category, from the tests that failed."""
    tests = _tests(spark, d)
    rows = load(spark, d, "ocr_results").filter("candidate is not null")
    failed = rows.select("candidate", F.when(F.col("error").isNotNull(), F.concat_ws("#", "sample_id", "candidate", "result_id")).alias("test")).distinct()
    units = evaluation.unit_scores(tests, failed)
    return units.groupBy("candidate", "group").agg(F.count("*").alias("tests"), F.round(F.avg("value"), 6).alias("score"))


def q_test_files(spark: SparkSession, d: str) -> DataFrame:
    """Tests written as files of JSON lines by category and read back."""
    path = scratch(spark) + "/tests"
    for name in ("archive_scans", "tiny_print"):
        _tests(spark, d).filter(F.col("category") == name).drop("category").coalesce(1).write.json(f"{path}/{name}.jsonl")
    back = evaluation.read_tests(spark, f"{path}/*.jsonl")
    return back.groupBy("category", "type").agg(F.count("*").alias("tests"))


def q_output_paths(spark: SparkSession, d: str) -> DataFrame:
    """Where a scorer finds the outputs of a candidate, and how many of them there are."""
    rows = load(spark, d, "ocr_results").filter("candidate is not null and sample_id is not null")
    path = evaluation.output_path(F.col("candidate"), F.concat("category", F.lit("/"), "sample_id", F.lit(".pdf")))
    return rows.groupBy(path.alias("path")).agg(F.count("*").alias("outputs"))


def q_cluster_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "ocr_results").filter("doc_id is not null and page_no is not null")
    return rows.groupBy(evaluation.cluster_key(F.col("doc_id"), F.col("page_no") - 1).alias("cluster")).agg(F.count("*").alias("rows"))


def q_truth_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of scans against the true pages beside them; documents whose numbers of pages differ are told."""
    rows = P.latest_attempts(load(spark, d, "ocr_results")).select("result_id").join(load(spark, d, "ocr_results").filter("doc_id is not null and page_no is not null and candidate = 'marten-2b'"), "result_id")
    records = rows.groupBy("doc_id", F.col("page_no").alias("page")).agg(F.max_by("text", "result_id").alias("text"))
    size = load(spark, d, "manifests").filter("source_pages is not null").groupBy("doc_id").agg(F.max("source_pages").alias("n"))
    truth = size.select("doc_id", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n"))), lambda i: F.concat(F.lit("page "), i.cast("string"))).alias("pages"))
    return evaluation.truth_pages(records, truth).groupBy("doc_id", "complete").agg(F.count("*").alias("pages"), F.max("truth").alias("last"))


def q_headline(spark: SparkSession, d: str) -> DataFrame:
    """Mean seconds of the headline's units: documents that were read partly are scored apart."""
    partly = load(spark, d, "manifests").filter("n_pages < source_pages").select(F.col("doc_id").alias("cluster")).distinct()
    units = load(spark, d, "ocr_results").filter("doc_id is not null").select("candidate", F.col("doc_id").alias("cluster"), "seconds")
    return evaluation.without_clusters(units, partly).groupBy("candidate").agg(F.count("*").alias("units"), F.round(F.avg("seconds"), 6).alias("seconds"))


def q_long_enough(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.long_enough(load_even(spark, d, "ocr_results"), "text", 1_000).groupBy("candidate").agg(F.count("*").alias("pages"))


def _means(rows: DataFrame) -> DataFrame:
    return rows.filter("candidate is not null").groupBy("candidate").agg(F.round(F.avg("seconds"), 6).alias("mean"), F.count("*").alias("n"))


def q_merged_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of an early run, replaced where a candidate was scored again on archive scans."""
    rows = load(spark, d, "ocr_results")
    return evaluation.merged_scores(_means(rows.filter("ts < timestamp_ntz'2024-09-01'")), _means(rows.filter("category = 'archive_scans' and candidate < 'n'")))


def q_metric_map(spark: SparkSession, d: str) -> DataFrame:
    """Estimates kept as a map per candidate, one row each again."""
    rows = load(spark, d, "ocr_results").filter("candidate is not null")
    e = lambda c: F.struct(F.round(F.avg(c), 6).alias("mean"), F.round(F.min(c).cast("double"), 6).alias("low"), F.round(F.max(c).cast("double"), 6).alias("high"), F.count(c).alias("n"))
    kept = rows.groupBy("candidate").agg(F.create_map(F.lit("seconds"), e("seconds"), F.lit("tokens"), e(F.col("gen_tokens").cast("double"))).alias("metrics"))
    return evaluation.exploded_scores(kept)


def q_covers_all(spark: SparkSession, d: str) -> DataFrame:
    """Answers to requests of page texts that do not carry each place exactly once."""
    rows = load(spark, d, "chunks").filter("doc_id is not null").select("doc_id", F.coalesce("first_page", F.lit(0)).alias("at"))
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("size"))
    return evaluation.covers_all(rows.join(sizes, "doc_id"), "doc_id", "at", "size")


def q_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a second round that the first had too, and those added."""
    rows = load(spark, d, "ocr_results").filter("doc_id is not null").select(F.col("doc_id").alias("cluster"), "candidate")
    return evaluation.shared_and_added(rows.filter("candidate = 'pica-7b'"), rows.filter("candidate = 'quill-xl'"))


def q_second_round(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that no verdict parts from the best, but that a second round lacks."""
    from foliant.plans.queries import q_separation

    second = load(spark, d, "ocr_results").filter("category = 'tiny_print' and candidate > 'p'").select("candidate").distinct()
    return report.not_in_second_round(q_separation(spark, d), second)


def q_score_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "ocr_results").filter("sample_id is not null and candidate is not null")
    return report.score_gate(rows.filter("error is null").select("candidate", "sample_id"), rows.filter("category = 'archive_scans'").select("sample_id"))


def q_run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a run that began when half of the pages had been read."""
    rows = load(spark, d, "ocr_results").filter("sample_id is not null and candidate is not null")
    return telemetry.run_counters(rows.select("sample_id"), rows.filter("ts < timestamp_ntz'2024-09-01' and error is null"), rows.filter("ts >= timestamp_ntz'2024-09-01'"))


def q_attempts(spark: SparkSession, d: str) -> DataFrame:
    """The ladder of attempts of every page that was tried more than once, and whether its last one may stand."""
    rows = load(spark, d, "ocr_results").filter("attempts > 1").select("result_id", F.explode(telemetry.attempt_ladder(F.lit(2048), F.col("attempts") - 1)).alias("a"), telemetry.acceptable(F.col("finish_reason"), F.col("text")).alias("stands"))
    return rows.select("result_id", F.col("a.attempt").alias("attempt"), F.col("a.max_tokens").alias("max_tokens"), F.round("a.temperature", 3).alias("temperature"), "stands")


def q_formats(spark: SparkSession, d: str) -> DataFrame:
    """Figures of candidates as a report prints them."""
    rows = load(spark, d, "ocr_results").filter("candidate is not null").groupBy("candidate").agg(F.round(F.avg("seconds"), 6).alias("mean"), F.min("seconds").alias("low"), F.max("seconds").alias("high"), F.round(F.count("error") / F.count("*"), 6).alias("failed"))
    return report.formatted(rows, "candidate", "mean", "low", "high", "failed")


def q_medians(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.medians(load(spark, d, "ocr_results"), "candidate", "seconds").withColumn("median", F.round("median", 6))


def q_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods by how often they were used, the most common first."""
    return telemetry.most_common(load(spark, d, "segments"), "method")


def q_page_records(spark: SparkSession, d: str) -> DataFrame:
    """Page rows of a document's manifest, from what a model returned."""
    rows = telemetry.page_record(load_even(spark, d, "ocr_results"), F.col("page_no"), F.col("text"), F.col("seconds"), F.col("candidate"))
    return rows.select("result_id", "index", "method", "n_chars", "seconds", "model")


# ------------------------------------------------------------------------------------------------- statistics


def q_compare(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in pairs: the difference of seconds on common pages, its p-value, and whether its interval holds it."""
    scores = P.page_scores(load(spark, d, "ocr_results"), F.col("seconds")).filter("category is not null").withColumn("half", F.substring("unit", 1, 1).isin(*"01234567"))
    t = statistics.compare(scores, "candidate", "unit", "value", "category", "half")
    held = F.coalesce(F.col("diff").between(F.col("low"), F.col("high")) & (F.col("low") < F.col("high")), F.col("low").isNull() & (F.col("n_clusters") < 2))
    return t.select("a", "b", F.round("diff", 6).alias("diff"), F.round("p_value", 6).alias("p_value"), "n", "n_clusters", held.alias("held"))


def q_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Means of seconds by category with simple intervals."""
    t = evaluation.simple_bootstrap(load(spark, d, "ocr_results").filter("category is not null"), ["category"], "seconds", n=400)
    return t.select("category", F.round("mean", 6).alias("mean"), (F.col("low") <= F.col("mean")).alias("low_below"), (F.col("mean") <= F.col("high")).alias("high_above"))


def q_pools(spark: SparkSession, d: str) -> DataFrame:
    """Strata of documents per candidate and year of reading, strata of one document pooled."""
    rows = load(spark, d, "ocr_results").filter("candidate is not null and doc_id is not null and ts is not null").groupBy("candidate", "doc_id").agg(F.date_format(F.min("ts"), "yyyyMMdd").alias("day"))
    return statistics.collapsed_strata(rows, ["candidate"], "day").select("candidate", "doc_id", F.when(F.col("pool") == "\u0000single", "pooled").otherwise(F.col("pool")).alias("pool"))


def q_variants(spark: SparkSession, d: str) -> DataFrame:
    """An old and a new adapter on the pages both read: mean difference and blank outputs by category."""
    rows = load(spark, d, "ocr_results")
    old, new = (P.page_scores(rows.filter(F.col("candidate") == c), F.struct("seconds", evaluation.blank_output(F.col("text")).alias("blank"))) for c in ("marten-2b", "pica-7b"))
    return statistics.variants(old, new).select("category", "pages", F.round("diff", 6).alias("diff"), "blank_old", "blank_new")


# ------------------------------------------------------------------------------------------------- identities, vectors


def q_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Canonical identities of embedders; the candidates stand for models."""
    rows = load(spark, d, "ocr_results").filter("candidate is not null").select("candidate").distinct()
    return rows.select("candidate", T.fingerprint(model=F.col("candidate"), dims=F.lit(64), instruction=F.lit("find")).alias("fingerprint"))


def q_suites(spark: SparkSession, d: str) -> DataFrame:
    """Identity of a test suite per category: a digest of its sorted samples."""
    rows = load(spark, d, "ocr_results").filter("category is not null and sample_id is not null")
    return evaluation.suite_identity(rows, "category", "sample_id")


def q_subset_ids(spark: SparkSession, d: str) -> DataFrame:
    names = load(spark, d, "ocr_results").filter("category is not null").select("category").distinct()
    return names.select("category", T.subset_id(F.lit("bench"), F.col("category"), F.lit(25), F.lit(0)).alias("subset"))


def q_base64(spark: SparkSession, d: str) -> DataFrame:
    """Vectors sent as base64 and decoded again."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import numpy as np

        for f in frames:
            yield pd.DataFrame({"vec_id": f["vec_id"], "b": [base64.b64encode(np.asarray(v, dtype="<f4").tobytes()).decode() for v in f["embedding"]]})

    sent = load(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(packed, "vec_id long, b string")
    v = sent.select("vec_id", decoded_base64("b").alias("v"))
    return v.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


def q_half_precision(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors in half precision: how many numbers each has, and whether its length is 1 within its precision."""
    from foliant.functions.vectors import half_precision

    v = load(spark, d, "embeddings").select("vec_id", half_precision("embedding").alias("v"))
    return v.select("vec_id", F.size("v").alias("n"), (F.abs(T.dot(F.col("v"), F.col("v")) - 1) < 2e-3).alias("unit"))


def q_documents_of_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of questions met with the documents that were given; contexts of others are told."""
    from foliant.plans.queries import q_hybrid

    given = load(spark, d, "manifests").filter("n_pages = source_pages").select("doc_id").distinct()
    return evaluation.given_documents(q_hybrid(spark, d), given).groupBy("given").agg(F.count("*").alias("contexts"), F.countDistinct("doc_id").alias("documents"))


def queries() -> dict[str, Query]:
    return {n: f for n, f in globals().items() if n.startswith("q_")}
