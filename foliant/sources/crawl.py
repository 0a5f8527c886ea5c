"""Crawling on the driver: records are fetched one by one, kept with their metadata, failures recorded."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from foliant.errors import SourceUnavailable
from foliant.sources.files import gzip_kind, is_tar_block


class RateLimited(SourceUnavailable):
    """The source asks to stop."""


class Fetched(NamedTuple):
    key: str
    path: str
    format: str
    reused: bool


SUFFIX = {"pdf": ".pdf", "latex-archive": ".tar.gz", "latex": ".tex.gz", "tar": ".tar", "tex": ".tex"}


def classify(body: bytes, name: str | None = None) -> str | None:
    """pdf, latex-archive, latex (one gzipped file), tar or tex, from the bytes; null if unusable. A served name only
    decides for text that could be TeX."""
    if body.startswith(b"%PDF-"):
        return "pdf"
    if body[:2] == b"\x1f\x8b":
        return {"tar": "latex-archive", "tex": "latex"}.get(gzip_kind(body))
    if is_tar_block(body[:512]):
        return "tar"
    head = body[:1024].lstrip()[:15].lower()
    if head.startswith((b"<!doctype html", b"<html")):
        return None
    return "tex" if (name or "").lower().endswith(".tex") or b"\\document" in body[:1024] or b"\\input" in body[:1024] else None


def fetch(key: str, folder: str, get: Callable[[str, str], bytes], formats: Iterable[str] = ("source", "pdf")) -> Fetched:
    """The first format that gives a usable body; a file that is there is used again."""
    stem = key.replace("/", "_")
    for s, kind in ((s, k) for k, s in SUFFIX.items()):
        if os.path.exists(path := os.path.join(folder, stem + s)):
            return Fetched(key, path, kind, True)
    problem = "nothing to fetch"
    for f in formats:
        try:
            body = get(key, f)
        except RateLimited:
            raise
        except SourceUnavailable as e:
            problem = str(e)
            continue
        kind = classify(body)
        if kind is None:
            problem = f"{f}: not a document"
            continue
        path = os.path.join(folder, stem + SUFFIX[kind])
        with open(path + ".part", "wb") as h:
            h.write(body)
        os.replace(path + ".part", path)
        return Fetched(key, path, kind, False)
    raise SourceUnavailable(f"{key}: {problem}")


def write_sidecar(path: str, metadata: dict) -> None:
    """Metadata beside the file; an earlier licence is kept where the new lookup has none."""
    target = path + ".meta.json"
    if os.path.exists(target):
        with open(target) as h:
            old = json.load(h)
        metadata = metadata | {"license": metadata.get("license") or old.get("license")}
    with open(target + ".part", "w") as h:
        json.dump(metadata, h)
    os.replace(target + ".part", target)


def crawl(spark: SparkSession, records: Iterable[tuple[str, dict]], folder: str, get: Callable[[str, str], bytes], limit: int) -> tuple[DataFrame, DataFrame]:
    """(fetched, failures): a bad record is recorded and skipped, a rate limit stops and the rest was not attempted."""
    done, failed, stopped = [], [], False
    for i, (key, metadata) in enumerate(records):
        if i >= limit:
            break
        if stopped:
            failed.append((key, "not attempted"))
            continue
        try:
            got = fetch(key, folder, get)
            write_sidecar(got.path, metadata)
            done.append(tuple(got))
        except RateLimited as e:
            stopped = True
            failed.append((key, str(e)))
        except SourceUnavailable as e:
            failed.append((key, str(e)))
    return spark.createDataFrame(done, "key string, path string, format string, reused boolean"), spark.createDataFrame(failed, "key string, problem string")


@pandas_udf(T.StringType())
def download_kind(body: pd.Series, name: pd.Series) -> pd.Series:
    """`classify` for columns of bytes and served names; null bodies are unusable."""
    return pd.Series([classify(bytes(b), n) if b is not None else None for b, n in zip(body, name)], dtype="object")
