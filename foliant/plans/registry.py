"""Plug-ins by port and name: built in ones first, then those that installed packages offer."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from importlib.metadata import entry_points

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from foliant.errors import NotConfigured
from foliant.operators.retrieval import word_share

PORTS = ("embedder", "reranker", "converter", "reader", "recogniser", "answerer")
_BUILT_IN: dict[tuple[str, str], Callable] = {}


def register(port: str, name: str) -> Callable[[Callable], Callable]:
    def keep(factory: Callable) -> Callable:
        _BUILT_IN[port, name] = factory
        return factory

    return keep


def available(port: str) -> list[str]:
    offered = [e.name for e in entry_points(group=f"foliant.{port}")]
    return sorted({n for p, n in _BUILT_IN if p == port} | set(offered))


def create(port: str, name: str, **settings) -> Callable:
    """The plug-in `name` of `port`; only the chosen one is imported, built-in names win."""
    if port not in PORTS:
        raise NotConfigured(f"unknown port {port!r}")
    if (port, name) in _BUILT_IN:
        return _BUILT_IN[port, name](**settings)
    for e in entry_points(group=f"foliant.{port}"):
        if e.name == name:
            return e.load()(**settings)
    raise NotConfigured(f"no {port} named {name!r}; there are {', '.join(available(port)) or 'none'}")


def _missing(port: str) -> Callable:
    def factory(**_) -> Callable:
        def refuse(*_a, **_k):
            raise NotConfigured(f"this needs a {port}; choose one in the settings")

        return refuse

    return factory


for _p in PORTS:
    register(_p, "none")(_missing(_p))


@register("embedder", "hashed")
def hashed_embedder(dims: int = 64) -> Callable[[Column], Column]:
    """Deterministic bag of hashed words as a unit vector; a stand-in for a model."""

    @pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            v = np.zeros(dims, dtype="float32")
            for w in (t or "").lower().split():
                v[zlib.crc32(w.encode()) % dims] += 1
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return pd.Series(out)

    return embed


@register("reranker", "word_share")
def word_share_reranker() -> Callable[[Column, Column], Column]:
    return word_share
