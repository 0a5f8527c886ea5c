import pytest

#: Extra columns whose names the operators use inside.
CLASHING = ("k", "t", "g", "n", "p", "q", "rank", "score2", "level", "kept", "piece", "start2", "end", "part", "stretch", "word", "value", "key", "grp", "rule", "share", "tokens", "container", "__text", "__salt", "__rows")


@pytest.fixture
def with_clashes():
    from pyspark.sql import functions as F

    def add(df, but=()):
        return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns and c not in but})

    return add
