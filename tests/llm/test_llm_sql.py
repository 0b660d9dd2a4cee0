"""Queries with DuckDB SQL against it."""

import duckdb
import numpy as np
import pytest

from blockloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    want = duck.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = want.select(*columns).fetchall()
    assert rows and sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(rows, key=str)


def test_linked_embeddings_against_sql(spark, tmp_path):
    """The tables at hand hold no links at 0.93, so links, chains, copies and unusable vectors are planted here."""
    rng = np.random.default_rng(12)
    x = [rng.standard_normal(64) for _ in range(60)]
    for k in range(120):
        x.append(x[k] + rng.standard_normal(64) * 0.25)
    x = [v.tolist() for v in x] + [x[0].tolist(), x[0].tolist(), [0.0] * 64, None, [float("nan")] * 64, [1.0, None] + [0.0] * 62, [1.0, 0.0]]
    rows = [(i, v, None if i == 5 else i % 60 % 3) for i, v in enumerate(x)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(path)
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as from '{path}/*.parquet'")
    want = duck.sql(f"select vec_id, n_links, component_id, kept from ({queries.oracle_sql()['op3_embedding_dedup']}) order by vec_id").fetchall()
    assert sum(n > 0 for _, n, _, _ in want) > 60 and any(n != 2 and n > 0 for _, n, _, _ in want)
    got = queries.op3_embedding_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == want
