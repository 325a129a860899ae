"""Stored cells against all distances."""

import numpy as np

from passagekit.operators import cells as C
from passagekit.operators import retrieval as R

KIND = "chunk_id string, vector array<double>"


def plain(queries, vectors, k):
    out = []
    for q, v in queries:
        near = sorted((round(float(((np.array(x) - v) ** 2).sum()), 9), c) for c, x in vectors if x is not None and len(x) == len(v))[:k]
        out += [(q, c, i + 1) for i, (_, c) in enumerate(near)]
    return sorted(out)


def clustered(rng, n, dim=8):
    centres = rng.normal(0, 10, (12, dim))
    return [(f"v{i:04d}", (centres[rng.integers(12)] + rng.normal(0, 0.5, dim)).tolist()) for i in range(n)]


def test_cells_are_exact_and_few_are_read(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = clustered(rng, 1500)
    vectors += [(f"w{i}", vectors[i][1]) for i in range(40)] + [("far", [1000.0] * 8), ("null", None), ("short", [1.0, 2.0]), ("hole", [None, *[0.0] * 7])]
    queries = [(i, np.array(x) + rng.normal(0, 0.1, 8)) for i, (_, x) in enumerate(clustered(np.random.default_rng(4), 40))] + [(900, np.full(8, 900.0)), (901, np.array([1.0, 2.5]))]
    C.write_cells(spark.createDataFrame(vectors, KIND), f"{tmp_path}/c")
    cells = C.read_cells(spark, f"{tmp_path}/c")
    probes = {}

    def keep(df, name):
        out = spark.createDataFrame(df.collect(), df.schema)
        probes[name] = out.count()
        return out

    asked = spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], "query_id long, vector array<double>")
    got = C.nearest_in_cells(asked, cells, 7, keep)
    want = plain(queries, [(c, x) for c, x in vectors if x is None or None not in x], 7)
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got.collect()) == want
    read = probes["first-probes"] + probes["more-probes"]
    assert read < 0.5 * len(queries) * len(cells.centres)  # of all cells, for all queries


def test_cells_without_clusters_and_without_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = [(f"v{i}", rng.normal(0, 1, 3).tolist()) for i in range(300)]
    for n in (300, 5, 0):
        C.write_cells(spark.createDataFrame(vectors[:n], KIND), f"{tmp_path}/{n}")
        asked = spark.createDataFrame([(i, vectors[i][1]) for i in range(20)] + [(99, None)], "query_id long, vector array<double>")
        got = C.nearest_in_cells(asked, C.read_cells(spark, f"{tmp_path}/{n}"), 9)
        same = R.nearest(asked, spark.createDataFrame(vectors[:n], KIND), 9)
        rows = lambda df: sorted((r.query_id, r.chunk_id, r["rank"], round(r.distance, 9)) for r in df.collect())
        assert rows(got) == rows(same)
