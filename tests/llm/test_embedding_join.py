import numpy as np
import pytest

from karyospark.llm import embedding_join as E


def plain(rows, least=0.98):
    """Links, least member reached: by comparing all rows."""

    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    link = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is not None and la == lb and ok(a) and ok(b) and len(a) == len(b):
                x, y = (np.asarray(v, np.float32).astype(float) for v in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    link[i].append(j)
                    link[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(link[i]), c, c == rows[i][0]))
    return sorted(out)


def clustered(rng, dims=64, clusters=6, each=30):
    rows = []
    for c in range(clusters):
        centre = rng.standard_normal(dims)
        for _ in range(each):
            v = centre + rng.standard_normal(dims) * rng.choice([0.02, 0.1, 0.14, 0.2])
            rows.append(v.tolist())
    return rows


@pytest.mark.parametrize(("limit", "dims"), [(4096, 64), (4096, 20), (8, 64)])
def test_all_links(spark, monkeypatch, limit, dims):
    monkeypatch.setattr(E, "CELL_ROWS", limit)
    rng = np.random.default_rng(3)
    rows = [(i, v, i % 2) for i, v in enumerate(clustered(rng, dims))]
    got = E.embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, got)) == plain(rows)
    assert sum(r.n_links for r in got) > 300


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 2.0], 1), (8, [1.0, float("nan"), 2.0], 1), (9, [1.0, float("inf"), 2.0], 1), (10, [2.0, 4.0, 6.0], 1), (11, [1e-30, 2e-30, 3e-30], 1), (12, [1.0, 2.0], 1), (13, v, 2), (14, [-1.0, -2.0, -3.0], 1)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id bigint, embedding array<float>, label int, cid int, n int")
    assert sorted(map(tuple, E.embedding_links(df).collect())) == plain(rows)
    assert E.embedding_links(df.limit(0)).count() == 0


def test_query_on_the_small_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted(map(tuple, E.op4_subspace_embedding_links(spark, d).collect())) == plain(rows)
