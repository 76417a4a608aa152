"""Queries over whole tables and whole paths, against plain Python at sf0.01."""

import numpy as np
import pytest

from geoquilt.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def blobs():
    """(ids, places) of all customers."""
    import pandas as pd

    df = pd.read_parquet(f"{SF}/customer.parquet").sort_values("c_custkey")
    k, n = df["c_custkey"].to_numpy(np.int64), df["c_nationkey"].to_numpy(np.int64)
    return k, np.column_stack([(n % 5) * 4 + (k * 7919 % 10000) / 10000 - 0.0, n // 5 * 4 + (k * 104729 % 10000) / 10000])


def test_dbscan_labels_all_customers(spark, blobs):
    ids, p = blobs
    lon, lat = np.radians(p).T
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    near = 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) * 6371008.8 <= 20_000
    core = near.sum(axis=1) >= 4
    labels, n = np.full(len(p), -1), 0
    for i in range(len(p)):
        if core[i] and labels[i] < 0:
            todo, labels[i] = [i], n
            while todo:
                j = todo.pop()
                for k in np.flatnonzero(near[j]) if core[j] else []:
                    if labels[k] < 0:
                        labels[k] = n
                        todo.append(int(k))
            n += 1
    got = QUERIES["clustersDbscan"](spark, SF).toPandas().sort_values("id")
    assert len(ids) > 600 and got["id"].tolist() == ids.tolist() and got["cluster"].tolist() == labels.tolist()


def test_kmeans_labels_all_customers(spark, blobs):
    ids, p = blobs
    centers, was = p[[i * len(p) // 5 for i in range(5)]], None
    for _ in range(100):
        now = ((p[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        if was is not None and (now == was).all():
            break
        was, centers = now, np.array([p[now == c].mean(axis=0) if (now == c).any() else centers[c] for c in range(5)])
    got = QUERIES["clustersKmeans"](spark, SF).toPandas().sort_values("id")
    assert got["id"].tolist() == ids.tolist() and got["cluster"].tolist() == now.tolist()


@pytest.fixture(scope="module")
def paths():
    """Each user's path."""
    import pandas as pd

    e = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    u, k = e["user_id"].to_numpy(np.int64), e["event_id"].to_numpy(np.int64)
    e["lon"], e["lat"] = u * 37 % 300 - 150.0 + k * 7919 % 20000 / 10000, u * 53 % 140 - 70.0 + k * 104729 % 20000 / 10000
    return {fid: p[["lon", "lat"]].to_numpy() for fid, p in e.groupby("user_id") if len(p) > 1}


def test_crossings_anywhere_in_a_path_are_found(spark, paths):
    def crosses(p):
        halves = p[: len(p) // 2], p[len(p) // 2 :]
        (a, b), (c, d) = ((h[:-1, None], h[1:, None]) for h in halves)
        c, d = c.transpose(1, 0, 2), d.transpose(1, 0, 2)
        cross = lambda x, y: x[..., 0] * y[..., 1] - x[..., 1] * y[..., 0]
        det = cross(b - a, d - c)
        ok = np.abs(det) >= 1e-14
        t, s = (np.where(ok, cross(c - a, x) / np.where(ok, det, 1), -1) for x in (d - c, b - a))
        return bool((ok & (t > 1e-10) & (t < 1 - 1e-10) & (s > 1e-10) & (s < 1 - 1e-10)).any())

    got = QUERIES["booleanCrosses"](spark, SF).toPandas()
    assert dict(zip(got["fid"], got["value"], strict=True)) == {fid: crosses(p) for fid, p in paths.items()}


def test_every_vertex_is_tested_on_its_line(spark, paths):
    got = QUERIES["booleanPointOnLine"](spark, SF).toPandas()
    want = {(fid, k + 1): not any(np.abs(p[k] - p[e]).max() < 1e-12 for e in (0, -1)) for fid, p in paths.items() for k in range(len(p))}
    assert len(got) == len(want) and dict(zip(zip(got["fid"], got["ix"], strict=True), got["value"], strict=True)) == want


def test_paths_that_end_where_they_began(spark, tmp_path):
    """Such a path is parallel to none, and no error for the others."""
    ids = [(1, 0), (1, 20_000), (2, 1), (2, 2), (3, 20_001), (3, 20_002)]
    spark.createDataFrame([(e, k, u) for k, (u, e) in enumerate(ids)], "event_id long, ts long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["fid"]: r["value"] for r in QUERIES["booleanParallel"](spark, str(tmp_path)).collect()}
    assert got == {1: False, 2: True}
