"""Two- and three-dimensional views of the texts of a request, with clusters: one request is one group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .clustering import closest, moved, spread_start
from .vectors import sound_vectors

#: Rows whose distances to all others are at hand at once: they stay in the processor's cache.
TILE = 128
#: Forces of all pairs are added up in single precision; coordinates, and how near neighbours are, have double.
SINGLE = np.float32
#: Texts of a request; neighbour graphs hold the square of it.
MOST_TEXTS = 2000
POINTS = "request long, place long, x double, y double, z double, cluster int"


def principal(x: np.ndarray, dims: int) -> np.ndarray:
    """Centred rows along their main directions, each with its greatest loading positive; missing directions are 0."""
    x = x - x.mean(axis=0)
    _, _, main = np.linalg.svd(x, full_matrices=False)
    main = main[:dims]
    main = main * np.where(main[np.arange(len(main)), np.abs(main).argmax(axis=1)] < 0, -1, 1)[:, None]
    out = np.zeros((len(x), dims))
    out[:, : len(main)] = x @ main.T
    return out


def squared_distances(x: np.ndarray) -> np.ndarray:
    n = (x * x).sum(axis=1)
    d = np.maximum(n[:, None] + n[None, :] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, 0)
    return d


def bisected(goal: float, value: Callable[[np.ndarray], np.ndarray], rows: int, steps: int = 64) -> np.ndarray:
    """For each row the argument at which a falling function of it has the value ``goal``."""
    low, high, at = np.zeros(rows), np.full(rows, np.inf), np.ones(rows)
    for _ in range(steps):
        over = value(at) > goal
        low, high = np.where(over, at, low), np.where(over, high, at)
        at = np.where(np.isinf(high), at * 2, (low + high) / 2)
    return at


def neighbour_odds(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Odds that a row picks another as its neighbour, Gaussian in the distance, each row's width such that the odds are
    as spread as over ``perplexity`` equal neighbours; made symmetric, all together 1."""
    n = len(d)
    other = ~np.eye(n, dtype=bool)
    shifted = np.where(other, d - np.where(other, d, np.inf).min(axis=1)[:, None], 0)

    room = np.empty((2, min(TILE, n), n))

    def odds(beta: np.ndarray, a: int, b: int) -> np.ndarray:
        p = np.multiply(shifted[a:b], -beta[a:b, None], out=room[0, : b - a])
        return np.multiply(np.exp(p, out=p), other[a:b], out=p)

    def entropy(beta: np.ndarray) -> np.ndarray:
        out = np.empty(n)
        for a in range(0, n, TILE):
            b = min(a + TILE, n)
            p = odds(beta, a, b)
            total = p.sum(axis=1)
            out[a:b] = np.log(total) + beta[a:b] * np.multiply(p, shifted[a:b], out=room[1, : b - a]).sum(axis=1) / total
        return out

    beta, p = bisected(np.log(perplexity), entropy, n), np.empty((n, n))
    for a in range(0, n, TILE):
        b = min(a + TILE, n)
        p[a:b] = odds(beta, a, b)
    p /= p.sum(axis=1)[:, None]
    return (p + p.T) / (2 * n)


def tiles(y: np.ndarray, room: np.ndarray, more: float = 0.0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, squared distances and ``more`` to all rows, room of the same shape): all pairs, a
    few rows at a time."""
    n = len(y)
    square = (y * y).sum(axis=1)[:, None]
    left = np.concatenate([-2 * y, square + more, np.ones((n, 1))], axis=1).astype(SINGLE)
    right = np.ascontiguousarray(np.concatenate([y, np.ones((n, 1)), square], axis=1).astype(SINGLE).T)
    for a in range(0, n, TILE):
        b = min(a + TILE, n)
        yield a, b, np.maximum(np.matmul(left[a:b], right, out=room[0, : b - a]), more, out=room[0, : b - a]), room[1, : b - a]


def tsne(x: np.ndarray, dims: int, perplexity: float | None = None, steps: int = 1000, early: int = 250) -> np.ndarray:
    """t-SNE from the principal components, by gradient steps with momentum and a gain per number; the first ``early``
    steps pull neighbours together twelve times as hard."""
    n = len(x)
    p = np.maximum(neighbour_odds(squared_distances(x), min(30.0, n // 2) if perplexity is None else perplexity), 1e-12).astype(SINGLE)
    y = principal(x, dims)
    y = y / max(y[:, 0].std(), 1e-12) * 1e-4
    rate, speed, gain = max(n / 12 / 4, 50.0), np.zeros_like(y), np.ones_like(y)
    room = np.empty((2, min(TILE, n), n), SINGLE)
    for step in range(steps):
        one = np.column_stack([y, np.ones(n)]).astype(SINGLE)
        attract, repel, total = np.empty((n, dims + 1)), np.empty((n, dims + 1)), 0.0
        for a, b, near, product in tiles(y, room, 1.0):
            np.reciprocal(near, out=near)
            near[np.arange(b - a), np.arange(a, b)] = 0
            total += float(near.sum(dtype=float))
            attract[a:b] = np.multiply(near, p[a:b], out=product) @ one
            repel[a:b] = np.multiply(near, near, out=product) @ one
        force = (12 if step < early else 1) * attract - repel / max(total, 1e-300)
        pull = 4 * (force[:, -1:] * y - force[:, :-1])
        against = speed * pull < 0
        gain = np.maximum(np.where(against, gain + 0.2, gain * 0.8), 0.01)
        speed = (0.5 if step < early else 0.8) * speed - rate * gain * pull
        y = y + speed
        y = y - y.mean(axis=0)
    return y


def fuzzy_graph(x: np.ndarray, neighbours: int = 15) -> np.ndarray:
    """How far each pair of rows belongs together, 0 to 1: each row is sure of its nearest neighbour, and beyond it the
    membership falls so that all of its neighbours' add up to the logarithm of their number; the two views are united."""
    n = len(x)
    k = min(neighbours, n - 1)
    d = np.sqrt(squared_distances(x))
    np.fill_diagonal(d, np.inf)
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, at, axis=1)
    nearest = np.where(near > 0, near, np.inf).min(axis=1)
    beyond = np.maximum(near - np.where(np.isinf(nearest), 0, nearest)[:, None], 0)
    scale = bisected(max(np.log2(k), 1e-3), lambda s: np.exp(-beyond * s[:, None]).sum(axis=1), n)
    # A row whose neighbours are all equally near never falls below its goal: the scale stays finite.
    member = np.zeros((n, n))
    np.put_along_axis(member, at, np.exp(-beyond * np.minimum(scale, 1e6)[:, None]), axis=1)
    return member + member.T - member * member.T


#: The curve 1 / (1 + A d ** (2 B)) that is flat up to a distance of 0.1 and falls off over 1.
CURVE_A, CURVE_B = 1.576943, 0.895061


def umap(x: np.ndarray, dims: int, neighbours: int = 15, steps: int = 500, apart: float = 5.0) -> np.ndarray:
    """UMAP: the fuzzy graph laid out by falling gradient steps, members attracted along the curve, all pairs repelled
    as by ``apart`` random pairs for each attraction."""
    n = len(x)
    graph = fuzzy_graph(x, neighbours)
    y = principal(x, dims)
    y = 10 * y / max(np.abs(y).max(), 1e-12)
    push = apart * graph.sum(axis=1)[:, None] / n
    # Members are few: what differs for them from mere repulsion is added edge by edge.
    i, j = np.nonzero(graph * ~np.eye(n, dtype=bool))
    weight, room = graph[i, j], np.empty((2, min(TILE, n), n), SINGLE)
    # No pair moves a point by more than 4; mere repulsion only can in rows where its greatest move, at a distance of
    # sqrt(0.001), does.
    limited = 2 * CURVE_B * push[:, 0] / (2 * np.sqrt(0.001)) > 4

    def capped(force: np.ndarray, d: np.ndarray) -> np.ndarray:
        return force * np.minimum(1, 4 / np.maximum(np.abs(force) * np.sqrt(d), 1e-12))

    for step in range(steps):
        one = np.column_stack([y, np.ones(n)]).astype(SINGLE)
        force = np.empty((n, dims + 1))
        for a, b, d, away in tiles(y, room):
            np.maximum(d, 1e-9, out=d)
            np.exp(np.multiply(np.log(d, out=away), CURVE_B, out=away), out=away)
            away *= CURVE_A
            away += 1
            hubs = np.flatnonzero(limited[a:b])
            far = d[hubs]
            away *= np.add(d, 0.001, out=d)
            np.divide(2 * CURVE_B, away, out=away)
            if len(hubs):
                away[hubs] = capped(away[hubs] * push[a + hubs], far) / push[a + hubs]
            away[np.arange(b - a), np.arange(a, b)] = 0
            force[a:b] = (away @ one) * push[a:b]
        d = ((y[i] - y[j]) ** 2).sum(axis=1)
        safe = np.maximum(d, 1e-9)
        power = safe ** (CURVE_B - 1)
        pull = -2 * CURVE_A * CURVE_B * power / (1 + CURVE_A * power * safe) * weight
        away = 2 * CURVE_B / ((0.001 + safe) * (1 + CURVE_A * power * safe)) * push[i, 0]
        edge = capped(pull + away, d) - capped(away, d)
        moves = force[:, -1:] * y - force[:, :-1] + np.stack([np.bincount(i, edge * (y[i, k] - y[j, k]), n) for k in range(dims)], axis=1)
        y = y + (1 - step / steps) * np.clip(moves, -4, 4)
    return y - y.mean(axis=0)


METHODS = {"PCA": principal, "TSNE": tsne, "UMAP": umap}


def small_clusters(x: np.ndarray, k: int, method: str = "KMeans", batch: int = 1024, rounds: int = 100) -> np.ndarray:
    """The cluster of each row of one request, by the steps of ``clustering.kmeans``."""
    if method not in ("KMeans", "MiniBatchKMeans"):
        raise ValueError(f"unknown method {method}")
    centres, seen = spread_start(x, k), np.zeros(min(k, len(x)))
    for step in range(rounds):
        part = x if method == "KMeans" else x[np.arange(step * batch, (step + 1) * batch) % len(x)] if len(x) > batch else x
        at, _ = closest(part, centres)
        n, sums = np.bincount(at, minlength=len(centres)).astype(float), np.zeros(centres.shape)
        np.add.at(sums, at, part)
        if method == "KMeans":
            after = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        else:
            after, seen = moved(centres, seen, n, sums)
        if np.allclose(after, centres, rtol=0, atol=1e-10):
            break
        centres = after
    return closest(x, centres)[0]


def project_requests(rows: DataFrame, request: str = "request", place: str = "place", vector: str = "embedding", ndim: str = "3D", dim_method: str = "PCA", ncluster: int = 1, clustering_method: str = "KMeans", most: int = MOST_TEXTS) -> DataFrame:
    """request, place, x, y, z, cluster: a point for each text of a request, by its vector.

    One text has x = 0 and nothing else; two or three texts, or ``ndim`` 2D, have x and y; others also z. Clusters (at
    most as many as texts) are those of the whole vectors and are null unless more than one is asked for. Texts without a
    sound vector have no point. A request is what a person has typed in: more than ``most`` texts are an error.
    """
    if dim_method not in METHODS or ndim not in ("2D", "3D"):
        raise ValueError(f"unknown view {dim_method} {ndim}")

    def points(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place", kind="stable")
        n = len(f)
        if n > most:
            raise ValueError(f"request {f['request'].iloc[0]} has {n} texts, more than {most}")
        out = pd.DataFrame({"request": f["request"].to_numpy(), "place": f["place"].to_numpy()})
        x = np.array(f["v"].tolist(), float)
        dims = 1 if n == 1 else 2 if n < 4 or ndim == "2D" else 3
        at = np.zeros((1, 1)) if n == 1 else METHODS[dim_method](x, dims)
        for k, name in enumerate("xyz"):
            out[name] = at[:, k] if k < dims else None
        out["cluster"] = small_clusters(x, ncluster, clustering_method) if ncluster > 1 and n > 1 else None
        return out.astype({"x": float, "y": float, "z": float, "cluster": "Int32"})

    d = sound_vectors(rows, place, vector, None, request).withColumnsRenamed({"id": "place", request: "request"})
    d = d.selectExpr("cast(request AS long) AS request", "place", "v")
    # A number of partitions that is given stays: requests are few bytes, but much work.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, "request").groupBy("request").applyInPandas(points, POINTS)
