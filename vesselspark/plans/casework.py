"""Graph work on cases that fit into one task.

A round of joins costs the same few jobs whether a case has ten edges or ten million.  Cases of up to
``CASE_ROWS`` rows are therefore solved inside a task each, all in one job; only larger ones take the rounds
of ``graphloop``, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .grid import within

#: Rows (edges and questions) of a case that one task may hold.
CASE_ROWS = 200_000
#: Path nodes that a task sends at once.
PATH_NODES = 1 << 18
#: Voxels of balls that a task looks up at once.
BALL_VOXELS = 1 << 20


def by_size(rows: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the cases with at most ``most`` of them, and the list of larger cases (None if there is none)."""
    most = CASE_ROWS if most is None else most
    large = rows.groupBy("case_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("case_id")
    large = stored(large, "large")
    if large.isEmpty():
        return rows, None
    return rows.join(large, "case_id", "left_anti"), large


def in_cases(rows: DataFrame, run: Callable[[pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """``run`` on the rows of each case, in any order; it yields columns, to which ``case_id`` is added."""
    kind = rows.schema["case_id"].dataType.simpleString()

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        for out in run(table):
            columns = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()}
            size = len(next(iter(columns.values())))
            case = pa.repeat(key[0], size)
            yield pa.RecordBatch.from_arrays([case, *columns.values()], ["case_id", *columns])

    work.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.groupBy("case_id").applyInArrow(work, f"case_id {kind}, {schema}")


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.int64, copy=False)


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least of the nodes 0 .. n - 1 that each is joined to by the edges (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def stars(table: pa.Table) -> Iterator[dict]:
    """(u, v) edges of a case: every node but the least of a piece with that one."""
    u, v = _longs(table, "u"), _longs(table, "v")
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    least = least_reached(code[:len(u)], code[len(u):], len(nodes))
    out = np.flatnonzero(least != np.arange(len(nodes)))
    yield {"u": nodes[out], "v": nodes[least[out]]}


def forest(table: pa.Table) -> Iterator[dict]:
    """(src, dst, w) edges of the minimum spanning forest of a case, by (w, src, dst)."""
    src, dst = _longs(table, "src"), _longs(table, "dst")
    w = table["w"].combine_chunks()
    order = np.lexsort((dst, src, w.to_numpy(zero_copy_only=False), ~pc.is_null(w).to_numpy(zero_copy_only=False)))
    nodes, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = code[:len(src)][order].tolist(), code[len(src):][order].tolist()
    root, kept = list(range(len(nodes))), []

    for k in range(len(a)):
        p, q = a[k], b[k]
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[q] = p
            kept.append(k)
    kept = order[np.asarray(kept, dtype=np.int64)]
    yield {"src": src[kept], "dst": dst[kept], "w": w.take(pa.array(kept))}


def _around(a: list, b: list) -> dict:
    near: dict = {}
    for u, v in zip(a, b):
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    return near


def parents(table: pa.Table) -> Iterator[dict]:
    """(node, parent) of a forest (u, v) that hangs from the rows without ``v``."""
    edge = pc.is_valid(table["v"])
    links, tops = table.filter(edge), table.filter(pc.invert(edge))["u"].to_pylist()
    near = _around(links["u"].to_pylist(), links["v"].to_pylist())
    parent: dict = {}
    for top in tops:
        parent[top], open_ = None, [top]
        while open_:
            u = open_.pop()
            for v in near.get(u, ()):
                if v not in parent:
                    parent[v] = u
                    open_.append(v)
    if any(u not in parent for u in near):
        raise ValueError("a tree has no root")
    yield {"node": pa.array(parent.keys(), pa.int64()), "parent": pa.array(parent.values(), pa.int64())}


def hops(table: pa.Table) -> Iterator[dict]:
    """(source, node, path) by fewest edges (u, v) from each row without ``v``; equal lengths: the smaller node list."""
    edge = pc.is_valid(table["v"])
    links, tops = table.filter(edge), table.filter(pc.invert(edge))["u"].to_pylist()
    near = {u: sorted(set(vs)) for u, vs in _around(links["u"].to_pylist(), links["v"].to_pylist()).items()}
    sources, nodes, paths, held = [], [], [], 0

    def send() -> dict:
        return {"source": pa.array(sources, pa.int64()), "node": pa.array(nodes, pa.int64()), "path": pa.array(paths, pa.list_(pa.int64()))}

    for top in tops:
        before, level = {top: None}, [top]
        while level:
            for node in level:
                path, u = [], node
                while u is not None:
                    path.append(u)
                    u = before[u]
                sources.append(top), nodes.append(node), paths.append(path[::-1])
                held += len(path)
                if held >= PATH_NODES:
                    yield send()
                    sources, nodes, paths, held = [], [], [], 0
            # A level is in the order of its paths, so the first to meet a node has the smallest one.
            after = []
            for u in level:
                for v in near.get(u, ()):
                    if v not in before:
                        before[v] = u
                        after.append(v)
            level = after
    yield send()


def ways(table: pa.Table) -> Iterator[dict]:
    """(source, node, dist) of the pairs asked for (rows with ``ask``; ``w`` is how far to go) over the edges (u, v, w)."""
    asked = table["ask"]
    links, pairs = table.filter(pc.invert(asked)), table.filter(asked)
    near: dict = {}
    for u, v, w in zip(links["u"].to_pylist(), links["v"].to_pylist(), links["w"].to_pylist()):
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    goals: dict = {}
    for u, v, w in zip(pairs["u"].to_pylist(), pairs["v"].to_pylist(), pairs["w"].to_pylist()):
        goals.setdefault(u, {})[v] = w
    out: list = []
    for source, want in goals.items():
        most, left = max(want.values()), set(want)
        best, done, heap = {source: 0.0}, set(), [(0.0, source)]
        while heap and left:
            d, u = heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u in left:
                left.discard(u)
                out.append((source, u, d))
            for v, w in near.get(u, ()):
                far = d + w
                if far <= most and far < best.get(v, float("inf")):
                    best[v] = far
                    heappush(heap, (far, v))
    yield {"source": pa.array([o[0] for o in out], pa.int64()), "node": pa.array([o[1] for o in out], pa.int64()), "dist": pa.array([o[2] for o in out], pa.float64())}


def walks(table: pa.Table) -> Iterator[dict]:
    """(q, root, prev, node) of ``labelling.reachable`` in a case; ``what`` tells arcs, starts, closed nodes and gates."""
    part = lambda what: table.filter(pc.equal(table["what"], what)).to_pydict()
    near: dict = {}
    arcs, starts, shut, gates = (part(k) for k in range(4))
    for u, v, deg in zip(arcs["u"], arcs["v"], arcs["deg"]):
        near.setdefault(u, set()).add((v, deg))
    closed: dict = {}
    for q, v in zip(shut["q"], shut["v"]):
        closed.setdefault(q, set()).add(v)
    passes = {(u, v) for u, v, ok in zip(gates["u"], gates["v"], gates["ok"]) if ok is not False}
    barred = set(zip(gates["u"], gates["v"])) - passes
    first: dict = {}
    for q, root, node in zip(starts["q"], starts["u"], starts["v"]):
        first.setdefault(q, []).append((root, node))
    out: list = []
    for q, front in first.items():
        seen = closed.get(q, set()) | {node for _, node in front}
        out += [(q, root, None, node) for root, node in front]
        while front:
            met: dict = {}
            for root, u in front:
                for v, deg in near.get(u, ()):
                    if v not in seen and u <= met.get((root, v), (u, deg))[0]:
                        met[(root, v)] = (u, deg)
            out += [(q, root, u, v) for (root, v), (u, _) in met.items()]
            seen |= {v for _, v in met}
            front = [(root, v) for (root, v), (_, deg) in met.items() if deg is not None and deg >= 3 and (root, v) not in barred]
    kinds = [table["q"].type, pa.int64(), pa.int64(), pa.int64()]
    yield {name: pa.array([o[k] for o in out], kind) for k, (name, kind) in enumerate(zip(("q", "root", "prev", "node"), kinds))}


def exchanges(table: pa.Table) -> Iterator[dict]:
    """``editing.transfer`` by length on the points of a case; ``_spot`` is equal for points at one position."""
    table = table.sort_by([("trace_id", "ascending"), ("seq", "ascending")])
    spot = table["_spot"].combine_chunks().dictionary_encode().indices.to_pylist()
    traces: dict = {}
    for row, t in enumerate(table["trace_id"].to_pylist()):
        traces.setdefault(t, []).append(row)
    seen: set = set()
    while True:
        # Ends that lie on another trace: the least (trace, position) there counts, if it is inside the trace.
        tips = {spot[rows[k]] for rows in traces.values() for k in (0, -1)} - {None}
        here: dict = {}
        for t in sorted(traces):
            for at, row in enumerate(traces[t]):
                if spot[row] in tips:
                    here.setdefault(spot[row], []).append((t, at))
        plan = []
        for t, rows in traces.items():
            for end in (0, 1):
                key = spot[rows[-end]]
                other, at = next(((o, a) for o, a in here.get(key, ()) if o != t), (None, 0))
                size = 0 if other is None else len(traces[other])
                if 0 < at < size - 1 and key not in seen and len(rows) >= min(at, size - at):
                    plan.append((t, end, other, at, key, at <= size // 2))
        low: dict = {}
        for t, end, other, *_ in plan:
            for name in (t, other):
                low[name] = min(low.get(name, (t, end)), (t, end))
        go = [p for p in plan if low[p[0]] == low[p[2]] == p[:2]]
        if not go:
            break
        for t, end, other, at, key, back in go:
            whole = traces[other]
            piece = whole[at + 1:] if back else whole[at - 1::-1]
            traces[other] = whole[:at + 1] if back else whole[at:]
            traces[t] = traces[t] + piece if end else piece[::-1] + traces[t]
            seen.add(key)
    order = pa.array([row for rows in traces.values() for row in rows])
    out = table.drop_columns(["case_id", "_spot"]).take(order).combine_chunks()
    new = {"trace_id": [t for t, rows in traces.items() for _ in rows], "seq": [k for rows in traces.values() for k in range(len(rows))]}
    yield {c: pa.array(new[c], out[c].type) if c in new else out[c].combine_chunks() if out.num_rows else pa.array([], out[c].type) for c in out.column_names}


def finder(spots: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """``find(at)``: for whole positions the row of ``spots`` (distinct) there, -1 where there is none."""
    # An axis is numbered by its own values, so that a key fits however far apart they lie.
    axes, codes = zip(*(np.unique(spots[:, i], return_inverse=True) for i in range(3)))
    key = (codes[0] * len(axes[1]) + codes[1]) * len(axes[2]) + codes[2]
    order = np.argsort(key)
    key = key[order]

    def find(at: np.ndarray) -> np.ndarray:
        code, ok = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for i, values in enumerate(axes):
            place = np.minimum(np.searchsorted(values, at[:, i]), len(values) - 1)
            ok &= values[place] == at[:, i]
            code = code * len(values) + place
        place = np.minimum(np.searchsorted(key, code), len(key) - 1)
        return np.where(ok & (key[place] == code), order[place], -1)

    return find


def surfaces(specs: list[tuple[float, int, int]], spacing: tuple[float, float, float]) -> Callable[[pa.Table], Iterator[dict]]:
    """Average symmetric surface distances (which, region, assd) of a case whose voxels say by ``bits`` in which masks they lie.

    Bit k stands for ``specs[k]``: (which, region, side).  The nearest voxel is looked for at one offset after the other, nearest first,
    as long as no voxel beyond them can be nearer; what is left is searched by cells of growing width.
    """
    scale, reach = np.asarray(spacing, float), 3
    span = range(-reach, reach + 1)
    every = np.array([(a, b, c) for a in span for b in span for c in span])
    length = np.sqrt((every * scale) ** 2 @ np.ones(3))
    order = np.argsort(length, kind="stable")
    sure = scale.min() * (reach + 1) * (1 - 1e-9)  # beyond the cube of offsets all is farther
    offsets = every[order][length[order] <= sure]

    def run(table: pa.Table) -> Iterator[dict]:
        rows = np.stack([table[c].to_numpy().astype(np.int64) for c in "xyz"], axis=1)
        spots, back = np.unique(rows, axis=0, return_inverse=True)
        bits = np.zeros(len(spots), np.int64)
        np.bitwise_or.at(bits, back.reshape(-1), table["bits"].to_numpy())
        find, at = finder(spots), spots * scale
        near: dict[int, np.ndarray] = {}
        keep = len(spots) * len(offsets) <= 1 << 23

        def moved(k: int, some: np.ndarray) -> np.ndarray:
            if not keep:
                return find(spots[some] + offsets[k])
            if k not in near:
                near[k] = find(spots + offsets[k]).astype(np.int32)
            return near[k][some]

        beside = [find(spots + np.array(o)) for o in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]

        def edge(mask: np.ndarray) -> np.ndarray:
            inside = mask.copy()
            for b in beside:
                inside &= (b >= 0) & mask[b]
            return mask & ~inside

        def mean(asked: np.ndarray, target: np.ndarray) -> float:
            open_ = np.flatnonzero(asked)
            dist = np.full(len(spots), np.inf)
            for k in range(len(offsets)):
                there = moved(k, open_)
                hit = (there >= 0) & target[there]
                if hit.any():
                    d = at[open_[hit]] - at[there[hit]]
                    dist[open_[hit]] = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
                    open_ = open_[~hit]
                if not len(open_):
                    break
            search, r = within(at[target]), sure
            while len(open_):
                for i, _, d in search(at[open_], np.full(len(open_), r)):
                    np.minimum.at(dist, open_[i], d)
                open_ = open_[np.isinf(dist[open_])]
                r *= 2
            return float(dist[asked].mean())

        out = []
        for which, region in dict.fromkeys(s[:2] for s in specs):
            a, b = (edge(bits & (1 << specs.index((which, region, side))) != 0) for side in (0, 1))
            if a.any() and b.any():
                out.append((which, region, (mean(a, b) + mean(b, a)) / 2))
        yield {n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate((("which", pa.float64()), ("region", pa.int32()), ("assd", pa.float64())))}

    return run


def _filled(at: np.ndarray, voxel: np.ndarray, rad: np.ndarray, reach: int, axes: list[np.ndarray], keys: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Numbers of the occupied voxels (``spots``; ``keys`` by their places on the ``axes``) in the balls of some points with one cube."""
    off = np.arange(-reach, reach + 1)
    if len(off) ** 3 > len(spots):  # fewer voxels are occupied than the cube has
        step = max(1, BALL_VOXELS // len(spots))
        found = []
        for k in range(0, len(at), step):
            away = spots[None] - voxel[k:k + step, None]
            d = spots[None].astype(float) - at[k:k + step, None]
            near = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]) <= rad[k:k + step, None]
            found.append(np.flatnonzero(((np.abs(away) <= reach).all(axis=2) & (near | (away == 0).all(axis=2))).any(axis=0)))
        return np.unique(np.concatenate(found))
    step = max(1, BALL_VOXELS // len(off) ** 3)
    found = []
    for k in range(0, len(at), step):
        place, square = [], []
        for i, values in enumerate(axes):
            there = voxel[k:k + step, i, None] + off
            spot = np.minimum(np.searchsorted(values, there), len(values) - 1)
            place.append(np.where(values[spot] == there, spot, -1))
            d = there.astype(float) - at[k:k + step, i, None]
            square.append(d * d)
        x, y, z = place[0][:, :, None, None], place[1][:, None, :, None], place[2][:, None, None, :]
        ball = np.sqrt(square[0][:, :, None, None] + square[1][:, None, :, None] + square[2][:, None, None, :]) <= rad[k:k + step, None, None, None]
        ball[:, reach, reach, reach] = True
        ball &= (x >= 0) & (y >= 0) & (z >= 0)
        key = np.unique(((x * len(axes[1]) + y) * len(axes[2]) + z)[ball])
        spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        found.append(spot[keys[spot] == key])
    return np.unique(np.concatenate(found))


def coverage(table: pa.Table) -> Iterator[dict]:
    """``owner`` and ``covered`` for the points of a case, walking its traces by ``place``; only voxels that hold a point are painted."""
    table = table.sort_by([("place", "ascending")])
    column = lambda c: table[c].to_numpy()
    whole = ~np.any([pc.is_null(table[c]).to_numpy() for c in ("_vx", "_vy", "_vz")], axis=0)
    # An axis is numbered by its own values, so that a voxel's key fits however far apart they lie.
    voxel = np.stack([pc.fill_null(table[c], 0).to_numpy() for c in ("_vx", "_vy", "_vz")], axis=1)
    at = np.stack([column(c).astype(float) for c in ("x", "y", "z")], axis=1)
    rad, reach = column("rad").astype(float), pc.fill_null(table["_r"], -1).to_numpy()
    axes, codes = zip(*(np.unique(voxel[:, i], return_inverse=True) for i in range(3)))
    keys, first, spot = np.unique((codes[0] * len(axes[1]) + codes[1]) * len(axes[2]) + codes[2], return_index=True, return_inverse=True)
    spots = voxel[first]
    place = column("place")
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    painted = np.full(len(keys), -1)  # the first row of the trace that came first
    owner = np.full(len(place), -1)
    for a, b in zip(start, np.append(start[1:], len(place))):
        rows = np.arange(a, b)
        owner[rows[whole[rows]]] = painted[spot[rows[whole[rows]]]]
        paints = rows[whole[rows] & (owner[rows] < 0)]
        for r in np.unique(reach[paints]):
            some = paints[reach[paints] == r]
            if r >= 0:
                hit = _filled(at[some], voxel[some], rad[some], int(r), axes, keys, spots)
                painted[hit[painted[hit] < 0]] = a
    ids = table["trace_id"].combine_chunks()
    out = {c: table[c].combine_chunks() for c in table.column_names if c not in ("case_id", "place", "_vx", "_vy", "_vz", "_r")}
    yield out | {"owner": ids.take(pa.array(owner, mask=owner < 0)), "covered": pa.array(owner >= 0)}
