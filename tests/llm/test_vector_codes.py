import hashlib

import numpy as np
import pytest
from oracle import difference, duck

from quillstack.llm import vector_codes as vc
from quillstack.llm.queries import QUERIES, SQL


def nearest(points, entries):
    apart = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return apart.argmin(axis=1)


@pytest.mark.parametrize("n,k,d,spread", [(1, 1, 3, 5), (7, 3, 1, 2), (500, 50, 4, 3), (3000, 64, 4, 60), (900, 64, 2, 1)])
def test_assignment_equals_all_distances(n, k, d, spread):
    rng = np.random.default_rng(n)
    for _ in range(5):
        centres = rng.integers(-4 * spread, 4 * spread, (5, d))
        points = centres[rng.integers(0, 5, n)] + rng.integers(-spread, spread + 1, (n, d))
        entries = points[rng.integers(0, n, k)] + rng.integers(0, 2, (k, d))  # equal entries and ties
        tree = vc.BoxTree(points, vc.LEAF)
        found, counts, sums = vc.assign(tree, entries)
        want = nearest(points, entries)
        assert (found == want[tree.order]).all()
        assert (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(k))


def test_bounds_spare_distances(monkeypatch):
    """On grouped points most are assigned with their node."""
    rng = np.random.default_rng(1)
    points = rng.integers(-400, 400, (16, 4))[rng.integers(0, 16, 8000)] + rng.integers(-9, 10, (8000, 4))
    entries = points[:64].copy()
    tree = vc.BoxTree(points, vc.LEAF)
    pairs = []
    whole = vc._within_bounds
    monkeypatch.setattr(vc, "_within_bounds", lambda node, *a: pairs.append(len(node)) or whole(node, *a))
    found, _, _ = vc.assign(tree, entries)
    assert (found == nearest(points, entries)[tree.order]).all()
    assert sum(pairs) < 0.15 * 8000 * 64


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_sql(spark, folder):
    frame = QUERIES["op11_dual_tree_codes"](spark, folder).toPandas()
    assert difference(frame, duck(folder).sql(SQL["op11_dual_tree_codes"]).df()) is None


def by_loop(rows, parts, entries, rounds):
    """The whole operator on (id, vector, label) in plain Python."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = -(-max(max(len(r[1]) for r in kept), 1) // parts) * parts
    ints = [[max(-vc.LIMIT, min(vc.LIMIT, int(np.floor(256 * x)))) for x in [*r[1], *[0.0] * (width - len(r[1]))]] for r in kept]
    step = width // parts
    cut = lambda v: [tuple(v[p * step:(p + 1) * step]) for p in range(parts)]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, np.array(ints[i], np.int32).tobytes()))
    books = [[cut(ints[i])[p] for i in first[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def placed():
        return [[min(range(len(b)), key=lambda e: (dist(x, b[e]), e)) for x, b in zip(cut(v), books)] for v in ints]

    for _ in range(rounds):
        at = placed()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v)[p] for v, a in zip(ints, at) if a[p] == e]
                if mine:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    at = placed()
    error = [sum(dist(x, b[e]) for x, b, e in zip(cut(v), books, a)) for v, a in zip(ints, at)]
    total = {}
    for r, e in zip(kept, error):
        total[r[2]] = total.get(r[2], 0) + e
    out = [(r[0], "".join(f"{e:02x}" for e in a), x, total[r[2]]) for r, a, x in zip(kept, at, error)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "hot" if i % 3 else f"l{i}") for i in range(40)]
    rows += [(1, rows[1][1], None), (1, rows[1][1], None), (None, rows[2][1], "hot"), (50, None, "a"), (51, [], "b"),
             (52, [float("nan")] * 8, "c"), (53, [1.0, None] * 4, "d"), (54, [float("inf")] + [0.0] * 7, None),
             (55, [1e30, -1e30, 0.5], None), (56, [0.25] * 11, "e")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label string, code string")
    exact = [(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]], r[2]) for r in rows]
    for parts, entries in ((4, 9), (16, 64)):
        coded, books = vc.compress(frame, parts=parts, entries=entries)
        want, digest = by_loop(exact, parts, entries, 2)
        assert coded.columns == ["vec_id", "label", "code", "error", "label_error"]
        got = [(r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and books.sha256() == digest
    coded, books = vc.compress(frame.limit(0))
    assert coded.count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
