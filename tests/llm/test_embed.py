import numpy as np
import pytest

from webstrata.llm import embed as E


def brute(rows, threshold=0.93):
    ok = [i for i, (_, label, v) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for n, i in enumerate(ok):
        for j in ok[:n]:
            if rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = np.array(rows[i][2], "f8"), np.array(rows[j][2], "f8")
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out, seen = {}, {}
    for i in range(len(rows)):
        if i not in seen:
            stack, comp = [i], set()
            while stack:
                k = stack.pop()
                if k not in comp:
                    comp.add(k)
                    stack += links[k]
            for k in comp:
                seen[k] = min(rows[x][0] for x in comp)
        out[rows[i][0]] = (len(links[i]), seen[i], rows[i][0] == seen[i])
    return out


@pytest.mark.parametrize("leaf", [256, 16])
def test_matches_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(E, "LEAF", leaf)
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(leaf)
    rows, n = [], 0
    for label in (0, 1, 2):
        centres = rng.normal(size=(4, 24))
        for _ in range(90):
            rows.append((n := n + 1, label, (centres[rng.integers(4)] + 1.5 * rng.normal(size=24)).astype("f4").tolist()))
        base = rng.normal(size=24)
        for _ in range(40):
            rows.append((n := n + 1, label, (base + 0.12 * rng.normal(size=24)).astype("f4").tolist()))
        for i in range(10):
            rows.append((n := n + 1, label, (np.array(rows[-20][2]) + 0.15 * rng.normal(size=24)).astype("f4").tolist()))
        rows += [(n := n + 1, label, rows[-1][2]) for _ in range(12)]
    odd = [None, [], [0.0] * 24, [1.0, None] * 12, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows += [(n := n + 1, 1, v) for v in odd] + [(n := n + 1, None, rows[0][2]), (n := n + 1, 2, rows[0][2])]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([(*rows[i], "x") for i in order], "vec_id long, label int, embedding array<float>, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert sum(got[k] == want[k] for k in want) / len(want) > 0.99, [(k, got[k], want[k]) for k in want if got[k] != want[k]][:9]


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def nested(rng, n_pairs, filler):
    """Pairs of groups of 14, cosine 0.999 within a group and 0.94 across, among single vectors."""
    unit = lambda v: v / np.linalg.norm(v)
    rows, n = [], 0
    for _ in range(n_pairs):
        a = unit(rng.normal(size=24))
        w = rng.normal(size=24)
        b = 0.945 * a + np.sqrt(1 - 0.945**2) * unit(w - (w @ a) * a)
        rows += [(n := n + 1, 1, unit(c + 0.004 * rng.normal(size=24)).tolist()) for c in (a, b) for _ in range(14)]
    return rows + [(n := n + 1, 1, rng.normal(size=24).tolist()) for _ in range(filler)]


def result(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}


def test_links_between_saturated_groups(spark, monkeypatch):
    monkeypatch.setattr(E, "AUDIT", 16)
    rows = nested(np.random.default_rng(5), 6, 400)
    got, want = result(spark, rows), brute(rows)
    assert got == want, [(k, got[k], want[k]) for k in want if got[k] != want[k]][:9]


@pytest.mark.parametrize("attempts", [1, 4])
def test_failed_audit_goes_on(spark, monkeypatch, attempts):
    for name, value in (("TREES", 1), ("ROUNDS", 1), ("LEAF", 8), ("K", 3), ("AUDIT", 64), ("ATTEMPTS", attempts)):
        monkeypatch.setattr(E, name, value, raising=False)
    rng = np.random.default_rng(6)
    rows = [(n, 1, rng.normal(size=24)) for n in range(1, 301)]
    rows = [(n, 1, v.tolist()) for n, _, v in rows] + [(n + 300, 1, (v + 0.3 * rng.normal(size=24)).tolist()) for n, _, v in rows]
    got, want = result(spark, rows), brute(rows)
    assert sum(got[k] == want[k] for k in want) / len(want) > 0.99


def test_many_nodes(spark, monkeypatch):
    """Planted pairs and a group of near copies among more nodes than the audit has, which adds no link itself."""
    monkeypatch.setattr(E, "AUDIT", 64)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1900, 32))
    pairs = base[:300] + 0.1 * rng.normal(size=(300, 32))
    group = base[-1] + 0.12 * rng.normal(size=(250, 32))
    x = np.concatenate([base, pairs, group])
    rows = [(i + 1, 1, v.tolist()) for i, v in enumerate(x)]
    got = result(spark, rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    root = E.least_members(near | np.eye(len(x), dtype=bool)) + 1
    want = {i + 1: (int(near[i].sum()), int(root[i]), bool(root[i] == i + 1)) for i in range(len(x))}
    assert sum(v[0] > 0 for v in want.values()) > 600
    assert sum(got[k] == want[k] for k in want) >= 0.999 * len(want)


def test_very_long_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=20_000).tolist()
    df = spark.createDataFrame([(1, 0, v, 1, 2), (2, 0, [2 * x for x in v], 1, 2), (None, 0, v, 1, 2), (4, 0, v[::-1], 1, 2)], "vec_id long, label int, embedding array<double>, id int, root int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    assert got[1][0] == 2 and got[2][0] == 2 and got[4] == (0, 4) and got[1][1] == got[2][1]


def test_linked_rows_without_ids(spark):
    """Rows of null vec_id that link with rows of an id, with each other and with copies of themselves: names are real ids, and each group keeps one row."""
    rng, rows, groups = np.random.default_rng(8), [], []
    for ids in ([5, None], [None, 17, 11], [None, None], [None], [None, None, None], [30, None, None, None]):
        for copies in (False, True):
            base = rng.normal(size=32)
            vectors = [base.tolist() if copies else (base + 0.05 * rng.normal(size=32)).tolist() for _ in ids]
            own = [None if i is None else i + 100 * len(groups) for i in ids]
            rows += [(i, len(groups), v) for i, v in zip(own, vectors, strict=True)]
            groups.append(own)
    df = spark.createDataFrame([(i, 1, v, g) for i, g, v in rows], "vec_id long, label int, embedding array<double>, g int").repartition(3)
    got = E.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_name = {}
    for r in got:
        by_name.setdefault(r.component_id, []).append(r)
    for own in groups:
        named = [i for i in own if i is not None]
        if named:
            found = by_name[min(named)]
            assert sorted((r.vec_id is None, r.vec_id or 0) for r in found) == sorted((i is None, i or 0) for i in own)
            assert [r.vec_id for r in found if r.kept] == [min(named)] and all(r.n_links == len(own) - 1 for r in found)
    assert sum(r.kept for r in by_name[None]) == sum(all(i is None for i in own) for own in groups)
    assert all(r.vec_id is None for r in by_name[None])
