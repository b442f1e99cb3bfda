"""Searches of an M-tree by many queries together."""

import numpy as np
import pytest

from tessera.llm import mtree


@pytest.mark.parametrize("large", [False, True])
def test_many_queries_meet_pages_together(monkeypatch, large):
    """The results of single products, with floors and ties, for rounds that grow with the logarithm of the leaves and not with the queries."""
    monkeypatch.setattr(mtree, "MANY", 50)
    rng = np.random.default_rng(3)
    whole = rng.integers(-(10**8), 10**8, (900, 4)) * 2 if large else rng.integers(-40, 40, (900, 4))
    x = np.unique(whole, axis=0)
    first = rng.permutation(len(x))
    tree = mtree.MTree(x.astype("float64"), page=8, exact=x if large else None).pack()
    meets = []
    monkeypatch.setattr(tree, "meet", lambda *a, f=tree.meet: (meets.append(len(a[1][0])), f(*a)))
    q = x[::5]
    scores = q @ x.T
    kind = "int64" if large else "float64"
    floor = np.full(len(q), mtree.LOWEST[np.dtype(kind).kind], kind)
    floor[::3] = np.sort(scores[::3], 1)[:, -3] + rng.integers(0, 2, len(floor[::3]))
    row, score, member = tree.search(q.astype("float64"), first, 6, floor, q if large else None)
    got = sorted(zip(row.tolist(), score.tolist(), member.tolist()))
    want = []
    for i, own in enumerate(scores):
        order = [j for j in np.lexsort((first, -own)) if own[j] >= floor[i]][:6]
        want += [(i, int(own[j]), int(j)) for j in order]
    assert got == sorted(want)
    assert len(meets) <= -(-len(q) // 50) * (np.log2(max(meets)) + 3)
    nothing = tree.search(q[:0].astype("float64"), first, 6, floor[:0], q[:0] if large else None)
    assert [len(a) for a in nothing] == [0, 0, 0]
    assert len(mtree.MTree(np.empty((0, 4))).pack().search(np.ones((2, 4)), first[:0], 6, np.full(2, -np.inf))[0]) == 0
