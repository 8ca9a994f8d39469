"""Vector codes, the conversation prefix trie and the neighbour forest against brute force, with every defined case."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import forest_ann, prefix_trie, vector_codes
from tests.conftest import SF_SMALL

VECTORS = "vec_id long, embedding array<float>, label int, score string, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "clash", "clash")
                                  for i, v, lab in rows], VECTORS)


def awkward(width=16, n=300, seed=3):
    """Clustered vectors with copies, equal ids, nulls, non-finite components, zeros and other lengths."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (6, width))
    rows = [(i, (centre[i % 6] + rng.normal(0, 0.2, width)).astype(np.float32).tolist(), None if i % 7 == 0 else i % 6) for i in range(n)]
    rows += [(1000 + i, rows[3][1], 3) for i in range(200)]             # copies of one vector
    rows += [rows[5], rows[5], (None, rows[8][1], None), (None, rows[9][1], 2)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] * width, 1), (2003, [float("nan")] * width, 1),
             (2004, [float("inf")] + [0.0] * (width - 1), 1), (2005, [0.0] * width, 1), (2006, [1.0] * (width + 8), 1), (2007, [1.0] * 3, 1)]
    return rows


# ---- vector codes ---------------------------------------------------------------------------------

def plain_codes(rows, parts=8, entries=16, rounds=6):
    """The plain iteration over all pairs. ``(rows of (vec_id, code, error, label_error), digest)``."""
    ok = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and len(r[1]) % parts == 0]
    smallest = {}
    for i, v, _ in ok:
        if i is not None:
            x = tuple(np.floor(4096 * np.array(v, np.float32).astype(float)).astype(int).tolist())
            smallest[i] = min(smallest.get(i, x), x)
    width = len(smallest[min(smallest)])
    smallest = {i: x for i, x in smallest.items() if len(x) == width}
    ok = [r for r in ok if len(r[1]) == width]
    p = np.array([np.floor(4096 * np.array(r[1], np.float32).astype(float)) for r in ok]).astype(np.int64).reshape(len(ok), parts, -1)
    books = np.array([smallest[i] for i in sorted(smallest)[:entries]]).reshape(-1, parts, width // parts).swapaxes(0, 1).copy()
    for last in [False] * rounds + [True]:
        d = ((p[:, :, None, :] - books[None]) ** 2).sum(-1)
        code, dist = d.argmin(2), d.min(2)
        if not last:
            for a in range(parts):
                for e in range(books.shape[1]):
                    if (code[:, a] == e).any():
                        books[a, e] = p[code[:, a] == e, a].sum(0) // (code[:, a] == e).sum()
    error, per_label = dist.sum(1), collections.Counter()
    for r, e in zip(ok, error.tolist(), strict=True):
        per_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in cs), e, per_label[r[2]])
            for r, cs, e in zip(ok, code.tolist(), error.tolist(), strict=True)], digest


def test_codes_equal_the_plain_iteration(spark):
    given = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    for rows in (awkward(), given):
        got = vector_codes.compress(vectors(spark, rows)).collect()
        want, digest = plain_codes(rows)
        assert collections.Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == collections.Counter(want)
        assert {r.codebooks_sha256 for r in got} == {digest}


def test_codes_of_few_or_no_rows(spark):
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 1), (None, [1.0] * 8, 1)])).collect() == []
    rows = [(2, [0.5] * 8, None), (1, [0.5] * 8, None)]                 # equal entries: the lower index wins
    got = vector_codes.compress(vectors(spark, rows)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(1, "00" * 8, 0), (2, "00" * 8, 0)]
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(vectors(spark, [(1, [1e9] * 8, 1), (2, [-1e9] * 8, 1)])).collect()


@pytest.mark.parametrize("n,leaf", [(1, 8), (7, 2), (64, 4), (1000, 8)])
def test_tree_walk_equals_all_pairs_and_prunes(n, leaf):
    rng = np.random.default_rng(n)
    centre = rng.integers(-4000, 4000, (12, 8))
    points = centre[rng.integers(0, 12, n)] + rng.integers(-60, 60, (n, 8))
    entries = np.concatenate([centre, centre[:2], points[:2 if n > 2 else 1]])
    order, tree = vector_codes.grow(points, leaf)
    assert sorted(order.tolist()) == list(range(n)) and (tree.points == points[order]).all() and (tree.sums[0] == points.sum(0)).all()
    near = vector_codes.Entries(entries)
    code, dist = vector_codes.assign(tree, near)
    all_pairs = ((points[order][:, None, :] - entries[None]) ** 2).sum(-1)
    assert (code == all_pairs.argmin(1)).all() and (dist == all_pairs.min(1)).all()
    count, sums = vector_codes.totals(tree, near)
    assert (count == np.bincount(code, minlength=len(entries))).all()
    assert all((sums[e] == tree.points[code == e].sum(0)).all() for e in range(len(entries)))
    if n == 1000:
        assert vector_codes.walk(tree, near)[3] < 0.2 * n * len(entries)      # clustered parts: most pairs are pruned


# ---- conversation prefix trie -----------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth string, ref string"


def plain_trie(rows):
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: y[0])] for c, v in convs.items()}
    members, children, rebuilt = collections.defaultdict(list), collections.Counter(), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        children[p[:-1]] += 1 if p else 0
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if rebuilt[c] == p)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def talk(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)


def found_trie(spark, rows, **options):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *tuple(r)[3:])
                  for r in prefix_trie.trie(talk(spark, rows), **options).collect())


def odd_talk():
    rng = np.random.default_rng(5)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 225), -3, -150, 10_000, 20_001]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ("user", "assistant")[t % 2], f"turn {t} of {int(rng.integers(0, 3))} é\U0001f600"))
    rows += [(500, None, None, None), (500, 3, "user", None), (500, 1, None, "x"), (501, 1, "", "x"), (None, 0, "user", "lost")]
    rows += [(600, t, "user", "same") for t in range(8)] * 2                     # repeated rows: turns of their own
    rows += [(c, t, "user", "same") for c in range(601, 640) for t in range(8)]  # copies
    rows += [(700, 0, "user", "ab"), (701, 0, "user", "a"), (702, 0, "usera", "b"), (703, 0, "", "usera")]
    rows += [(800, t, "user", "long " * 2000 if t == 1 else str(t)) for t in range(0, 1300)]
    rows += [(801, t, "user", str(t)) for t in range(-2100, 300, 11)]
    return rows


def test_trie_equals_brute_force(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for rows in (odd_talk(), given):
        assert found_trie(spark, rows) == plain_trie(rows)
    assert found_trie(spark, []) == []


def test_trie_refutes_colliding_fingerprints(spark):
    """With the multiplier 1 the order of turns is lost: the verification notices, and the next multiplier gives the trie."""
    rows = [(1000, t, "user", x) for t, x in enumerate("abcdef")] + [(2000, t, "user", x) for t, x in enumerate("bacdef")]
    assert found_trie(spark, rows, multipliers=(1, 1_000_003)) == plain_trie(rows)
    with pytest.raises(RuntimeError):
        prefix_trie.trie(talk(spark, rows), multipliers=(1,))


# ---- neighbour forest -------------------------------------------------------------------------------

def plain_nearest(rows, k, step):
    by_id = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = tuple(float(np.float32(y)) for y in v)
            by_id[i] = min(by_id.get(i, x), x)
    width = len(by_id[min(by_id)])
    by_id = {i: x for i, x in by_id.items() if len(x) == width}
    ids = np.array(sorted(by_id))
    m = np.array([by_id[i] for i in ids])
    out = {}
    for q in ids[ids % step == 0].tolist():
        score = (m * np.array(by_id[q])).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found_nearest(df, k, step, **options):
    out = collections.defaultdict(list)
    rows = forest_ann.nearest(df, F.col("vec_id") % step == 0, k, **options).collect()
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_forest_defined_cases(spark):
    """All leaves visited: the exact answer, copies and ties included."""
    rows = awkward()
    rows = [(i, [1.0] * 16 if 100 <= (i or 0) < 160 else v, lab) for i, v, lab in rows]
    got, want = found_nearest(vectors(spark, rows), 20, 10, found=1.1), plain_nearest(rows, 20, 10)
    assert got == want
    assert found_nearest(vectors(spark, rows[:4]), 20, 1, found=1.1) == plain_nearest(rows[:4], 20, 1)
    assert forest_ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert forest_ann.nearest(vectors(spark, rows[1:2]), F.col("vec_id") % 1 == 0).collect() == []


def test_forest_recall_and_share(spark, monkeypatch):
    """Many leaves: recall above 0.9 on hardly and on well separated neighbours; the latter visit few leaves."""
    monkeypatch.setattr(forest_ann, "LEAF", 32)
    rng = np.random.default_rng(11)
    noise = rng.normal(0, 1, (4000, 32))
    centre = rng.normal(0, 1, (80, 32))
    clustered = centre[rng.integers(0, 80, 4000)] + rng.normal(0, 0.15, (4000, 32))
    for m, floor in ((noise, 0.9), (clustered, 0.9)):
        rows = [(i, v, 0) for i, v in enumerate(m.astype(np.float32).tolist())]
        want = plain_nearest(rows, 20, 20)
        got = found_nearest(vectors(spark, rows), 20, 20)
        hits = [len({i for i, _ in got[q]} & {i for i, _ in w}) / 20 for q, w in want.items()]
        assert np.mean(hits) >= floor
        assert all(abs(dict(w).get(i, s) - s) < 1e-9 for q, w in want.items() for i, s in got[q])

    def share(m):
        top = np.linalg.norm(m, axis=1).max()
        asking = forest_ann._asking(m, top)
        forest = forest_ann.fit(forest_ann._lifted(m, top), asking, len(m), 3, 20)
        odds = forest_ann._right_share(forest, asking[:100])
        leaves = sum(forest.left < 0)
        return np.mean([len(forest_ann.visits(forest, o.tolist(), forest_ann.FOUND)) / leaves for o in odds])

    assert share(clustered) < 0.2 * share(noise)
