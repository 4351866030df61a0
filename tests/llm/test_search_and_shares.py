"""Top-k search, mixing and sharding against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rivulet.llm.mixing import mix
from rivulet.llm.sharding import Shard, assign, grow, tree
from rivulet.llm.topk import Trace, nra, search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, rank int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", "y", 0) for i, t, s in rows], DOCS)


def test_bounds_keep_every_best_candidate():
    rng = np.random.default_rng(1)
    for depth in ((1.0,), (0.1, 1.0), (0.05, 0.2, 0.5, 0.9, 1.0)):
        c = np.floor(rng.normal(size=(300, 8)) * 20 + (rng.integers(0, 4, 300) * 30)[:, None])
        q = c[:15]
        own = np.zeros((15, 300), bool)
        own[np.arange(15), np.arange(15)] = True
        query, place, score = nra(q, c, own, np.full(15, -np.inf), 7, depth)
        for i in range(15):
            best = np.sort(np.delete(q[i] @ c.T, i))[-7:]
            of = query == i
            assert (score[of] == c[place[of]] @ q[i]).all() and i not in place[of]
            assert sorted(score[of])[-7:] == best.tolist()
            assert set(np.flatnonzero(q[i] @ c.T >= best[0])) - {i} <= set(place[of])  # ties too


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 32))
    c = np.floor(64 * (centers[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 32))))
    q = c[::200]
    trace = Trace()
    none = np.zeros((len(q), 2000), bool)
    query, place, score = nra(q, c[:2000], none, np.full(len(q), -np.inf), 10, (0.3, 0.5, 0.7, 0.9, 1.0), trace)
    assert trace.left[0] <= len(q) * 2000 and trace.left[-1] < len(q) * 2000 / 10 and trace.read < 0.95 * trace.entries
    assert len(query) < len(q) * 2000 / 10  # resolved are few
    floor = np.array([np.sort(score[query == i])[-10] for i in range(len(q))])
    again = Trace()
    query, place, score = nra(q, c[2000:], none, floor, 10, (0.3, 0.5, 0.7, 0.9, 1.0), again)
    assert again.read / again.entries < trace.read / trace.entries  # what earlier blocks found saves reading
    for i in range(len(q)):
        assert set(np.flatnonzero(c[2000:] @ q[i] > floor[i])) <= set(place[query == i]) or (query == i).sum() >= 10


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0) for i in range(200)]
    rows += [(1000 + i, [0.5] * 6, 1) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2020, [float("nan")] * 6, 1), (2040, [1.0, None, 1.0], 1), (2060, [float("inf")], 1), (2080, [], 1), (2100, [2.0], 1)]
    rows += [(None, [1.0] * 6, 1), (None, [3.0] * 6, 1), (3, rows[3][1], 0), (3, rows[3][1], 0), (20, rows[20][1], 0), (40, rows[41][1], 0)]  # repeated
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    v = [(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in e)) for i, e, _ in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = {}
    for q, a in {(i, x) for i, x in v if i is not None and i % 20 == 0}:
        want.setdefault(q, []).extend((-sum(s * t for s, t in zip(a, x)), i is None, i) for i, x in v if i != q)
    for block, queries in ((64, 4), (8192, 1000)):
        got = defaultdict(list)
        for r in search(df, k=5, block=block, queries=queries).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        assert set(got) == set(want) and 40 in got and 20 in got
        for q, found in got.items():
            assert sorted(found, key=lambda f: f[0]) == [(n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(want[q], key=lambda w: (w[0], w[1], w[2] or 0))[:5])]
    assert search(df.limit(0)).count() == 0
    assert search(df.where("vec_id = 2060")).count() == 0


def test_the_query_and_its_sql_agree_on_repeated_rows(spark, tmp_path):
    import duckdb

    from rivulet.llm.catalog import ORACLES, op1_nra_top_k

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in [*range(50), *range(30), None, None]]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(ORACLES["op1_nra_top_k"]).fetchall())
    assert sorted(map(tuple, op1_nra_top_k(spark, str(tmp_path)).collect()), key=lambda r: r[:2]) == want and len(want) == 60


def test_huge_components_stay_exact(spark):
    df = spark.createDataFrame([(20, [1e7, 1.0]), (1, [1e7, 3.0]), (2, [1e7, 2.0])], "vec_id long, embedding array<double>")
    a = 64 * 10**7
    assert [(r.vec_id, r.score) for r in search(df).orderBy("rank").collect()] == [(1, a * a + 64 * 192), (2, a * a + 64 * 128)]


def waterfill(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= cap * sizes[s]
        open_ -= over
    return out


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(3)
    names = ["b", "a", "é", None, "zz", "tiny"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), names[int(rng.choice(6, p=[0.4, 0.2, 0.2, 0.1, 0.09, 0.01]))]) for i in range(3000)]
    rows += [(9000 + i, "same words here", "b") for i in range(1500)] + [(None, "a b", None), (5, None, "none"), (6, "", "none")]
    got = mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken, target = waterfill(sizes), Counter(), {}
    source = {}
    for i, t, s in rows:
        source[i, len((t or "").split())] = s
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        assert r.target == pytest.approx(want[s])
        taken[s] += r.taken
        target[s] = r.target
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 120
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix(documents(spark, rows[::-1])).collect()))
    assert mix(documents(spark, rows).limit(0)).count() == 0


def test_shards(spark):
    rows = [(i, f"text {i % 50}" * (i % 7), "s") for i in range(4000)] + [(None, None, None), (1, "text 1", "s"), (1, "text 1", "s"), (2, "né" * 1000, "s")]
    df = documents(spark, rows)
    got = assign(df, tree(), grow(tree())).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(set)
    slots = defaultdict(list)
    sized = Counter((r.doc_id, r["size"], r.text_crc32) for r in got)
    assert sized == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for r in got:
        by_id[r.doc_id].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(len(s) == 1 for s in by_id.values()) and set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 16 for r in got)
    assert 4000 / 17 * 0.7 < moved < 4000 / 17 * 1.3
    assert all(4000 / 16 * 0.7 < len(s) < 4000 / 16 * 1.3 for s in slots.values())
    assert assign(df.limit(0), tree()).count() == 0


def test_weights_move_rows_only_into_their_subtree(spark):
    df = documents(spark, [(i, "t", "s") for i in range(3000)])
    before = tree()
    after = tuple(Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in before)
    old = {r.doc_id: r.shard for r in assign(df, before).collect()}
    new = {r.doc_id: r.shard for r in assign(df, after).collect()}
    place = {s.shard: s for s in before}
    for i in old:
        a, b = place[old[i]], place[new[i]]
        if a.region != b.region:
            assert b.region == place[5].region
        elif a.rack != b.rack:
            assert (b.region, b.rack) == (place[5].region, place[5].rack)
        elif a.shard != b.shard:
            assert b.shard == 5
