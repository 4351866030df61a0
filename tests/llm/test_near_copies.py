"""SimHash components and decontamination against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from rivulet.llm import resemblance, tokens
from rivulet.llm import simhash_dedup as sd
from rivulet.llm.decontamination import Index, Table, drop_contaminated, find, shingles, similarity
from rivulet.llm.graph import components


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(keys):
    """Smallest doc of each doc's component; keys: list of (doc, fingerprint)."""
    fps = sorted({f for _, f in keys})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    least = {}
    for d, f in keys:
        least[root(f)] = min(least.get(root(f), d), d)
    return [(d, least[root(f)]) for d, f in keys]


def test_fingerprint_in_parts(monkeypatch):
    rng = random.Random(0)
    for n in (0, 1, 2, 3, 10, 700):
        t = " ".join(rng.choice(["Ab", "c\x0bd", "é É", "x"]) for _ in range(n))
        assert sd.fingerprint(t.encode()) == brute_fingerprint(t)
    monkeypatch.setattr(sd, "_PART", 64)
    assert sd.fingerprint(t.encode()) == brute_fingerprint(t)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(40)]
    texts = [*base, *base[:10], "", None, " \n", "one", "One", "two words"]
    for t in base[:12]:
        for _ in range(20):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, fp int")
    for cell in (sd.CELL, 2):  # pairs, and the way for crowded cells
        fps = sd.checkpoint(sd.fingerprints(df))
        got = {r.doc_id: r.component_id for r in sd.classes(fps, cell).collect()}
        want = dict(brute_components([(i, brute_fingerprint(t or "")) for i, t in zip(ids, texts)]))
        assert got == want
    assert sd.near_duplicates(df.limit(0)).count() == 0
    row = sd.near_duplicates(df.where("text = 'one'")).first()
    assert row.fingerprint == f"{brute_fingerprint('one'):016x}"


def test_links_of_random_clusters(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(60):
            fps.add(f)
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    want = dict(brute_components([(i, f % (1 << 64)) for i, f in rows]))
    for cell in (100, 2):
        assert {r.doc_id: r.component_id for r in sd.classes(df, cell).collect()} == want


def test_links_where_most_cells_are_crowded(spark):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    low = [b for k in (0, 1, 2, 3, 14, 15) for b in (2 * k, 2 * k + 1)]  # all values of six segments: equal counts, many bits
    fps = {center ^ sum(1 << b for b in low if rng.random() < 0.5) for _ in range(700)}
    fps |= {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)}
    rows = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in rows], "fp long")
    want = {(min(a, b), max(a, b)) for i, a in enumerate(rows) for b in rows[:i] if (a ^ b).bit_count() <= 2 or ((a ^ b) % (1 << 64)).bit_count() <= 2}
    for cell in (4, 100_000):
        assert {tuple(r) for r in sd.links(df, cell).collect()} == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(5, 5), (3, 2), (100, 90)], "a long, b long")
    assert {r.node: r.root for r in components(links, "a", "b").collect()} == {i: 0 for i in range(31)} | {100: 90, 90: 90}
    assert components(links.limit(0), "a", "b").count() == 0


def brute_matches(docs, items):
    out = {}
    for d, text in docs:
        words = (text or "").encode().lower().split()
        for i, item in items:
            want = (item or "").encode().lower().split()
            if not want or not words:
                continue
            n = min(len(want), len(words))
            sims = [similarity(shingles(words[s : s + n]), shingles(want)) for s in range(len(words) - n + 1)]
            if max(sims) >= 0.8:
                out[d, i] = (round(max(sims), 9), sims.index(max(sims)), n)
    return out


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 4, 5, 6, 12, 20, 30, 30, 60])] + [(50, None), (51, " "), (52, "rep " * 20)]
    docs = [(0, None), (1, ""), (2, items[9][1]), (3, items[7][1].upper().replace(" ", "\n ")), (4, "rep " * 50), (5, items[8][1][:-4])]
    for d in range(6, 80):
        words = [word() for _ in range(rng.randrange(5, 120))]
        passage = rng.choice(items[:10])[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            passage[rng.randrange(len(passage))] = word()
        at = rng.randrange(len(words))
        docs.append((d, " ".join(words[:at] + passage + words[at:])))
    docs.append((80, docs[10][1]))
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int")
    other = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in find(df, other).collect()}
    want = brute_matches(dict(docs).items(), items)
    assert got == want and len(got) > 50
    # the fingerprints alone choose the candidates: the same without passing over any window
    index, unskipped = Index(items), Index(items, skip=False)
    texts = pa.array([None if t is None else t.encode() for _, t in docs], pa.binary())
    for part in tokens.parts(texts):
        assert unskipped.matches(part) == index.matches(part)
    assert {(docs[d][0], i) for part in tokens.parts(texts) for d, i, *_ in unskipped.matches(part)} == set(want)
    monkeypatch.setattr(Table, "near", lambda self, fps: (np.zeros(0, int),) * 3)
    assert all(Index(items).matches(part) == [] for part in tokens.parts(texts))
    monkeypatch.undo()
    assert sorted(map(tuple, find(df, other.union(other)).collect())) == sorted(map(tuple, find(df, other).collect()))
    kept = {r.doc_id for r in drop_contaminated(df, other).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert drop_contaminated(df, other).columns == df.columns
    assert find(df.limit(0), other).count() == 0 and find(df, other.limit(0)).count() == 0


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    index = Index([(i, " ".join(f"q{x}" for x in rng.integers(0, 400, 20))) for i in range(300)])
    table = index.tables[20]
    of, own = table.items, table.fps.view(np.uint8).reshape(-1, 8)
    flips = np.packbits(rng.random((300, 64)) < 0.3, axis=1, bitorder="little")
    fps = own ^ flips
    found = defaultdict(set)
    for w, i, d in zip(*table.near(fps)):
        found[w].add((int(i), int(d)))
    distance = np.bitwise_count(fps[:, None] ^ own[None]).sum(2)
    for w in range(300):
        assert found[w] == {(int(of[j]), int(distance[w, j])) for j in np.flatnonzero(distance[w] <= 23)}


def brute_groups(docs):
    """Smallest doc of each doc's group by near fingerprints and by similarity. docs: (doc, text)."""
    words = [tuple((t or "").lower().split()) for _, t in docs]
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} or {w} for w in words]
    prints = [brute_fingerprint(t or "") for _, t in docs]
    up = {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(docs[a][0]), root(docs[b][0])))
                up[y] = x
    return {i: root(i) for i in up}


def test_similar_texts_are_linked(spark):
    rng = random.Random(6)
    word = lambda: f"z{rng.randrange(2000)}"
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 30, 120, 300]))]
        texts.append(base)
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = word()
            texts.append(w)
    big = [word() for _ in range(200)]
    for k in range(60):  # a group with more members than are compared each with each
        w = list(big)
        w[rng.randrange(200)] = f"only{k}"
        texts.append(w)
    rows = [(i, " ".join(w), "en") for i, w in enumerate(texts)] + [(900, None, "en"), (901, "", "en"), (902, "a b", "en"), (903, "A  b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch string")
    groups = brute_groups([(i, t) for i, t, _ in rows])
    assert sorted(r.doc_id for r in sd.drop_near_copies(docs).collect()) == sorted(i for i in groups if groups[i] == i)


def test_crowds_are_linked_as_far_as_they_are_similar(spark, monkeypatch):
    rng = random.Random(7)
    texts = []
    for size, most in ((17, 4), (100, 4), (300, 4), (120, 2)):
        base = [f"b{size}x{k}" for k in range(200)]
        for k in range(size):
            w = list(base)
            for at in rng.sample(range(200), rng.randrange(1, 1 + most)):
                w[at] = f"own{size}x{k}x{at}"
            texts.append(w)
    line = [f"line{k}" for k in range(12)]
    texts += [line + [f"short{k}x{j}" for j in range(8)] for k in range(40)]  # alike in one line only
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    groups = brute_groups([(i, " ".join(w)) for i, w in enumerate(texts)])
    want = sorted(i for i in groups if groups[i] == i)
    assert sorted(r.doc_id for r in sd.drop_near_copies(docs).collect()) == want
    monkeypatch.setattr(resemblance, "BLOCK", 5000)
    assert sorted(r.doc_id for r in sd.drop_near_copies(docs).collect()) == want


def test_rows_that_share_or_lack_a_doc_id_count_by_their_texts(spark):
    text = lambda name, *changed: " ".join(f"new{k}" if k in changed else f"{name}{k}" for k in range(200))
    rows = [
        (1, text("a")), (5, text("a", 3)), (5, text("b")), (5, text("b")),  # one is a near copy of 1, two stand alone
        (7, text("c")), (7, text("d")),  # two texts under one doc_id
        (None, text("e", 9)), (8, text("e")), (None, text("f")), (None, text("f", 50, 120)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.text.split()[0]) for r in sd.drop_near_copies(docs).collect())
    assert got == [(0, "f0"), (1, "a0"), (5, "b0"), (7, "c0"), (7, "d0"), (8, "e0")]


def test_copies_that_share_a_common_passage(spark):
    rng = random.Random(8)
    passage = [f"licence{k}" for k in range(352)]
    rows = []
    for k in range(60):
        own = [f"text{k}x{j}" for j in range(52)]
        again = list(own)
        again[rng.randrange(52)] = "changed"
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage + again))]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(400)} for i, t in rows}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(similar(2 * k, 2 * k + 1) >= 0.8 and similar(2 * k, (2 * k + 2) % 120) < 0.8 for k in range(60))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = brute_groups(rows)
    assert sorted(r.doc_id for r in sd.drop_near_copies(docs).collect()) == sorted(i for i in groups if groups[i] == i)


def test_pages_of_one_template_are_not_compared_each_with_each(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "_matches", None)  # blocks of a crowd
    rng = random.Random(9)
    template = [f"template{k}" for k in range(150)]
    rows = []
    for k in range(120):
        own = [f"page{k}x{j}" for j in range(50)]
        rows.append((k, " ".join(template + own)))
        if k % 10 == 0:
            own[rng.randrange(50)] = "changed"
            rows.append((1000 + k, " ".join(template + own)))
    groups = brute_groups(rows)
    want = sorted(i for i in groups if groups[i] == i)
    assert len(want) == 120
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in sd.drop_near_copies(docs).collect()) == want


def test_texts_that_overlap_enough_share_one_of_their_rarest_hashes(spark):
    rng = random.Random(10)
    sets = {}
    for k in range(120):
        n = rng.randrange(1, 30)
        sets[k] = set(rng.sample(range(40), n))
        sets[1000 + k] = {h if rng.random() < 0.93 else 100 + h for h in sets[k]}
    hashes = spark.createDataFrame([(i, i, len(s), h) for i, s in sets.items() for h in s], "id long, root long, size int, h long")
    lists = defaultdict(set)
    for r in resemblance._rarest(hashes, 0.8).collect():
        lists[r.h].add(r.id)
    found = {(a, b) for ids in lists.values() for a in ids for b in ids}
    enough = {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * max(len(sets[a]), len(sets[b]))}
    assert len(enough) > 100 and enough <= found


def test_pivots_meet_a_bounded_number_of_texts(spark):
    crowds = spark.range(5000).selectExpr("cast(7 AS long) AS key", "id", "5000L AS n").union(spark.range(20).selectExpr("9L", "id", "20L"))
    stars = resemblance._stars(crowds, 5000).collect()
    degree = defaultdict(int)
    for r in stars:
        degree[r.a] += 1
        degree[r.b] += 1
    assert max(degree.values()) < 5 * resemblance.FAN and len(degree) == 5000
    up = list(range(5000))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in stars:
        up[root(r.a)] = root(r.b)
    assert len({root(x) for x in range(5000)}) == 1
