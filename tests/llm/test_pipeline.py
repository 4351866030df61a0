"""The pipeline's stages against brute force, each on what the one before kept."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from rivulet.llm import toxicity
from rivulet.llm.mixing import take
from rivulet.llm.sharding import place, tree
from rivulet.llm.simhash_dedup import drop_near_copies
from tests.llm.test_near_copies import brute_groups, brute_matches
from tests.llm.test_search_and_shares import waterfill

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, slot string"


def h52(*parts):
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16)


def brute_copies(rows):
    """Copies of each (doc_id, source, words), by the rule of systematic sampling."""
    sizes, out = Counter(), {}
    for _, s, n in rows:
        sizes[s] += n
    want = waterfill(sizes)
    by_source = defaultdict(list)
    for d, s, n in rows:
        by_source[s].append((n, h52("mix", str(d)), d))
    for s, docs in by_source.items():
        each = want[s] / sizes[s] if sizes[s] else 0.0
        offset = int(hashlib.md5(("offset:" + ("0" if s is None else "1" + s)).encode()).hexdigest()[:3], 16) / 4096
        for i, (_, _, d) in enumerate(sorted(docs)):
            out[d] = min(3, math.floor((i + 1) * each + offset) - math.floor(i * each + offset))
    return out


def brute_shard(doc_id):
    key = str(doc_id)

    def pick(children):
        return min(children, key=lambda c: -math.log((h52(key, c[0]) + 0.5) / 2**52) / c[1])[2]

    region = pick([(f"region-{r}", 8, r) for r in range(2)])
    rack = pick([(f"rack-{region}-{k}", 4, k) for k in range(2)])
    return pick([(f"shard-{s}", 1, s) for s in range(8 * region + 4 * rack, 8 * region + 4 * rack + 4)])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(800)}"
    items = [(i, " ".join(word() for _ in range(25))) for i in range(6)]
    rows, labels = [], []
    for d in range(260):
        words = [word() for _ in range(rng.randrange(5, 90))]
        toxic = d % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "vile")
        if d % 17 == 1:
            words += items[d % 6][1].split()
        rows.append((d, " ".join(words)))
        labels.append((d, 1, int(toxic)))
    rows += [(1000 + d, t) for d, t in rows[:200:9]]
    for d, t in rows[3:60:7]:
        rows.append((2000 + d, t + " extra"))
    rows += [(3000, None), (3001, ""), (3002, " ")]
    table = [(d, t, "en", None if d % 19 == 0 else f"s{d % 4}", 1, 1, "r", "s") for d, t in rows]
    path = tmp_path_factory.mktemp("corpus")
    for name, data, schema in (
        ("documents", table, DOCS),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path), items


def test_stages(spark, corpus):
    path, items = corpus
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}

    first = steps["toxicity"](spark, docs, path)
    kept = {r.doc_id for r in first.collect()}
    lost = {d for d, r in before.items() if "vile" in (r.text or "")}
    assert kept == set(before) - lost and first.columns == docs.columns
    scores = {r.doc_id: r.score for r in toxicity.score(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()}
    assert all(s < 0.7 for d, s in scores.items() if d not in lost)

    first.write.parquet(f"{path}/1")
    docs = spark.read.parquet(f"{path}/1")
    second = steps["near copies"](spark, docs, path)
    groups = brute_groups([(d, before[d].text) for d in kept])
    kept = {d for d in kept if groups[d] == d}
    assert sorted(r.doc_id for r in second.collect()) == sorted(kept) and second.columns == docs.columns

    second.write.parquet(f"{path}/2")
    docs = spark.read.parquet(f"{path}/2")
    third = steps["benchmark passages"](spark, docs, path)
    kept -= {d for d, _ in brute_matches([(d, before[d].text) for d in kept], items)}
    assert sorted(r.doc_id for r in third.collect()) == sorted(kept) and third.columns == docs.columns

    third.write.parquet(f"{path}/3")
    docs = spark.read.parquet(f"{path}/3")
    fourth = steps["source mix"](spark, docs, path)
    copies = brute_copies([(d, before[d].source, len((before[d].text or "").split())) for d in kept])
    got = fourth.collect()
    assert Counter(r.doc_id for r in got) == Counter({d: n for d, n in copies.items() if n})
    assert fourth.columns == docs.columns and all(r == before[r.doc_id] for r in got)

    fourth.write.parquet(f"{path}/4")
    last = steps["shards"](spark, spark.read.parquet(f"{path}/4"), path)
    shards = defaultdict(list)
    for r in last.collect():
        assert r.shard == brute_shard(r.doc_id)
        shards[r.shard].append(r.slot)
    assert sum(map(len, shards.values())) == len(got) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert set(last.columns) == set(docs.columns) | {"shard", "slot"}


def test_run(spark, corpus):
    path, _ = corpus
    assert corpus_pipeline.run(spark, path).count() > 50


def test_rows_without_ids_and_repeated_rows(spark):
    text = "one two three four five"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, "other words are here now"), (None, "other words are here now"), (5, None), (6, "")]
    docs = spark.createDataFrame([(d, t, "en", None, 1, 1, "r", "s") for d, t in rows], DOCS)
    got = sorted((str(r.doc_id), r.text) for r in drop_near_copies(docs).collect())
    assert got == [("1", text), ("5", None), ("None", "other words are here now")]
    for empty in (drop_near_copies(docs.limit(0)), take(docs.limit(0)), place(docs.limit(0), tree())):
        assert empty.count() == 0
    mixed = take(docs)
    assert mixed.columns == docs.columns and mixed.count() <= 24
    placed = place(docs, tree())
    assert placed.count() == len(rows) and placed.columns.count("slot") == 1
