"""Personal data against plain patterns, token rollups against direct counts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from rivulet.llm import pii
from rivulet.llm.token_rollup import VOCABULARY, Rollup, _encoding, count, count_tokens, deletes, history, inserts, revisions, roll_up

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[kind]
            if fits:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def with_check(digits):
    return next(digits + str(c) for c in range(10) if luhn(digits + str(c)))


def test_base_spans_against_patterns():
    rng = random.Random(0)
    pieces = ["01", ".", "@", "+", "-", " ", "a", "(", ")", "é", "\n", "%", "255", "1.2.3.4", "a@b.c", "+1 (017) 555-7713", with_check("453957876362148"), "4539 5787"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "1 " * 150_000])
def test_long_runs_take_no_longer_than_their_length(text):
    pii.base_spans(text)


def test_skip_edges_find_what_is_repeated():
    rng = random.Random(1)
    phone = lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    texts = []
    for _ in range(300):
        p, card = phone(), with_check(str(rng.randrange(10**14, 10**15)))
        texts.append(" then some words ".join(rng.sample(["words here", p, p, card, card, f"{rng.randrange(99)}@mail.example.com", "Version 2.0", f"{rng.randrange(10**15, 10**16)}", "in 1999", "1.2.3.4"], 7)))
    field = pii.fit(texts)
    assert field.agree > 0
    text = "call +1 (017) 555-7713 now. Later 555-7713, in 1999."
    base = pii.base_spans(text)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in field.added(text, base)] == [("phone", "555-7713")]
    assert field.added("Version 2.0 of 1999 and 12 more", []) == []
    assert pii.fit([]) is None and pii.fit(["no cue"]) is None


def test_detect(spark):
    rng = random.Random(2)
    texts = [None, "", "none", "é a@b.co é", "x" * 50_000 + " a@b.co", "1.2.3.256", "1.2.3.255 +1 (017) 555-7713"]
    texts += [f"word {rng.randrange(300)}.1.2.3 {with_check(str(rng.randrange(10**14, 10**15)))} m{k}@ex.org" for k in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(6, texts[6], 1), (None, "a@b.co", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = pii.detect(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a@b.co" if r.doc_id is None else texts[r.doc_id] or ""
        want = brute(text)
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(",")) and len(list(filter(None, r.spans.split(",")))) == len(want) + r.n_added
    assert pii.detect(df.limit(0)).count() == 0


def test_rollup(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, tokens long, old_tokens long"
    make = lambda *rows: spark.createDataFrame(rows, schema)
    rollup = Rollup(spark, str(tmp_path / "r"))
    totals = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}
    assert totals() == {}
    first = make(("a", "en", "v1", 10, 0), ("a", "en", "v1", 5, 0), ("b", None, "v1", 7, 0), (None, "de", "v2", 0, 0))
    assert rollup.commit("1", inserts(first)) and not rollup.commit("1", inserts(first))
    want = {("a", "en", "v1"): (2, 15), ("b", None, "v1"): (1, 7), (None, "de", "v2"): (1, 0)}
    assert totals() == want
    rollup.commit("2", deletes(make(("b", None, "v1", 7, 0))).union(revisions(make(("a", "en", "v1", 4, 10)))))
    want = {("a", "en", "v1"): (2, 9), (None, "de", "v2"): (1, 0)}
    assert totals() == want
    # a batch that was cut off was never renamed, does not count, and is written anew
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Rollup, "_publish", lambda self, written, name: False)
        rollup.commit("3", inserts(make(("z", "en", "v1", 1, 0))))
    assert totals() == want and any(n.startswith("_written") for n in rollup._names())
    # of two that commit one name at once, the second to rename gives way
    other = Rollup(spark, str(tmp_path / "r"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Rollup, "_known", lambda self, name: False)
        assert rollup.commit("3", inserts(make(("z", "en", "v1", 2, 0))))
        assert not other.commit("3", inserts(make(("z", "en", "v1", 9, 0)))) and not other.commit("1", inserts(first))
    want[("z", "en", "v1")] = (1, 2)
    assert totals() == want
    for _ in range(2):
        rollup.compact()
        assert totals() == want and not rollup.commit("1", inserts(first)) and not rollup.commit("3", inserts(first))
    rollup.commit("4", inserts(make()))
    rollup.commit("5", inserts(make(("z", "en", "v1", 3, 0))))
    rollup.compact()
    assert totals() == want | {("z", "en", "v1"): (2, 5)} and not rollup.commit("5", inserts(first))


def test_token_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["Hello world, it's 1999!\n\n  x", "", None, "äöü ß 漢字 🙂", "a" * 5000, "word " * 3000]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.tokens for r in count_tokens(df).collect()}
    other = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    assert got == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    many = df.union(spark.createDataFrame([(i, f"some text {i}", ("en", "de", None)[i % 3], ("s", None)[i % 2]) for i in range(10, 90)], df.schema))
    rows = count_tokens(many).collect()
    groups = {(r.source, r.lang) for r in rows}
    want = {(s, l, "byte_bpe_50k", len(own), sum(own)) for s, l in groups for own in [[r.tokens for r in rows if (r.source, r.lang) == (s, l)]]}
    assert set(map(tuple, roll_up(many).collect())) == want and len(want) > 4
    assert roll_up(df.limit(0)).count() == 0


def test_long_white_space_is_counted_as_it_is(spark):
    encoding = _encoding(open(VOCABULARY, "rb").read())
    rng = random.Random(5)
    for run in (" " * 5000, "\n" * 4096, "\t \n" * 3000, "\u2003" * 5000, " " * 4095):
        for text in (run, "word" + run, run + "word", f"one{run}two {run}\n!{run}", run + "'s" + run + "9", "x" * 5000 + run):
            assert count(encoding, text) == len(encoding.encode_ordinary(text))
    text = "".join(rng.choice(["a", " ", "  ", "é", "!", "\n" * 4100, " " * 4097, "\x85", "\x1c"]) for _ in range(300))
    assert count(encoding, text) == len(encoding.encode_ordinary(text))
    df = spark.createDataFrame([(1, " " * 5_000_000), (2, "\n" * 5_000_000 + "end")], "doc_id long, text string")
    assert {r.doc_id: r.tokens > 0 for r in count_tokens(df).collect()} == {1: True, 2: True}


def test_history_ends_in_the_plain_sums(spark, tmp_path):
    rows = [(("a", "b", None)[i % 3], ("en", None)[i % 2], "v", 10 + i, 3 * i, i % 4) for i in range(60)]
    counted = spark.createDataFrame(rows, "source string, lang string, tokenizer string, tokens long, words long, turn int")
    rollup, seen = Rollup(spark, str(tmp_path / "h")), []
    for name, deltas in history(counted).items():
        assert rollup.commit(name, deltas)
        seen.append(rollup.totals().agg({"documents": "sum", "tokens": "sum"}).first())
    want = {(s, l, "v", len(own), sum(own)) for s in ("a", "b", None) for l in ("en", None) for own in [[r[3] for r in rows if r[:2] == (s, l)]]}
    assert set(map(tuple, rollup.totals().collect())) == want
    assert len(set(seen)) > 2 and [r[0] for r in seen].count(45) + [r[1] for r in seen].count(45) == 1  # deleted on the way


def test_whole_neighbours_stay_apart():
    a, b = with_check("446575838288943"), with_check("753678412781305")
    field = pii.fit([f"pay {a} then {b}, or {a}" for _ in range(30)])
    assert pii._one(2, a[:8], a[8:]) and not pii._one(2, a, b) and not pii._one(2, "1" * 12, "2" * 12) and not pii._one(0, "a@b.co", "c@d.co")
    text = f"{a} {b}"
    assert pii.base_spans(text) == []  # too many digits for the pattern, which is not tried again
    assert set(field.added(text, [])) <= {(0, 2, 16), (17, 2, 33)}
    nodes = pii.Nodes("1 " * 40, [(0, 3, 79), (4, 2, 7), (10, 2, 13), (78, 0, 79)])
    assert nodes.observed.tolist() == [4] * 40


def test_marginals_against_enumeration():
    rng = np.random.default_rng(6)
    field = pii.Field(rng.normal(0, 0.5, (5, pii._SHAPES)), rng.normal(0, 0.5, (5, 5)), 0.7)

    def enumerated(nodes):
        own = nodes.shapes @ field.shapes.T
        n, out = len(own), np.zeros((len(own), 5))
        for y in itertools.product(range(5), repeat=n):
            if any(o >= 0 and o != v for o, v in zip(nodes.observed, y)):
                continue
            w = sum(own[i, v] for i, v in enumerate(y) if nodes.observed[i] < 0) + sum(field.moves[y[i], y[i + 1]] for i in nodes.links)
            weight = np.exp(w)
            for g in nodes.groups:  # the hub's label summed out
                weight *= sum(np.exp(field.agree * sum(y[i] == h for i in g)) for h in range(5))
            for i, v in enumerate(y):
                out[i, v] += weight
        return out / out.sum(axis=1, keepdims=True)

    # trees: exact
    for text, spans in (("12 345 6789", []), ("5551234 and 5551234", []), ("12 345 x 12", [(0, 3, 2)]), ("1 22 333 then 4444", [(2, 1, 4)])):
        nodes = pii.Nodes(text, spans)
        assert np.allclose(field.marginals(nodes), enumerated(nodes), atol=2e-3)
    # a loop: close
    nodes = pii.Nodes("5551234 77 5551234 77", [])
    assert len(nodes.groups) == 2 and np.abs(field.marginals(nodes) - enumerated(nodes)).max() < 0.08
