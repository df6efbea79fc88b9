"""Shared spans, near-duplicates and the fact history against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import CHUNKS, chunk_rows, numbered, words
from weftline.functions.codepoints import mix
from weftline.llm import fact_history
from weftline.llm.near_duplicates import NearDuplicates, guaranteed
from weftline.llm.positional import rare_pairs
from weftline.llm.shared_spans import same_path, shared_spans


def clean(t):
    return "\n".join(re.sub(r"^[0-9]+: ", "", x) for x in t.split("\n"))


def owner(p):
    p = (p or "\0").replace("\\", "/")
    return re.sub(r"^(\./)+", "", p)


def brute_spans(rows, span):
    seen = {}
    for t, p in rows:
        if t is not None:
            c = clean(t)
            for k in range(len(c) - span + 1):
                seen.setdefault(c[k : k + span], set()).add(owner(p))
    out = {}
    for i, (t, p) in enumerate(rows, 1):
        if t is None:
            continue
        c = clean(t)
        covered = set()
        for k in range(len(c) - span + 1):
            if len(seen[c[k : k + span]]) > 1:
                covered |= set(range(k, k + span))
        if covered:
            out[i] = len(covered)
    return out


def span_rows():
    r = random.Random(3)
    base = [" ".join(words(s, 60)) for s in range(6)]
    header = "licence " * 9 + "end of it"
    rows = []
    for i in range(70):
        a, b = base[r.randrange(6)], base[r.randrange(6)]
        k, j = r.randrange(len(a)), r.randrange(len(b))
        text = (header if i % 3 == 0 else "") + a[k : k + r.randrange(20, 140)] + "\n" + " ".join(words(100 + i, 8)) + "\n" + b[j : j + r.randrange(20, 140)]
        rows.append((numbered(text), f"f{i % 25}" if i % 7 else f".\\f{i % 25}"))
    rows += [(None, "n"), ("", "e"), ("1: ", "e2"), ("1: " + "x" * 30000, "long"), ("1: " + "x" * 500, "long2"), (numbered(header * 3), None), (numbered(header * 3, 9), None), (numbered("own " * 40), "q"), (numbered("own " * 40, 5), "./q"), (numbered("two " * 40), "q1"), (numbered("two " * 40, 3), "q2"), ("1: " + "ab" * 400, "p1"), ("5: " + "ab" * 300, "p2")]
    return rows


def test_windows_of_crowded_phrases_dont_pass_the_drivers_python(spark, monkeypatch):
    text = " ".join(words(5, 40))
    df = spark.createDataFrame(chunk_rows([(numbered(f"{i} {text} {i}"), f"p{i}") for i in range(12)]), CHUNKS)
    kind = type(df)
    collected, collect = [], kind.collect

    def watched(self):
        rows = collect(self)
        collected.append(self.columns)
        return rows

    monkeypatch.setattr(kind, "collect", watched)
    found = shared_spans(df, "row_id", "documents", same_path(F.col("path")), span=60, phrase=20, numbered=True, crowded=5)
    assert found.count() == 12 and not any("window" in c for c in collected)


@pytest.mark.parametrize(("crowded", "held"), [(5000, 100), (5, 10**6), (5, 10)])
def test_spans(spark, crowded, held):
    rows = span_rows()
    df = spark.createDataFrame(chunk_rows(rows), CHUNKS)
    found = shared_spans(df, "row_id", "documents", same_path(F.col("path")), span=60, phrase=20, numbered=True, crowded=crowded, held=held).collect()
    assert {r["id"]: r["shared"] for r in found} == brute_spans(rows, 60)
    for r in found:
        assert all(s["end"] - s["begin"] >= 60 for s in r["spans"])


def test_windows_of_equal_hashes_are_compared_by_letters(monkeypatch):
    from weftline.llm import shared_spans as module

    real = module._window_hashes
    monkeypatch.setattr(module, "_window_hashes", lambda runs, span: (real(runs, span)[0] % np.uint64(3), real(runs, span)[1]))
    r = random.Random(4)
    runs = ["".join(r.choice("ab") for _ in range(r.randrange(8, 25))) for _ in range(40)]
    owners = np.array([r.randrange(4) for _ in runs])
    found = module._verified_spans(runs, np.arange(40), owners, np.zeros(40, np.int64), 8).to_pylist()
    got = {(f["id"], k) for f in found for k in range(f["begin"], f["end"] - 7)}
    assert got == {(i, k) for i, x in enumerate(runs) for k in range(len(x) - 7) if any(owners[j] != owners[i] and x[k : k + 8] in y for j, y in enumerate(runs))}


def test_no_spans(spark):
    df = spark.createDataFrame([], CHUNKS)
    assert shared_spans(df, "row_id", "documents", F.col("path")).count() == 0


def shingles(t, n):
    w = re.findall(r"\w+", t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_rows():
    r = random.Random(5)
    rows = []
    for s in range(12):
        base = words(s, r.choice([3, 4, 20, 60, 150]))
        for _ in range(8):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 12)):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(9))
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = w[k:] + w[:k]
            rows.append((numbered(" ".join(w)), f"p{s}"))
    return [*rows, *rows[:5], (None, "a"), ("", "a"), ("1: one two", "a"), ("1:  \n2: ", "b")]


@pytest.mark.parametrize(("n", "threshold", "options"), [(3, 0.7, {}), (5, 0.8, {}), (3, 0.7, {"exact": True}), (3, 0.7, {"crowded": 2}), (5, 0.8, {"crowded": 4}), (2, 0.5, {"exact": True})])
def test_near_duplicates(spark, n, threshold, options):
    rows = near_rows()
    near = NearDuplicates(spark.createDataFrame(chunk_rows(rows), CHUNKS), "row_id", "documents", n, threshold, numbered=True, **options)
    sets = {i: s for i, (t, _) in enumerate(rows, 1) if t is not None and (s := shingles(clean(t), n))}
    true = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    assert sorted((r["a"], r["b"]) for r in near.pairs().collect()) == sorted(true)
    groups = {r["id"]: r["group"] for r in near.groups().collect()}
    assert set(groups) == set(sets) and all(groups[a] == groups[b] for a, b in true)
    assert all(groups[g] == g for g in set(groups.values()))


@pytest.mark.parametrize("split", [3, 10**6])
def test_rare_pairs_lose_none(spark, split):
    r = random.Random(9)
    rows = []
    for i in range(80):
        some = {r.randrange(40) for _ in range(r.randrange(1, 30))} | ({1000 + k for k in range(25)} if i % 2 else set())
        rows.append((i, np.sort(mix(np.array(sorted(some), np.uint64)))))
    true = {(i, j) for i, x in rows for j, y in rows if i < j and len(np.intersect1d(x, y)) * 10 >= 7 * len(np.union1d(x, y))}
    df = spark.createDataFrame([(i, x.tobytes()) for i, x in rows], "id bigint, elements binary")
    found = {(x["a"], x["b"]) for x in rare_pairs(df, 0.7, split).collect()}
    assert true and true <= found


def test_a_template_makes_no_candidates(spark):
    """Records that share two fifths of their union with each other, all by one template: far fewer candidates than pairs."""
    template = " ".join(words(1, 60))
    rows = [(f"1: {template}\n2: " + " ".join(words(1000 + i, 45)), f"p{i}") for i in range(400)]
    near = NearDuplicates(spark.createDataFrame(chunk_rows(rows), CHUNKS), "row_id", "documents", 3, 0.7, numbered=True, crowded=50)
    assert near.candidates.count() < 400 and near.links.count() == 0


def test_near_duplicates_of_nothing(spark):
    near = NearDuplicates(spark.createDataFrame([], CHUNKS), "row_id", "documents")
    assert near.pairs().count() == 0 and near.groups().count() == 0


def test_guaranteed_matches():
    assert guaranteed(16, 0.7) == 3 and guaranteed(16, 1.0) == 16 and guaranteed(1, 0.5) == 1


def fact_rows():
    r = random.Random(2)
    rows = []
    for i in range(160):
        n = r.choice([1, 2, 4, 5, 9, 20, 40])
        base = words(r.randrange(12) * 10 + n, n)
        w = [("new" + str(r.randrange(5)) if r.random() < 0.08 else x) for x in base]
        r.shuffle(w)
        rows.append((i, ", ".join(w), 1 + i % 5 if i % 31 else None, "2024"))
    rows += [(1000, None, 1, ""), (1001, "", 1, ""), (1002, " ?!", 2, ""), (1003, " ?!", 2, ""), (1004, "w " * 20000, 3, ""), (1005, "W", 4, "")]
    return rows


def greedy(rows):
    accepted, out = [], []
    for i, t, b, _ in sorted(rows, key=lambda x: (x[2] if x[2] is not None else 2**31, x[0])):
        s = set(re.findall(r"\w+", (t or "").lower()))
        if s and any(10 * len(s & o) >= 8 * len(s | o) for o in accepted):
            out.append(i)
        elif s:
            accepted.append(s)
    return sorted(out)


FACTS = "mem_id bigint, content string, batch_no int, sigs string"


def test_facts(spark):
    rows = fact_rows()
    found = fact_history.rejected(spark.createDataFrame(rows, FACTS), "mem_id", "content", "batch_no", growth=2)
    assert sorted(r["id"] for r in found.collect()) == greedy(rows)
    assert fact_history.rejected(spark.createDataFrame([], FACTS), "mem_id", "content", "batch_no").count() == 0


@pytest.mark.parametrize(("held", "few", "crowd"), [(10**6, 10**6, 10**6), (1, 1, 0)])
def test_batches_one_by_one(spark, tmp_path, held, few, crowd):
    rows = [x for x in fact_rows() if x[2] is not None]
    history = fact_history.FactHistory(spark, f"file://{tmp_path}", held, few, crowd)
    out = []
    for b in range(1, 6):
        batch = spark.createDataFrame([x for x in rows if x[2] == b], FACTS)
        out += [r["id"] for r in history.add(batch, "mem_id", "content", "batch_no").where("not accepted").collect()]
    assert sorted(out) == greedy(rows)


def test_near_small_sets_share_first_words():
    """Whatever the order, near sets have as many of their first words in common as are joined on."""
    r = random.Random(11)
    for n in range(1, fact_history.SMALL + 1):
        for m in range(-(-4 * n // 5), n + 1):
            common = -(-4 * (n + m) // 9)
            for _ in range(30):
                order = r.sample(range(100), 100)
                x, y = (sorted((*range(common), *own), key=order.__getitem__) for own in (range(40, 40 + n - common), range(70, 70 + m - common)))
                (a, joint), (b, again) = fact_history.first_words(n, m), fact_history.first_words(m, n)
                assert joint == again and len(set(x[:a]) & set(y[:b])) >= joint


def test_facts_of_one_template_meet_few(spark, tmp_path):
    """Facts that differ in two words of eleven are no near pairs, and hardly any words are read for them; those that differ in one are rejected in turn."""
    rows = [(i, f"always keep the report of {words(i, 1)[0]}{i} beside folder number w{i * 7} please", 1 + i % 3, "") for i in range(600)]
    rows += [(1000 + i, f"please remember that the key of the store room number {i} hangs there", 1 + i % 3, "") for i in range(300)]
    history = fact_history.FactHistory(spark, f"file://{tmp_path}", crowd=2000)
    met, out = [], []
    for b in (1, 2, 3):
        batch = spark.createDataFrame([x for x in rows if x[2] == b], FACTS)
        out += [r["id"] for r in history.add(batch, "mem_id", "content", "batch_no").where("not accepted").collect()]
        met.append(history.met)
    assert sorted(out) == [1000 + i for i in range(1, 300)] == greedy(rows)
    assert max(met) < 1000


def test_near_sets_share_a_key():
    """Any choice of as many classes as must agree has two in one group."""
    for n in range(1, 300):
        for m in range(n, int(1.25 * n) + 1):
            b = fact_history.size_range(m)
            assert b - fact_history.size_range(n) <= 1 and (n + m) // 9 <= fact_history.radius(b)
    for b in range(12):
        classes, i, j = fact_history.joint_classes(b)
        agreeing = classes - fact_history.radius(b)
        apart = {k % (agreeing - 1) for k in range(classes)}
        assert len(apart) == agreeing - 1 and {(x, y) for x in range(classes) for y in range(x + 1, classes) if x % (agreeing - 1) == y % (agreeing - 1)} == set(zip(i.tolist(), j.tolist()))
