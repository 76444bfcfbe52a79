import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkfold.llm.near_dedup import components, keep_one, near_classes, prob_minhash, probability_jaccard, shingle_sets


def sentence(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n)]


def family(seed, n, words, edits):
    """Near copies of one text, each with its own edits: similarities on both sides of the threshold."""
    r = random.Random(seed)
    base = sentence(r, words)
    out = []
    for _ in range(n):
        mine = list(base)
        for _ in range(r.randint(0, edits)):
            mine[r.randrange(words)] = "".join(r.choice("xyz") for _ in range(6))
        out.append(" ".join(mine))
    return out


def plain_shingles(text):
    """Five-word shingles with how often they occur; a shorter text is one shingle."""
    words = re.findall(r"\w+", text.lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def plain_likeness(a, b):
    common = a.keys() & b.keys()
    if not common:
        return 0.0
    if max(a.values()) == max(b.values()) == 1:
        return len(common) / (len(a) + len(b) - len(common))
    # max(a[k] / a[i], b[k] / b[i]) is the first where a[k] / b[k] is above a[i] / b[i], else the second.
    rising = sorted(common, key=lambda k: a[k] / b[k])
    only_a, only_b = (sum(v for k, v in x.items() if k not in common) for x in (a, b))
    above, below, total = only_a + sum(a[k] for k in common), only_b, 0.0
    for k in rising:
        above, below = above - a[k], below + b[k]
        total += 1 / (above / a[k] + below / b[k])
    return total


def brute_classes(texts, similarity=0.8):
    sets = [plain_shingles(t or "") for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for i, t in enumerate(texts):
        parent[find(i)] = find(first.setdefault(t, i))
    inverted, shared = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    for docs in inverted.values():
        shared.update((a, b) for k, b in enumerate(docs) for a in docs[:k])
    for a, b in shared:
        if find(a) != find(b) and plain_likeness(sets[a], sets[b]) >= similarity - 1e-12:
            parent[find(b)] = find(a)
    return [find(i) for i in range(len(texts))]


def plain_jp(a, b):
    a, b = dict(zip(*map(np.ndarray.tolist, a), strict=True)), dict(zip(*map(np.ndarray.tolist, b), strict=True))
    keys = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(k, 0) / a[i], b.get(k, 0) / b[i]) for k in keys) for i in a.keys() & b.keys())


def test_probability_jaccard_and_its_estimate():
    r = random.Random(2)
    line = " ".join(sentence(r, 12))
    texts = [" ".join([line] * k + sentence(r, 30)) for k in (1, 3, 7)] + family(3, 4, 60, 12) + ["one two", "one two three", ""]
    doc, names, weights = shingle_sets(texts)
    sets = [(names[doc == i], weights[doc == i]) for i in range(len(texts))]
    signed = prob_minhash(doc, names, weights, len(texts), 6000)
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]):
                exact = probability_jaccard(sets[i], sets[j])
                assert exact == pytest.approx(plain_jp(sets[i], sets[j]))
                assert exact == pytest.approx(plain_likeness(plain_shingles(texts[i]), plain_shingles(texts[j])))
                assert abs((signed[i] == signed[j]).mean() - exact) < 0.04


def check(df, texts):
    got = {r.doc_id: r.class_id for r in near_classes(df).collect()}
    want = brute_classes(texts)
    least = {}
    for i, c in enumerate(want):
        least.setdefault(c, i)
    assert got == {i: least[c] for i, c in enumerate(want)}


def test_families_of_mixed_similarity(spark):
    texts = family(1, 60, 90, 9) + family(2, 40, 40, 3) + family(4, 30, 300, 20) + [f"{w} " * 3 for w in "abc"] + ["Same text.", "same TEXT", "same text"]
    r = random.Random(9)
    passage = " ".join(sentence(r, 60))
    texts += [passage + " " + " ".join(sentence(r, 30)) for _ in range(60)]
    r.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4), texts)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200) if i != 99] + [(500, 400), (500, 450), (7, 7)]
    df = spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(100)}, **{i: 100 for i in range(100, 201)}, 400: 400, 450: 400, 500: 400}


def test_nulls_copies_and_keep_one(spark):
    rows = [(5, "a b c d e f g", "n"), (5, "a b c d e f g", "n"), (3, "A b c, d e f g", "n"), (None, "a b c d e f g", "n"),
            (9, None, "n"), (8, "", "n"), (7, "!!", "n"), (None, "alone here", "n"), (None, "alone here", "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node string").selectExpr("*", "1 AS row", "2 AS copy")
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in near_classes(df).collect())
    assert got == Counter([(5, 3, 4)] * 2 + [(3, 3, 4), (None, 3, 4), (9, 8, 2), (8, 8, 2), (7, 7, 1)] + [(None, None, 2)] * 2)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([3, 8, 7, None])
    assert near_classes(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    check(df, texts)


def test_no_plan_repeats_the_links(spark, monkeypatch):
    """The driver holds the broadcasts of a running plan; what is used twice is a table of its own, not part of the plan twice."""
    from inkfold.llm import near_dedup

    joins = []

    def counted(df, keep=near_dedup.checkpointed):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return keep(df)

    monkeypatch.setattr(near_dedup, "checkpointed", counted)
    texts = [t for seed in range(3) for t in family(seed, 8, 60, 4)]
    rows = near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    classes = brute_classes(texts)
    assert [r.class_id for r in sorted(rows, key=lambda r: r.doc_id)] == [classes.index(c) for c in classes]
    assert max(joins) <= 4
