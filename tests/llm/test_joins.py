"""Near copies, passages and benchmark hits against brute force."""

import random
import re

import pytest

from spotweave.llm import jaccard_join as jj
from spotweave.llm.decontaminate import decontaminate
from spotweave.llm.suffix_dedup import repeated_spans


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and den * n >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), d if not sets[i] else least[find(i)]) for i, (d, _) in enumerate(rows))


def family(rng, n, length, edits, vocab):
    """A text and edited copies, each with its own number of edits."""
    base = [rng.choice(vocab) for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            p = rng.randrange(len(w))
            if rng.random() < 0.3:
                del w[p]
            else:
                w[p] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, k, num):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for length, edits in ((8, 1), (15, 2), (40, 5), (150, 12), (150, 30), (600, 60)):
        texts += family(rng, 24, length, edits, vocab)
    texts += ["", None, " \n", "one", "ONE", "two words", "a b c", "A  b c", "x " * 300, "x " * 200]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[3]), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jj.jaccard_components(df, shingle=k, num=num, den=100)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == components(rows, k, num, 100)


def test_chains_that_miss_their_pivot_stay_whole(spark):
    """Members that no pivot links, but that link with each other."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(6):
        w = list(base)
        for p in rng.sample(range(300), 12):  # too far from the base
            w[p] = f"g{g}_{p}"
        for c in range(8):
            v = list(w)
            v[rng.randrange(300)] = f"g{g}c{c}"
            rows.append((len(rows), " ".join(v)))
    rows += [(1000 + i, " ".join(base[:-1] + [f"end{i}"])) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jj.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == components(rows, 3, 90, 100)


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (9, "other words stand here now ok"), (7, None), (8, None), (None, "a b c d e f g"), (4, "")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, x int")
    out = jj.keep_one(df.where("doc_id is not null"))
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 7, 8, 9]
    assert jj.keep_one(df.limit(0)).count() == 0


def test_empty_jaccard(spark):
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in jj.jaccard_components(one).collect()] == [(1, 0, 1)]


def windows(text, items, span=10):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    w = word(text)
    hit, ids = set(), set()
    for item, t in items:
        v = word(t)
        n = min(span, len(v))
        for s in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit.update(range(p, p + n))
                    if item is not None:
                        ids.add(str(item))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block", [1 << 25, 300])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(12)] + ["é", "Straße"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((0, 1, 2, 4, 5, 6, 9, 10, 11, 14, 30, 60))]
    items += [(3, "again an item"), (None, "nameless thing"), (20, None)]
    docs = [(0, None), (1, ""), (2, "a, nameless THING. again")]
    for i in range(3, 40):
        parts = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        for _, t in rng.sample(items[:12], 2):
            w = t.split()
            s = rng.randint(0, max(0, len(w) - 8))
            parts += w[s : s + rng.randint(0, 20)]
        docs.append((i, "-".join(parts)))
    docs.append(docs[5])
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(df, bench, keep=["doc_id"], block_bytes=block).collect()
    have = sorted((r.doc_id, r.n_words, sum(e - s for s, e in zip(r.hits[::2], r.hits[1::2], strict=True)), r["items"]) for r in got)
    assert have == sorted((d, *windows(t, items)) for d, t in docs)


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    [r] = decontaminate(docs, none).collect()
    assert (r.text, r.n_words, r.hits, r["items"]) == ("a b", 2, [], [])
    assert decontaminate(docs.limit(0), none).count() == 0


def repeats(rows, span):
    docs = {}
    for d, t in rows:
        docs[(d, t)] = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
    at = {}
    for key, w in docs.items():
        for s in range(len(w) - span + 1):
            at.setdefault(tuple(w[s : s + span]), set()).add(key)
    out = []
    for d, t in rows:
        w = docs[(d, t)]
        hit = sorted({p for s in range(len(w) - span + 1) if len(at[tuple(w[s : s + span])]) > 1 for p in range(s, s + span)})
        spans = []
        for p in hit:
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((d, len(w), sum(spans, []), len(hit)))
    return sorted(out)


def test_repeated_passages_equal_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    passages = [[rng.choice(vocab) for _ in range(n)] for n in (49, 50, 51, 70, 120, 300)]
    rows = [(0, None), (1, ""), (2, "short text")]
    for i in range(3, 60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            cut = rng.randint(0, 10) if rng.random() < 0.5 else 0
            s = rng.randint(0, len(w))
            w[s:s] = p[cut:]
        rows.append((i, " ".join(w)))
    rows += [(100, rows[10][1]), (101, rows[10][1]), rows[11]]
    for i, n in enumerate((49, 50, 51, 80, 300)):  # runs of one word, with something before and after
        rows.append((200 + i, " ".join([f"b{i}"] * i + ["run"] * n + [f"a{i}"] * 3)))
    rows += [(300, "lone " * 90), (301, "ab cd " * 60), (302, "x ab cd " + "ab cd " * 40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int").repartition(4)
    got = repeated_spans(df)
    assert sorted((r.doc_id, r.n_words, r.spans, r.n_repeated) for r in got.collect()) == repeats(rows, 50)
    assert repeated_spans(df.limit(0)).count() == 0


def hot_passage(n=160, pairs=6, lines=1):
    """A 40-word line in all documents; one half shares the words after it, the
    other those before it, and pairs that share both stand amid the two."""
    rng = random.Random(4)
    own = lambda k: [f"o{rng.randrange(10**9)}" for _ in range(k)]
    rows = []
    for p in range(pairs):
        line = [f"l{p % lines}_{i}" for i in range(40)]
        before, after = [f"b{p}_{i}" for i in range(5)], [f"a{p}_{i}" for i in range(5)]
        for i in range(n):
            rows.append(own(20) + (before + line + own(5) if i % 2 else own(5) + line + after) + own(20))
        rows += [own(20) + before + line + after + own(20) for _ in range(2)]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_partners_far_off_in_a_large_group_are_found(spark):
    rows = hot_passage()
    want = repeats(rows, 50)
    assert sum(n > 0 for *_, n in want) == 12
    got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((r.doc_id, r.n_words, r.spans, r.n_repeated) for r in got.collect()) == want
    with_other = {r.doc_id: r.other for r in got.where("n_repeated > 0").collect()}
    assert all(with_other[o] == d for d, o in with_other.items())


@pytest.mark.parametrize("partitions", [1, 150])
def test_groups_cut_over_partitions_stay_whole(spark, partitions):
    rows = hot_passage(n=13, pairs=200, lines=200)
    want = repeats(rows, 50)
    assert sum(n > 0 for *_, n in want) == 400
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert sorted((r.doc_id, r.n_words, r.spans, r.n_repeated) for r in got.collect()) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
