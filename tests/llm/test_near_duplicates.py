"""Near-duplicate texts and vectors against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellscape.llm import bagminhash as bag, embeddings as emb, queries


def plain_bag(text):
    w = text.lower().split()
    if not w:
        return Counter()
    return Counter([tuple(w)]) if len(w) < 5 else Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def plain_classes(rows):
    """Least id per connected class of (id, text) rows by exact weighted Jaccard of all pairs of distinct texts."""
    ids = defaultdict(list)
    for i, t in rows:
        if t is not None:
            ids[t].append(i)
    texts = list(ids)
    bags = [plain_bag(t) for t in texts]
    total = [sum(b.values()) for b in bags]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = defaultdict(list)
    for k, b in enumerate(bags):
        near = Counter(o for s in b for o in index[s])
        for o in near:
            shared = sum((bags[k] & bags[o]).values())
            if shared >= 0.8 * (total[k] + total[o] - shared):
                root[find(k)] = find(o)
        for s in b:
            index[s].append(k)
    least = {}
    for k, t in enumerate(texts):
        known = [i for i in ids[t] if i is not None]
        least[find(k)] = min([*known, *([least[find(k)]] if least.get(find(k)) is not None else [])], default=None)
    return {t: least[find(k)] for k, t in enumerate(texts)}


def edited(rng, words, voc, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = rng.choice(voc)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(4000)]
    rows, i = [], 0
    passage = [rng.choice(voc) for _ in range(120)]
    for _ in range(60):
        words = [rng.choice(voc) for _ in range(rng.choice([6, 40, 150, 600]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            rows.append((i, " ".join(edited(rng, words, voc, rng.choice([0, 0, 1, len(words) // 60 + 1])))))
            i += 1
    big = [rng.choice(voc) for _ in range(400)]  # a large family of different near copies
    for _ in range(150):
        rows.append((i, " ".join(edited(rng, big, voc, rng.randrange(1, 9)))))
        i += 1
    for _ in range(60):  # a passage that many texts share, not enough to be alike
        rows.append((i, " ".join([*passage, *[rng.choice(voc) for _ in range(rng.choice([40, 60, 120]))]])))
        i += 1
    for _ in range(30):  # multiplicities decide
        rows.append((i, " ".join(["a b c d e f g"] * rng.randrange(1, 12))))
        i += 1
    return rows


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(2)
    voc = [f"w{i}" for i in range(500)]
    gaps = []
    for _ in range(40):
        a = [rng.choice(voc) for _ in range(rng.choice([30, 200, 900]))]
        a += a[: rng.randrange(1, 30)] * rng.randrange(0, 9)
        b = edited(rng, a, voc, len(a) // rng.choice([20, 50, 200]) + 1) + a[:10] * rng.randrange(0, 4)
        a, b = " ".join(a), " ".join(b)
        s = bag.signatures(*bag.bags([a, b]), 2)
        gaps.append((s[0] == s[1]).mean() - bag.overlap(a, b))
    assert abs(np.mean(gaps)) < 3 * 0.5 / np.sqrt(40 * bag.SIZE) + 0.005 and max(map(abs, gaps)) < 0.16


def test_signature_does_not_depend_on_the_batch():
    texts = ["a b c d e f g h", "x " * 300, "one", "a b c d e f g h " * 40]
    alone = [bag.signatures(*bag.bags([t]), 1)[0] for t in texts]
    assert np.array_equal(np.array(alone), bag.signatures(*bag.bags(texts), len(texts)))


def test_overlap_is_exact():
    rng = random.Random(3)
    for _ in range(50):
        a = " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))
        b = " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))
        x, y = plain_bag(a), plain_bag(b)
        want = sum((x & y).values()) / max(1, sum((x | y).values()))
        assert bag.overlap(a, b) == pytest.approx(want)


def test_classes_match_brute_force(spark, corpus):
    want = plain_classes(corpus)
    got = bag.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")).collect()
    assert len(got) == len(corpus)
    texts = dict(corpus)
    assert {r.doc_id: r.class_id for r in got} == {i: want[t] for i, t in texts.items()}


def test_small_blocks_reach_the_same_classes(spark, corpus, monkeypatch):
    monkeypatch.setattr(bag, "BLOCK", 16)
    monkeypatch.setattr(bag, "COLUMNS", 100)
    rows = corpus[-240:]
    want = plain_classes(rows)
    got = bag.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: want[t] for i, t in rows}


def test_texts_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    want = plain_classes([(r.doc_id, r.text) for r in rows])
    got = bag.near_duplicates(odd_docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == sorted((str(r.doc_id), str(want[r.text] if r.text is not None else r.doc_id)) for r in rows)
    kept = bag.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(t) for t in {r.text for r in rows})
    assert bag.near_duplicates(no_docs).count() == 0 and bag.one_of_each(no_docs).count() == 0


def test_text_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_classes(rows)
    got = queries.op9_bagminhash(spark, sf).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: want[t] for i, t in rows}
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def plain_links(rows):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = Counter(), {k: k for k in range(len(ok))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit = [v / np.abs(v).max() for _, v, _ in ok]
    unit = [v / np.linalg.norm(v) for v in unit]
    for a in range(len(ok)):
        for b in range(a):
            if ok[a][2] == ok[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in range(len(ok)):
        least[find(k)] = min(ok[k][0], least.get(find(k), ok[k][0]))
    out = [(str(ok[k][0]), links[k], str(least[find(k)])) for k in range(len(ok))]
    bad = len(rows) - len(ok)
    return out, bad


def vectors(rng, n, dims, spread):
    rows, i = [], 0
    while i < n:
        centre = rng.standard_normal(dims)
        for _ in range(rng.choice([1, 1, 3, 8])):
            rows.append((i, (centre + spread * rng.standard_normal(dims) * rng.random()).astype(np.float32).tolist(), int(rng.integers(3))))
            i += 1
    return rows


@pytest.mark.parametrize("dims", [64, 16, 200])
def test_links_reach_recall_and_no_false_link(spark, dims):
    rng = np.random.default_rng(dims)
    rows = vectors(rng, 500, dims, 0.5)
    rows += [(10_000 + i, rows[3][1], rows[3][2]) for i in range(5)]
    want, _ = plain_links(rows)
    got = {str(r.vec_id): r for r in emb.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found, there = sum(r.n_links for r in got.values()), sum(n for _, n, _ in want)
    assert there and 0.97 * there <= found <= there
    assert all(got[i].n_links <= n for i, n, _ in want)
    assert all(int(got[i].component_id) >= int(c) for i, _, c in want)


def test_hot_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(emb, "BLOCK", 64)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(64)
    rows = [(i, (centre + 0.05 * rng.standard_normal(64)).tolist(), 1) for i in range(400)] + vectors(rng, 100, 64, 0.1)
    rows = [(i, v, lab) for i, (_, v, lab) in enumerate(rows)]
    want, _ = plain_links(rows)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in emb.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted(want)


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [nan, 1.0, 2.0], 1), (10, [inf, 1.0, 2.0], 1),
        (11, [None, 1.0, 2.0], 1), (12, [1e300, 2e300, 3e300], 1), (None, v, 1), (14, [1.0, 2.0], 1), (15, [1.0, 2.0, 3.0, 0.0], 1), (16, [-1.0, -2.0, -3.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, copies int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in emb.link_vectors(df).collect()}
    assert len(got) == len(rows)
    assert {i: got[i] for i in (1, 2, 3, 12)} == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 12: (3, 1, False)}
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 14, 15, 16)) and got[None] == (0, None, False)
    assert emb.link_vectors(df.limit(0)).count() == 0


def test_vector_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, bad = plain_links(rows)
    got = queries.op2_itq_dedup(spark, sf).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == sorted(want) and bad == 0


@pytest.mark.parametrize(("background", "least"), [(0.0, 0.995), (0.5, 0.95)])
def test_recall_on_clustered_table(spark, background, least):
    """Links of clustered vectors against brute force in blocks, also where all vectors share a direction."""
    rng = np.random.default_rng(12)
    size = rng.choice([1, 2, 5, 40], 300, p=[0.5, 0.2, 0.2, 0.1])
    centre = np.repeat(emb.unit(rng.standard_normal((300, 64))), size, axis=0)
    x = emb.unit(centre + 0.035 * rng.standard_normal((len(centre), 64)) * rng.random((len(centre), 1)))
    common = emb.unit(rng.standard_normal((1, 64)))
    x = emb.unit(np.sqrt(1 - background) * x + np.sqrt(background) * common)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in emb.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = {}
    for lab in (0, 1):
        own = np.arange(len(x)) % 2 == lab
        for i, n in zip(np.flatnonzero(own).tolist(), ((x[own] @ x[own].T) >= 0.93).sum(1) - 1, strict=True):
            want[i] = n
    assert all(got[i] <= n for i, n in want.items())
    assert sum(want.values()) > 1000 and sum(got.values()) >= least * sum(want.values())
