"""License scan and source mixing against plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from cellscape.llm import licenses, mixing, queries

PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def plain_scan(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    places = [i for i, _ in at]
    extra = set()
    for t in licenses.LINES:
        k, n = t.key
        for s in range(-len(t.words), len(words)):
            if s + k >= 0 and tuple(words[s + k : s + k + n]) == t.words[k : k + n] and all(0 <= s + j < len(words) and words[s + j] == w for j, w in enumerate(t.words)):
                extra.add(t.label)
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({b for _, b in at})), extra


def check_scan(rows, docs):
    got, want = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        got[r.doc_id].append(r)
    for r in docs:
        want[r.doc_id].append(plain_scan(r.text))
    assert got.keys() == want.keys()
    for k in want:
        assert sorted(map(str, [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[k]])) == sorted(map(str, [w[:5] for w in want[k]]))
        assert all(e <= set(r.labels.split(",")) for e in [w[5] for w in want[k]] for r in got[k]) or len(got[k]) > 1


@pytest.fixture()
def licensed(odd_docs):
    texts = [
        "Licensed under CC BY-NC 4.0.", "cc by cc by cc-by", "All Rights\nReserved. all rights reserved", "GNU General Public License general public license general public",
        "rights reserved", "license", "cc", "by cc by", "All rights reserved", "all rights all rights reserved", "x " * 5000 + "Released under the MIT License." + " y" * 5000,
        "licensed under the Apache License Version 3", "MIT License", "ccé by", "CC 0 BY", "The İ general public license ß",
    ]
    spark = odd_docs.sparkSession
    return odd_docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)


def test_licenses_odd_rows(licensed, no_docs):
    rows = licenses.scan_licenses(licensed).collect()
    check_scan(rows, licensed.collect())
    by = {r.doc_id: r for r in rows}
    assert by[110].labels == "mit" and [p.start for p in by[110].places] == [5000] and by[110].score == 1.0
    assert by[100].labels == "cc-by,cc-by-nc" and by[111].labels == "apache-2.0" and by[105].labels == ""
    assert licenses.scan_licenses(no_docs).count() == 0


def test_license_query(spark):
    sf = "/root/testdata/sf0.001"
    check_scan(queries.op4_license_scan(spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, stopped, left = {}, set(), float(sum(sizes.values()))
    while len(stopped) < len(order):
        level = left / sum(weight[s] for s in order if s not in stopped)
        over = [s for s in order if s not in stopped and weight[s] * level > 3 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in order if s not in stopped}
        for s in over:
            stopped.add(s)
            target[s] = 3.0 * sizes[s]
            left -= target[s]
    return target


def check_mix(rows, docs, near):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, words(r.text)) for r in docs)
    sizes, taken, target = Counter(), Counter(), {}
    for r in docs:
        sizes[r.source] += words(r.text)
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        taken[r.source] += r.taken
        target[r.source] = r.target
    smallest = {s: min((words(r.text) for r in docs if r.source == s), default=0) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - target[s]) <= near * target[s] + smallest[s] + 1, (s, taken[s], target[s])


def test_mix_skewed_sources(spark):
    """Sources from tiny to a third of all rows, one that only three copies of everything can serve."""
    rows, i = [], 0
    for s, n in enumerate([3000, 400, 400, 300, 40, 5, 1, 60]):
        for k in range(n):
            rows.append((i, " ".join(["w"] * (1 + (k * 7919) % 300 + (2500 if k % 97 == 0 else 0))), None if s == 7 else f"s{s}"))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs)
    check_mix(got.collect(), docs.collect(), 0.01)
    assert sorted(map(tuple, got.select("doc_id", "taken").collect())) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).select("doc_id", "taken").collect()))


def test_mix_hot_class_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 50)
    docs = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'a b c', repeat('w ', int(id % 50) + 1)) text", "if(id < 2000, 'hot', 'rare') source")
    check_mix(mixing.mix_sources(docs).collect(), docs.collect(), 0.005)


def test_mix_odd_rows(odd_docs, no_docs):
    check_mix(mixing.mix_sources(odd_docs).collect(), odd_docs.collect(), 0.02)
    assert mixing.mix_sources(no_docs).count() == 0
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    want = Counter()
    for r in mixing.mix_sources(odd_docs).collect():
        want[(r.doc_id, r.size)] += r.copies
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, words(r.text)) for r in mixed.collect()) == +want
    assert mixing.mixed_documents(no_docs).count() == 0


def test_tilt_follows_the_dual(spark):
    """Rates are exp(lambda * size / mean) under the cap and meet the token constraint."""
    classes = spark.createDataFrame([("0a", 1, 50, 50.0), ("0a", 10, 30, 300.0), ("0a", 40, 5, 200.0), ("0b", 5, 10, 50.0)], "key string, class int, n long, tokens double")
    targets = spark.createDataFrame([("0a", 900.0), ("0b", 20.0)], "key string, target double")
    state = {r["key"]: r for r in mixing.tilt(classes, targets).collect()}
    import math

    for r in classes.groupBy("key").agg({"n": "sum"}).collect():
        s = state[r["key"]]
        total = sum(c.tokens * min(3, math.exp(s.lam * c.tokens / c.n / s["mean"])) for c in classes.collect() if c["key"] == r["key"])
        assert total == pytest.approx(s.target, rel=1e-6)


def test_mix_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    check_mix(queries.op10_entropy_mix(spark, sf).collect(), docs, 0.03)
