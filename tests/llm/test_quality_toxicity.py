"""Quality rules and toxicity against plain Python, planted rules and held-out labels."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from cellscape.llm import quality, queries, toxicity


def plain_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check_figures(rows, docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted((str(r.doc_id), *[r[n] for n in names]) for r in rows)
    assert got == sorted((str(i), *plain_figures(t)) for i, t in docs)
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


REPEATS = ["a b c d e a b c d e", "a a a a a a a a", "a b c d e f a b c d e x a b c d e", "x y z\nx y z\n \n\n \nx y z ", "é#é ##\n#é|", "one two three four five one two three four", "p q r s t u p q r s t u v"]


def test_figures_odd_rows(odd_docs, no_docs):
    spark = odd_docs.sparkSession
    docs = odd_docs.unionByName(spark.createDataFrame([(200 + i, t) for i, t in enumerate(REPEATS)], "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    check_figures(quality.score_quality(docs, labels).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {r.doc_id for r in docs.collect()}
    assert quality.score_quality(no_docs, labels.limit(0)).count() == 0 and quality.keep_good(no_docs, labels).count() == 0


def test_planted_rules_are_found(spark):
    """Two planted conjunctions, one in ten labels wrong: the list keeps clean rows and rejects planted ones."""
    rng = random.Random(4)
    rows = []
    for i in range(6000):
        f = {n: rng.random() for n in quality.FEATURES}
        bad = (f["symbol_share"] >= 0.8 and f["mean_word"] < 0.5) or f["upper_share"] >= 0.93
        label = int(not bad) if rng.random() < 0.95 else int(bad)
        rows.append((*[f[n] for n in quality.FEATURES], label, rng.randrange(3), bad))
    df = spark.createDataFrame(rows, [*quality.FEATURES, "__label", "__part", "bad"])
    rules = quality.learn_rules(df)
    assert rules and all(str(r) for r in rules)
    kept, fired = quality.decision(rules, {n: df[n] for n in quality.FEATURES})
    got = df.select("bad", kept.alias("kept"), fired.alias("rule")).collect()
    assert np.mean([r.kept for r in got if not r.bad]) > 0.97 and np.mean([not r.kept for r in got if r.bad]) > 0.85
    assert all((r.rule is None) == r.kept for r in got)
    assert quality.learn_rules(df.limit(0)) == []


def test_quality_query_and_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_decision_list(spark, sf).collect()
    check_figures(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r.kept, label[r.doc_id]) for r in rows if r.doc_id in label and not r.base_failed]
    assert np.mean([k for k, q in judged if q == 1]) > 0.97 and np.mean([not k for k, q in judged if q == 0] or [1]) > 0.6


def brute_marginals(field, n, places, numbers):
    """Marginals of T by plain forward-backward over every token."""
    ot, to, tt = np.exp(field.moves)
    at = dict(zip(places, numbers, strict=True))
    steps = []
    for i in range(n):
        e = np.exp(field.weights[at[i]] if i in at else field.other)
        steps.append(np.array([[1.0, ot * e], [to, tt * e]]))
    alpha, beta = [np.array([1.0, 0.0])], [np.ones(2)]
    for m in steps:
        a = alpha[-1] @ m
        alpha.append(a / a.sum())
    for m in reversed(steps):
        b = m @ beta[-1]
        beta.append(b / b.sum())
    beta = beta[::-1]
    joint = [alpha[i + 1] * beta[i + 1] for i in range(n)]
    return np.array([joint[i][1] / joint[i].sum() for i in places])


def test_marginals_cross_runs_exactly():
    rng = np.random.default_rng(6)
    field = toxicity.Field({f"w{k}": k for k in range(5)}, rng.normal(0, 2, 5), -3.0, (-0.5, 0.3, 1.1))
    found = []
    for n in [1, 2, 7, 40, 300, 3000]:
        places = sorted(rng.choice(n, size=min(n, int(rng.integers(0, 30))), replace=False).tolist())
        found.append((n, places, rng.integers(0, 5, len(places)).tolist()))
    for (n, p, k), got in zip(found, toxicity.marginals_of(field, found), strict=True):
        assert np.allclose(got, brute_marginals(field, n, p, k) if p else [], atol=1e-9)


def test_log_partition_matches_all_paths():
    field = toxicity.Field({"a": 0, "b": 1}, np.array([0.7, -1.2]), -0.4, (-0.3, 0.2, 0.9))
    n, places, numbers = 9, [0, 3, 4, 8], [0, 1, 0, 1]
    at = dict(zip(places, numbers, strict=True))
    total = 0.0
    for path in range(2**n):
        tags, score, before = [(path >> i) & 1 for i in range(n)], 0.0, 0
        for i, t in enumerate(tags):
            score += {(0, 0): 0.0, (0, 1): field.moves[0], (1, 0): field.moves[1], (1, 1): field.moves[2]}[before, t]
            score += t * (field.weights[at[i]] if i in at else field.other)
            before = t
        total += np.exp(score)
    log_z, _ = toxicity.Chain([n], [places], [numbers]).forward(field)
    assert log_z[0] == pytest.approx(np.log(total))


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(8)
    voc, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)], ["grobnik", "fulzer", "SNARG"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(voc) for _ in range(rng.randrange(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w) + ("!!" if i % 2 else "")))
        labels.append((i, 1, int(toxic)))
    for i in range(900, 930):  # copies of one toxic text: its other words are not toxic
        rows.append((i, rows[0][1] + f" extra{i}"))
        labels.append((i, 1, 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_spans_and_scores(insults):
    docs, labels = insults
    from pyspark.sql import functions as F

    field = toxicity.fit_toxicity(docs, labels, where=~toxicity.held_out(F.col("doc_id")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    label = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score_toxicity(docs, field).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert sorted(w for s in r.spans for w in texts[r.doc_id][s.start : s.end].split()) == sorted(re.findall("grobnik|fulzer|SNARG", texts[r.doc_id]))
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and all(r.predicted == label[r.doc_id] for r in held)
    clean = toxicity.drop_toxic(docs, labels)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, t in label.items() if not t}


def test_scores_do_not_depend_on_batches(insults):
    docs, labels = insults
    field = toxicity.fit_toxicity(docs, labels)
    a = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, field).collect()}
    b = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.repartition(13), field).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_toxicity_odd_rows(odd_docs, no_docs, insults):
    docs, labels = insults
    field = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(odd_docs, field).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score < 0.5 and r.predicted == 0 and r.spans == [] for r in got)
    empty = toxicity.fit_toxicity(no_docs, labels.limit(0))
    assert toxicity.score_toxicity(no_docs, empty).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(odd_docs, empty).collect())
    assert toxicity.drop_toxic(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert toxicity.spans_of("İİ grobnik fulzer", [2, 3], np.array([0.9, 0.8])) == [{"start": 5, "end": 19, "probability": 0.9}]


def test_toxicity_query_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op3_crf_toxicity(spark, sf).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    tox, clean = [s for s, t in held if t], np.array([s for s, t in held if not t])
    auc = np.mean([(clean < s).mean() + 0.5 * (clean == s).mean() for s in tox])
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and auc > 0.93
