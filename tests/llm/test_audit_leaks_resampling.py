"""Filter audit, benchmark passages and importance resampling against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import pytest

from cellscape.llm import bytewords, decontamination, filter_audit, queries, resampling

SF = "/root/testdata/sf0.001"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# ---- filter audit


def plain_failed(docs):
    first = {}
    for r in docs:
        if r.doc_id is not None:
            first[r.text or ""] = min(r.doc_id, first.get(r.text or "", r.doc_id))
    out = []
    for r in docs:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": r.doc_id is not None and r.doc_id > first[t],
        }
        out.append((r.doc_id, r.source or "", {f for f, x in fails.items() if x}))
    return out


def plain_audit(docs, labels):
    good, toxic = ({r.doc_id for r in labels if r[c] == 1 and r.doc_id is not None} for c in ("quality", "toxic"))
    rows = plain_failed(docs)
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in rows}:
        own = [(i, f) for i, p, f in rows if p == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                left = [(i, x) for i, x in own if not x & set(order[:k])]
                gone = [i for i, x in left if f in x]
                shapley[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left) - len(gone), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own),
                    sum(i in good for i in gone), sum(i in toxic for i in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check_audit(got, docs, labels):
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert rows == plain_audit(docs.collect(), labels.collect())


@pytest.fixture()
def audited(odd_docs):
    rng = random.Random(3)
    rows = [(100 + i, " ".join(rng.choice(["Aa", "b", "c$", "dd", "e"]) if i % 3 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(400))), f"s{i % 3}" if i % 4 else None) for i in range(40)]
    rows += [(200 + i, rows[i % 5][1], "s2") for i in range(12)]
    return odd_docs.unionByName(odd_docs.sparkSession.createDataFrame(rows, "doc_id long, text string, source string"), allowMissingColumns=True)


def labels_for(spark):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 240, 3)] + [(3, 1, 1), (None, 1, 1), (6, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("size", [1, 300, 1 << 22])
def test_audit_odd_rows(spark, audited, monkeypatch, size):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", size)
    check_audit(filter_audit.audit_filters(audited.repartition(3), labels_for(spark)), audited, labels_for(spark))


def test_audit_empty_tables(spark, audited, no_docs):
    assert filter_audit.audit_filters(no_docs, labels_for(spark)).count() == 0
    none = labels_for(spark).limit(0)
    check_audit(filter_audit.audit_filters(audited, none), audited, none)


@pytest.mark.parametrize("slices", [1, 7, 2048])
def test_matrix_holds_every_word(spark, audited, monkeypatch, slices):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 2000)
    matrix = filter_audit.term_matrix(audited, slices=slices)
    words = {r.code: r.word for r in matrix.dictionary.collect()}
    assert len(words) == len(set(words.values())) == matrix.dictionary.count()
    got = Counter()
    for s in matrix.shards.collect():
        for i, row in enumerate(s.rows):
            own = {words[c]: n for c, n in zip(s.indices[s.indptr[i] : s.indptr[i + 1]], s.counts[s.indptr[i] : s.indptr[i + 1]], strict=True)}
            got[row.doc_id, tuple(sorted(own.items()))] += 1
    want = Counter((r.doc_id, tuple(sorted(Counter(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).items()))) for r in audited.collect())
    assert got == want


def test_words_are_counted_in_pieces():
    text = ("ab  cd\x0b\n ef" * 50 + " ñ" * 30 + "x" * 70 + " ").encode()
    for size in (1, 2, 3, 7, 64, 1000):
        assert filter_audit._count_words(text, size) == Counter(text.split())


def test_audit_query(spark):
    check_audit(queries.op11_filter_audit(spark, SF), spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


# ---- words by bytes


def test_words_and_runs_by_pieces():
    text = "Äpfel, a-b c\x00d 12é x __ 東京!" * 9
    for size in (1, 2, 5, 33, 10_000):
        assert [w.decode() for p in bytewords.word_pieces(text.encode(), size) for w in p] == words_of(text)
        for reach in (1, 4, 50):
            seen = []
            for base, words, start, end in bytewords.runs(text.encode(), reach, size):
                for i in range(start, end):
                    full = words_of(text)
                    near = full[max(0, base + i - reach) : base + i + reach + 1]
                    assert [w.decode() for w in words[max(0, i - reach) : i + reach + 1]] == near
                    seen.append(base + i)
            assert seen == list(range(len(words_of(text))))
    assert list(bytewords.runs(b"", 3)) == [] and list(bytewords.word_pieces(b"")) == [[]]


# ---- benchmark passages


def plain_passages(docs, items, width=10, shingle=2, share=1.0):
    windows = {}
    for r in items:
        w = words_of(r.text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(r.item_id)
    out = []
    for r in docs:
        w = words_of(r.text)
        hit, found = set(), set()
        if share == 1:
            met = [(i, tuple(w[i : i + n])) for n in {len(x) for x in windows} for i in range(len(w) - n + 1)]
            met = [(i, x) for i, x in met if x in windows]
        else:
            met = []
            for x in windows:
                k = min(shingle, len(x))
                total = len(x) - k + 1
                need = math.ceil(total * share - 1e-9)
                met += [(s, x) for s in range(len(w) - len(x) + 1) if sum(w[s + i : s + i + k] == list(x[i : i + k]) for i in range(total)) >= need]
        for s, x in met:
            hit |= set(range(s, s + len(x)))
            found |= windows[x]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((r.doc_id, len(w), len(hit), sum(x is not None for x in found), ids))
    return sorted(out, key=str)


def found_rows(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items) for r in found.documents.collect()), key=str)


@pytest.fixture()
def bench(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "a"] * 5 + [f"v{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(25)]
    items = [(i, t) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, "--"), (53, "One"), (54, "two three"), (3, texts[3]), (60, texts[4]), (None, texts[5]), (61, " ".join(["same"] * 14))]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(30)]
    docs += [(100 + i, f"x {t.upper()}! y" if i % 2 else t[: len(t) // 2] + " other " + t) for i, t in enumerate(texts)]
    docs += [(200, " ".join(["same"] * 40)), (201, "two, three one"), (202, None), (203, texts[0] + " " + texts[0]), (203, texts[0] + " " + texts[0]), (None, texts[1]), (204, ""), (205, "same " * 9)]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'k' key", "1 found", "'t' token"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("width", "shingle", "share"), [(10, 2, 1.0), (10, 1, 1.0), (4, 3, 1.0), (10, 2, 0.7), (8, 1, 0.8), (1, 2, 1.0)])
def test_passages_against_brute_force(bench, width, shingle, share):
    docs, items = bench
    got = decontamination.find_passages(docs.repartition(3), items, width, shingle, share)
    want = plain_passages(docs.collect(), items.collect(), width, shingle, share)
    assert found_rows(got) == want and any(r[2] for r in want)


def test_passages_full_slots(bench, monkeypatch):
    """With few slots nearly every shingle passes the tables; the join decides alone."""
    monkeypatch.setattr(decontamination, "SLOT_BITS", 3)
    monkeypatch.setattr(decontamination, "COUNTED", 5)
    docs, items = bench
    assert found_rows(decontamination.find_passages(docs, items)) == plain_passages(docs.collect(), items.collect())


def test_passages_odd_rows(spark, odd_docs, no_docs, bench):
    items = spark.createDataFrame([(1, "word1 filler word2 filler word3"), (2, "東京"), (3, None)], "item_id long, text string")
    got = decontamination.find_passages(odd_docs, items)
    assert found_rows(got) == plain_passages(odd_docs.collect(), items.collect())
    assert decontamination.find_passages(no_docs, items).documents.count() == 0
    none = decontamination.find_passages(odd_docs, items.limit(0)).documents.collect()
    assert len(none) == odd_docs.count() and all((r.n_hit, r.n_items, r["items"]) == (0, 0, "") for r in none)
    with pytest.raises(ValueError):
        decontamination.find_passages(odd_docs, items, share=0)


def test_passage_query(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op12_prefix_contamination(spark, SF).collect()}
    want = {i: (n, h, k, hashlib.sha256(ids.encode()).hexdigest(), h > 0) for i, n, h, k, ids in plain_passages(docs, items)}
    assert got == want and any(w[4] for w in want.values())


# ---- importance resampling


def plain_resampling(docs, target, percent=5, min_words=20):
    def features(text):
        w = words_of(text)
        return [crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = Counter(x for r in docs for x in features(r.text)), Counter(x for r in target for x in features(r.text))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in range(10_000)]
    rows = []
    for r in docs:
        f = features(r.text)
        h = int(hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((r.doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(r.text))))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def drawn_rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_resampling_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(9)
    rows = [(100 + i, " ".join(rng.choice(["red", "Blue", "grün", f"n{i % 9}"]) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    target = spark.createDataFrame([(1, "blue blue n3 red"), (2, None), (3, "Blue, red blue?")], "item_id long, text string")
    got = resampling.resample(docs.repartition(5), target, percent=20)
    assert drawn_rows(got) == plain_resampling(docs.collect(), target.collect(), percent=20)
    assert sum(r["rank"] is not None for r in got.collect()) > 10
    assert resampling.resample(no_docs, target).count() == 0
    assert drawn_rows(resampling.resample(docs, target.limit(0))) == plain_resampling(docs.collect(), [])
    texts = resampling.resampled_documents(docs, target, percent=20)
    assert texts.columns == docs.columns
    assert {r.doc_id for r in texts.collect()} == {r.doc_id for r in got.where("rank is not null").collect()}


def test_equal_scores_and_repeated_rows_are_ranked_once(spark):
    """A third of the rows are one row; places stay 1 to n and follow score, then id."""
    rows = spark.range(3000).selectExpr("id key", "if(id % 3 = 0, 7L, id % 11) score", "if(id % 3 = 0, 5L, id % 200) doc_id")
    got = resampling.ranked(rows, 7).join(rows, "key").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 3001))
    order = [(-r.score, r.doc_id) for r in got]
    assert order == sorted(order)


def test_long_text_features_by_pieces(monkeypatch):
    text = " ".join(f"w{i * 7919 % 50}" for i in range(300)).encode()
    whole = Counter(next(resampling.buckets_of(text))[1].tolist())
    for size in (1, 5, 40):
        monkeypatch.setattr(resampling, "word_pieces", lambda t, size=size: bytewords.word_pieces(t, size))
        parts = list(resampling.buckets_of(text))
        assert sum(n for n, _ in parts) == 300 and Counter(b for _, f in parts for b in f.tolist()) == whole


def test_resampling_query(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert drawn_rows(queries.op13_importance_resampling(spark, SF)) == plain_resampling(docs, target)
