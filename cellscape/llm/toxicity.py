"""Toxic spans and scores by a linear-chain conditional random field.

Two tags, O and T, run over the words of a text.  Labels are per document, so token labels come first: word
counts over a bounded sample of labelled texts give candidate words, and those whose share of toxic texts beats
chance over all words are the toxic ones; their occurrences in toxic texts are the T tokens.  The field has a
weight per candidate word, one for any other word, and transition weights.  Between candidate words all tokens
look alike, so forward and backward messages cross such a run by a closed power of the 2x2 transfer matrix: the
marginals are exact and the work per text is one look-up per word.  Marginals at candidate words give the spans;
their noisy-or, calibrated on the sample, is the score of the document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from cellscape.llm.common import bound_batches, text_of
from cellscape.llm.labelled import labelled_sample
from cellscape.session import cut_lineage

TOKEN = re.compile(r"[^\W_]+")
#: Most labelled rows that the field is learned from.
SAMPLE_ROWS = 20_000
#: Characters of text that a worker tags at once.
CHUNK_CHARS = 1 << 20
MIN_TEXTS, MIN_ODDS = 3, 4.0
#: Log likelihood by which a toxic word must beat chance over all words.
MARGIN = 1.0
STEPS, RATE, RIDGE = 120, 0.15, 1e-3
FLOOR = 1e-6
SCHEMA = "score double, spans array<struct<start:int,end:int,probability:double>>"


@dataclass(frozen=True)
class Field:
    """Weights: per word, other words, and the transitions O-T, T-O and T-T; then slope and intercept of the score."""

    words: dict[str, int]
    weights: np.ndarray
    other: float
    moves: tuple[float, float, float]
    slope: float = 1.0
    intercept: float = 0.0


def lowered(text: str) -> tuple[str, bool]:
    """Lower case, and whether offsets are still those of the text."""
    low = text.lower()
    return low, len(low) == len(text)


def events(text: str, words: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """Number of tokens, places of the known words and their numbers."""
    tokens = TOKEN.findall(text.lower())
    found = [(i, k) for i, k in enumerate(map(words.get, tokens)) if k is not None]
    return len(tokens), [i for i, _ in found], [k for _, k in found]


def neighbours(text: str, places: list[int]) -> list[int]:
    """A number for the pair of tokens around each place."""
    if not places:
        return []
    tokens = ["", *TOKEN.findall(text.lower()), ""]
    return [zlib.crc32(f"{tokens[i]} {tokens[i + 2]}".encode()) for i in places]


class Chain:
    """Candidate events of many texts by depth: the j-th gap and word of every text that has one, texts sorted by events."""

    def __init__(self, lengths: list[int], places: list[list[int]], words: list[list[int]]) -> None:
        self.n = len(lengths)
        self.count = np.fromiter(map(len, places), np.int64, self.n)
        self.order = np.argsort(-self.count, kind="stable")
        sizes = self.count[self.order]
        self.depth = int(sizes[0]) if self.n else 0
        self.live = [int(np.searchsorted(-sizes, -j, side="left")) for j in range(self.depth + 1)]  # texts with more than j events
        gap: list[list[int]] = [[] for _ in range(self.depth + 1)]
        word: list[list[int]] = [[] for _ in range(self.depth)]
        for d in self.order.tolist():
            before = -1
            for j, (p, w) in enumerate(zip(places[d], words[d], strict=True)):
                gap[j].append(p - before - 1)
                word[j].append(w)
                before = p
            gap[len(places[d])].append(lengths[d] - before - 1)
        # a text's last gap belongs behind those of texts with more events, which the sorting gives
        self.gap = [np.array(g, float) for g in gap]
        self.word = [np.array(w, np.int64) for w in word]

    def forward(self, field: Field, backward: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log partition per text (sorted order) and, if asked, the marginals of T by depth."""
        run = _Run(field)
        a = np.zeros((self.n, 2))
        a[:, 0] = 1.0
        log_z = np.zeros(self.n)
        kept = []
        into_o, into_t = run.moves
        for j in range(self.depth + 1):
            m = len(self.gap[j])
            a[:m] = run.cross(a[:m], self.gap[j])
            log_z[:m] += self.gap[j] * run.log_top
            m = self.live[j] if j < self.depth else 0
            if not m:
                continue
            u = np.exp(field.weights[self.word[j]])
            at = a[:m]
            new = np.stack([at @ into_o, (at @ into_t) * u], 1)
            s = new.sum(1)
            a[:m] = new / s[:, None]
            log_z[:m] += np.log(s)
            if backward:
                kept.append(a[:m].copy())
        log_z += np.log(a.sum(1))
        if not backward:
            return log_z, []
        b = np.ones((self.n, 2))
        marginal: list[np.ndarray] = [np.zeros(0)] * self.depth
        for j in range(self.depth, -1, -1):
            if j < self.depth:
                k = self.live[j]
                joint = kept[j] * b[:k]
                marginal[j] = joint[:, 1] / joint.sum(1)
                u = np.exp(field.weights[self.word[j]])
                back = np.outer(b[:k, 0], into_o) + np.outer(b[:k, 1] * u, into_t)
                b[:k] = back / back.sum(1, keepdims=True)
            m = len(self.gap[j])
            b[:m] = run.cross_back(b[:m], self.gap[j])
            b[:m] /= b[:m].sum(1, keepdims=True)
        return log_z, marginal


class _Run:
    """Powers of the transfer matrix of other words, by its two eigenvalues and scaled by the larger."""

    def __init__(self, field: Field) -> None:
        ot, to, tt = (math.exp(x) for x in field.moves)
        o = math.exp(field.other)
        m = np.array([[1.0, ot * o], [to, tt * o]])
        self.moves = np.array([1.0, to]), np.array([ot, tt])
        mean, half = (m[0, 0] + m[1, 1]) / 2, math.sqrt(((m[0, 0] - m[1, 1]) / 2) ** 2 + m[0, 1] * m[1, 0])
        top, low = mean + half, mean - half
        self.log_top, self.ratio = math.log(top), low / top
        self.first, self.second = (m - low * np.eye(2)) / (top - low), (top * np.eye(2) - m) / (top - low)

    def _power(self, gap: np.ndarray) -> np.ndarray:
        return np.where(gap > 0, np.sign(self.ratio) ** gap * np.abs(self.ratio) ** gap, 1.0)[:, None]

    def cross(self, a: np.ndarray, gap: np.ndarray) -> np.ndarray:
        return np.maximum(a @ self.first + self._power(gap) * (a @ self.second), 0.0)

    def cross_back(self, b: np.ndarray, gap: np.ndarray) -> np.ndarray:
        return np.maximum(b @ self.first.T + self._power(gap) * (b @ self.second.T), 0.0)


def document_odds(marginals: list[np.ndarray]) -> np.ndarray:
    """Log odds that any candidate word is T (noisy-or), kept finite."""
    log_none = np.array([np.log1p(-np.clip(m, 0, 1 - 1e-12)).sum() if len(m) else 0.0 for m in marginals])
    p = np.clip(-np.expm1(log_none), FLOOR, 1 - FLOOR)
    return np.log(p / (1 - p))


def marginals_of(field: Field, found: list[tuple[int, list[int], list[int]]]) -> list[np.ndarray]:
    """Marginals of T per text at its candidate words, in the order of ``found``."""
    out: list[np.ndarray] = [np.zeros(0)] * len(found)
    some = [i for i, (_, p, _) in enumerate(found) if p]
    for at in range(0, len(some), 4096):
        part = some[at : at + 4096]
        chain = Chain([found[i][0] for i in part], [found[i][1] for i in part], [found[i][2] for i in part])
        _, marginal = chain.forward(field, backward=True)
        for row, d in enumerate(chain.order.tolist()):
            out[part[d]] = np.array([m[row] for m in marginal[: chain.count[d]]])
    return out


def train(rows: list[tuple[int, int, list[int], list[int]]], words: dict[str, int], lexicon: set[int]) -> Field:
    """Weights of highest likelihood, with a ridge, for rows (toxic, tokens, places, word numbers)."""
    if not rows:
        return Field(words, np.zeros(len(words)), -8.0, (0.0, 0.0, 0.0), 1.0, 0.0)
    chain = Chain([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
    if not chain.depth:
        return calibrated(Field(words, np.zeros(len(words)), -8.0, (0.0, 0.0, 0.0)), rows)
    is_lexicon = np.zeros(len(words) + 1, bool)
    is_lexicon[list(lexicon)] = True
    toxic = np.array([r[0] for r in rows])[chain.order] == 1
    tags = [is_lexicon[w] & toxic[: len(w)] for w in chain.word]
    used = np.concatenate(chain.word)
    seen = np.bincount(used, weights=np.concatenate(tags), minlength=len(words))
    together = sum(float((tags[j] & tags[j - 1][: len(tags[j])] & (chain.gap[j][: len(tags[j])] == 0)).sum()) for j in range(1, chain.depth))
    # a T goes back to O unless it is the last token or another T follows
    at_end = sum(float((t[m:] & (chain.gap[j + 1][m : len(t)] == 0)).sum()) for j, t in enumerate(tags) for m in [chain.live[j + 1]])
    all_t = float(sum(t.sum() for t in tags))
    globals_seen = np.array([0.0, all_t - together, all_t - at_end - together, together])  # other-word T, O-T, T-O, T-T

    weights, whole = np.full(len(words), -2.0), np.array([-6.0, -1.0, 0.0, 0.0])
    state = [np.zeros(len(words) + 4), np.zeros(len(words) + 4)]
    for step in range(1, STEPS + 1):
        field = Field(words, weights, whole[0], tuple(whole[1:]))
        log_z, marginal = chain.forward(field, backward=True)
        expected = np.bincount(used, weights=np.concatenate(marginal), minlength=len(words))
        slope, eps = np.zeros(4), 1e-4
        for g in range(4):  # the four shared weights: derivative of the total log partition
            near = whole.copy()
            near[g] += eps
            slope[g] = (chain.forward(Field(words, weights, near[0], tuple(near[1:])))[0].sum() - log_z.sum()) / eps
        grad = np.concatenate([seen - expected - RIDGE * chain.n / 100 * weights / 10, globals_seen - slope - RIDGE * whole]) / math.sqrt(chain.n)
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-6)
        weights, whole = np.clip(weights + move[:-4], -12, 12), np.clip(whole + move[-4:], -14, 6)
    return calibrated(Field(words, weights, float(whole[0]), tuple(whole[1:])), rows)


def calibrated(field: Field, rows: list[tuple[int, int, list[int], list[int]]]) -> Field:
    """Slope and intercept of a logistic curve from the documents' odds to their labels (Newton steps)."""
    x = document_odds(marginals_of(field, [r[1:] for r in rows]))
    y = np.array([r[0] for r in rows], float)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * x).sum() - 1e-3 * (a - 1), (y - p).sum() - 1e-3 * b])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -2, 2))
    return Field(field.words, field.weights, field.other, field.moves, max(a, 1e-3), b)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        tox, clean = Counter(), Counter()
        for text, label in zip(pdf["text"], pdf["__label"], strict=True):
            (tox if label else clean).update(set(TOKEN.findall(text.lower())))
        words = list(tox.keys() | clean.keys())
        yield pd.DataFrame({"word": words, "tox": [tox[w] for w in words], "clean": [clean[w] for w in words]})


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", where: Column | None = None, bound: int = SAMPLE_ROWS) -> Field:
    """Learn a field from at most ``bound`` labelled documents; ``where`` restricts the rows of ``labels``.

    Equal texts count once.  Without labelled texts the field has no words and every score is one half or less.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    sample = labelled_sample(slim, labels, "toxic", bound, where=where)
    texts = cut_lineage(sample.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("__label").alias("__label")).select("text", "__label"))
    counts = texts.mapInPandas(_count_words, "word string, tox long, clean long").groupBy("word").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
    counts = cut_lineage(counts)
    sizes = {r["__label"]: r["count"] for r in texts.groupBy("__label").count().collect()}
    n_tox, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    share, tested = n_tox / max(1, n_tox + n_clean), counts.count()
    odds = ((F.col("tox") + 0.5) / (n_tox + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    best = counts.where((F.col("tox") >= MIN_TEXTS) & (odds >= MIN_ODDS) & beats_chance(F.col("tox"), F.col("clean"), share, tested))
    best = best.orderBy("word").collect()  # words of the bounded sample that occur more often in toxic texts than chance allows
    words = {r.word: i for i, r in enumerate(best)}

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [events(t, words) for t in pdf["text"]]
            yield pd.DataFrame({
                "toxic": pdf["__label"].to_numpy(), "n": [f[0] for f in found], "places": [f[1] for f in found], "numbers": [f[2] for f in found],
                "contexts": [neighbours(t, f[1]) for t, f in zip(pdf["text"], found, strict=True)],
            })

    located = texts.mapInPandas(locate, "toxic int, n long, places array<int>, numbers array<int>, contexts array<long>")
    rows = sorted((r.toxic, r.n, list(r.places), list(r.numbers), list(r.contexts)) for r in located.collect())  # at most ``bound`` texts
    toxic_words = lexicon(rows, [(r.tox, r.clean) for r in best], share, tested)
    return train([r[:4] for r in rows], words, toxic_words)


def beats_chance(tox: Column, clean: Column, share: float, tested: int) -> Column:
    """The test of ``lexicon`` on raw counts.  Counting toxic texts by neighbours only lowers them, so no word is lost here."""
    if not 0 < share < 1:
        return F.lit(False)
    fit = tox / (tox + clean)
    ratio = tox * F.log(fit / share) + F.when(clean > 0, clean * F.log((1 - fit) / (1 - share))).otherwise(0.0)
    return (fit > share) & (ratio >= math.log(max(tested, 1)) + MARGIN)


def lexicon(rows: list[tuple], counts: list[tuple[int, int]], share: float, tested: int) -> set[int]:
    """Words whose tokens count as toxic in toxic texts.

    The evidence of a word is the log likelihood ratio of its toxic and clean texts against the share of toxic
    texts; it must beat chance over all ``tested`` words.  Toxic texts count by distinct neighbours of the
    word's first place, so near copies of one toxic text do not make its other words toxic.
    """
    around: dict[int, set[int]] = {}
    for toxic, _, _, numbers, contexts in rows:
        if toxic:
            for k, c in dict(zip(reversed(numbers), reversed(contexts), strict=True)).items():  # the first place in each text
                around.setdefault(k, set()).add(c)
    chosen = set()
    for k, (tox, clean) in enumerate(counts):
        tox = min(tox, len(around.get(k, ())))
        if tox >= MIN_TEXTS and tox > share * (tox + clean):
            fit = tox / (tox + clean)
            ratio = tox * math.log(fit / share) + (clean * math.log((1 - fit) / (1 - share)) if clean else 0.0)
            if ratio >= math.log(max(tested, 1)) + MARGIN:
                chosen.add(k)
    return chosen


def toxicity(field: Field):
    """A column function: text to struct of score and spans (start, end and probability of each toxic run)."""

    def score_chunk(texts: list[str]) -> pd.DataFrame:
        found = [events(t, field.words) for t in texts]
        marginals = marginals_of(field, found)
        odds = field.slope * document_odds(marginals) + field.intercept
        score = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        spans = [spans_of(t, f[1], m) if len(m) and m.max() >= 0.5 else [] for t, f, m in zip(texts, found, marginals, strict=True)]
        return pd.DataFrame({"score": score, "spans": spans})

    def score_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts, chunk, size = [], [], 0
            for t in texts:
                chunk.append(t or "")
                size += len(chunk[-1])
                if size >= CHUNK_CHARS:
                    parts.append(score_chunk(chunk))
                    chunk, size = [], 0
            if chunk or not parts:
                parts.append(score_chunk(chunk))
            yield pd.concat(parts, ignore_index=True)

    return pandas_udf(score_texts, SCHEMA)


def spans_of(text: str, places: list[int], marginal: np.ndarray) -> list[dict]:
    """Runs of neighbouring T tokens as offsets into the text."""
    low, same = lowered(text)
    tokens = [m.span() for m in TOKEN.finditer(text if same else low)]
    out: list[dict] = []
    before = -2
    for i, p in zip(places, marginal.tolist(), strict=True):
        if p < 0.5:
            continue
        start, end = tokens[i]
        if i == before + 1:
            out[-1]["end"], out[-1]["probability"] = end, max(p, out[-1]["probability"])
        else:
            out.append({"start": start, "end": end, "probability": p})
        before = i
    return out


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of the id as text leaves remainder 0 by 5; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans.

    Null and empty texts get the score of a text without candidate words.  Rows are independent, repeated rows
    are scored alike; other columns are dropped.  Offsets are of the text, or of its lower case where that
    is longer.
    """
    bound_batches(docs.sparkSession)
    scored = docs.select(F.col(doc_id).alias("doc_id"), toxicity(field)(text_of(text)).alias("__t"))
    score = F.col("__t.score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("__t.spans").alias("spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that score below one half, with their columns; learned from rows that are not held out.

    Null and empty texts score as texts without candidate words; repeated rows stay or go together; an empty table stays
    empty.
    """
    bound_batches(docs.sparkSession)
    field = fit_toxicity(docs, labels, where=~held_out(F.col("doc_id")))
    return docs.where(toxicity(field)(text_of("text"))["score"] < 0.5)
