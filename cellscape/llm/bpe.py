"""Byte-level BPE by speculation and verification.

Greedy longest match proposes the tokens of each word.  A token sequence is the exact BPE result if every
token is its own BPE result and every adjacent pair stays apart when its bytes are merged by rank.
Pairs are checked for all words of a batch at once against a table of known pairs; an unknown pair is
decided once by exact merging of its few bytes.  Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from cellscape.llm.common import bound_batches

#: Fixed pattern that splits a text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept between batches, and the characters of text encoded together.
CACHED_WORDS = 100_000
CHUNK_CHARS = 700_000
#: Pairs of tokens whose check is remembered; beyond them a worker starts afresh.
CACHED_PAIRS = 2_000_000
#: Words of more bytes are merged with a heap.
LONG_WORD = 64
NO_MERGE = 1 << 62


def byte_letters() -> dict[str, int]:
    """Letter to byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class PairBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = raw(token) if all(c in letters for c in token) else token.encode()
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(PATTERN)
        # a mergeable pair of ids (left << 32 | right) to rank << 32 | merged id; the byte tokens start every word
        self.rank = {}
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank[self.ids[left] << 32 | self.ids[right]] = r << 32 | self.ids[left + right]
        self.byte_ids = [self.ids.get(bytes([b])) for b in range(256)]
        self.stable = {t: i for t, i in self.ids.items() if self.merge(t) == [i]}
        codes = sorted(self.rank.items())
        self.merge_codes = np.array([c for c, _ in codes], np.int64)
        self.merge_values = np.array([v for _, v in codes], np.int64)
        self.byte_table = np.array([-1 if i is None else i for i in self.byte_ids], np.int64)
        sizes: dict[bytes, set[int]] = {}
        for t in self.stable:
            sizes.setdefault(t[:3], set()).add(len(t))
        self.sizes = {p: sorted(n, reverse=True) for p, n in sizes.items()}
        self.pairs = np.empty(0, np.int64)
        self.fits = np.empty(0, bool)
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals."""
        return self.merge_ids([self.byte_ids[b] for b in word])

    def merge_ids(self, part: list[int]) -> list[int]:
        if len(part) > LONG_WORD:
            return self._merge_long(part)
        rank, none = self.rank, NO_MERGE
        ranks = [rank.get(a << 32 | b, none) for a, b in zip(part, part[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            part[i : i + 2] = [best & 0xFFFFFFFF]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(part[i] << 32 | part[i + 1], none)
            if i:
                ranks[i - 1] = rank.get(part[i - 1] << 32 | part[i], none)
        return part

    def _merge_long(self, part: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, for words of any length."""
        n, rank = len(part), self.rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r >> 32, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or part[i] != a or part[j] != b:
                continue
            part[i], alive[j], after[i] = rank[a << 32 | b] & 0xFFFFFFFF, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get(part[i] << 32 | part[after[i]])) is not None:
                    heapq.heappush(heap, (r >> 32, i, part[i], part[after[i]]))
            h = before[i]
            if h >= 0 and (r := rank.get(part[h] << 32 | part[i])) is not None:
                heapq.heappush(heap, (r >> 32, h, part[h], part[i]))
        return [part[i] for i in range(n) if alive[i]]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words at once, one merge of every word per round; long words go one by one."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            longest = len(words[order[at]])
            if longest > LONG_WORD:
                out[order[at]] = self.merge(words[order[at]])
                at += 1
                continue
            stop = at
            while stop < len(order) and stop < at + 20_000 and len(words[order[stop]]) <= min(longest + 3, LONG_WORD):
                stop += 1
            own = order[at:stop]
            for k, tokens in zip(own, self._merge_rows([words[k] for k in own]), strict=True):
                out[k] = tokens
            at = stop
        return out

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = left << 32 | right
        at = np.minimum(np.searchsorted(self.merge_codes, codes), len(self.merge_codes) - 1)
        return np.where(self.merge_codes[at] == codes, self.merge_values[at], NO_MERGE)

    def _merge_rows(self, words: list[bytes]) -> list[list[int]]:
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        part = np.full((n, width + 1), -1)
        part[:, :-1][np.arange(width) < sizes[:, None]] = self.byte_table[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        ranks = np.full((n, width + 1), NO_MERGE)
        some = part[:, 1:] >= 0
        ranks[:, :-1][some] = self._lookup(part[:, :-1][some], part[:, 1:][some])
        rows = np.arange(n)
        while len(rows):
            i = ranks[rows].argmin(1)
            best = ranks[rows, i]
            go = best != NO_MERGE
            rows, i, best = rows[go], i[go], best[go]
            j = after[rows, i]
            k = after[rows, j]
            part[rows, i] = best & 0xFFFFFFFF
            part[rows, j] = -1
            after[rows, i] = k
            ranks[rows, j] = NO_MERGE
            inside = k < sizes[rows]
            before[rows[inside], k[inside]] = i[inside]
            ranks[rows, i] = NO_MERGE
            ranks[rows[inside], i[inside]] = self._lookup(part[rows[inside], i[inside]], part[rows[inside], k[inside]])
            h = before[rows, i]
            left = h >= 0
            ranks[rows[left], h[left]] = self._lookup(part[rows[left], h[left]], part[rows[left], i[left]])
        kept = part >= 0
        flat = part[kept].tolist()
        ends = np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match over tokens that are their own BPE result."""
        stable, sizes, out, at, end = self.stable, self.sizes, [], 0, len(word)
        while at < end:
            for size in sizes.get(word[at : at + 3], ()):
                token = stable.get(word[at : at + size])
                if token is not None and at + size <= end:
                    break
            else:
                size = 2 if word[at : at + 2] in stable else 1
                token = stable.get(word[at : at + size])
            out.append(token)
            at += size
        return out

    def _check_pairs(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair (left << 32 | right) stays apart; unknown ones are decided and remembered."""
        found, back = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.pairs, found)
        new = (at == len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != found) if len(self.pairs) else np.ones(len(found), bool)
        if new.any():
            fresh = found[new]
            left, right = (fresh >> 32).tolist(), (fresh & 0xFFFFFFFF).tolist()
            merged = self.merge_many([self.bytes_of[a] + self.bytes_of[b] for a, b in zip(left, right, strict=True)])
            ok = np.fromiter((m == [a, b] for m, a, b in zip(merged, left, right, strict=True)), bool, len(fresh))
            self.pairs = np.concatenate([self.pairs, fresh])
            order = np.argsort(self.pairs)
            self.pairs, self.fits = self.pairs[order], np.concatenate([self.fits, ok])[order]
            at = np.searchsorted(self.pairs, found)
        return self.fits[at][back]

    def learn_words(self, words: list[str]) -> None:
        """Encode distinct words by proposal, pair check and, where that fails, exact merging."""
        proposals = [self.propose(w.encode("utf-8", "surrogatepass")) for w in words]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(sizes.sum()))
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), sizes)
            inside = owner[1:] == owner[:-1]
            codes = (flat[:-1] << 32 | flat[1:])[inside]
            failing = np.unique(owner[1:][inside][~self._check_pairs(codes)]).tolist() if len(codes) else []
            exact = self.merge_many([words[k].encode("utf-8", "surrogatepass") for k in failing])
            for k, tokens in zip(failing, exact, strict=True):
                proposals[k] = tokens
        self.known.update(zip(words, map(tuple, proposals), strict=True))

    def segments(self, text: str) -> list[str]:
        """Words of a text in order; a special token's text stays whole."""
        if not self.split_special or not any(s in text for s in self.special):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words.findall(text[at:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.segments(t) for t in texts]
        here = set().union(*split)
        if len(self.known) > CACHED_WORDS:  # keep what is in use
            self.known = {w: self.known[w] for w in here if w in self.known}
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        self.known.update({s: (i,) for s, i in self.special.items()})
        self.learn_words([w for w in here if w not in self.known])
        found = self.known.__getitem__
        return [np.fromiter(chain.from_iterable(map(found, s)), np.int32) for s in split]

    def decode(self, ids: list[int]) -> str:
        """Bytes of the tokens as UTF-8; broken sequences become U+FFFD as in the library."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> PairBpe:
    """One encoder per worker process and file; tasks of a worker share its words and pairs."""
    return PairBpe(path)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _encode_batches(path: str, text: str, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            names = [n for n in batch.schema.names if n != text]
            texts = [t or "" for t in batch.column(text).to_pylist()]
            done = 0
            for chunk in _chunks(texts):
                found = bpe.encode(chunk)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                part = batch.slice(done, len(chunk))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], column], [*names, ids])
                done += len(chunk)

    return run


def _decode_batches(path: str, ids: str, text: str, digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            names = batch.schema.names
            lists = batch.column(ids)
            texts, digests = [], []
            for k in range(len(lists)):
                values = lists[k].values
                own = np.zeros(0, np.int64) if values is None else values.to_numpy(zero_copy_only=False)
                texts.append(bpe.decode(own.tolist()))
                digests.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string()), pa.array(digests, pa.string())], [*names, text, digest])

    return run


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace ``text`` by ``ids array<int>``; other columns stay, but for one that is already called ``ids``.

    Null and empty texts have no ids.  Special tokens' strings in a text become their ids, as is the
    library's default.  Rows are independent: no shuffle, repeated rows are all kept, an empty table stays empty.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, ids)]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).cast("string").alias(text))
    schema = StructType([*kept]).add(ids, ArrayType(IntegerType()))
    return source.mapInArrow(_encode_batches(tokenizer, text, ids), schema)


def decode_documents(encoded: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded", digest: str = "ids_sha256") -> DataFrame:
    """Add the decoded text and the SHA-256 of the ids as little-endian unsigned 32-bit integers; null ids: empty text."""
    kept = [f for f in encoded.schema.fields if f.name not in (text, digest)]
    source = encoded.select(*[F.col(f"`{f.name}`") for f in kept])
    schema = StructType([*kept]).add(text, StringType()).add(digest, StringType())
    return source.mapInArrow(_decode_batches(tokenizer, ids, text, digest), schema)


def encode_and_decode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", digest: str = "ids_sha256") -> DataFrame:
    """``decode_documents`` of ``encode_documents`` in one pass, so that a task holds one worker and one set of tables.

    Odd inputs as in both; columns called ``ids``, ``decoded`` or ``digest`` are replaced.
    """
    bound_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (text, ids, decoded, digest)]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).cast("string").alias(text))
    encode, decode = _encode_batches(tokenizer, text, ids), _decode_batches(tokenizer, ids, decoded, digest)
    schema = StructType([*kept]).add(ids, ArrayType(IntegerType())).add(decoded, StringType()).add(digest, StringType())
    return source.mapInArrow(lambda batches: decode(encode(batches)), schema)
