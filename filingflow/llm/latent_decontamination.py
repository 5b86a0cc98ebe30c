"""Benchmark decontamination by latent semantic retrieval and sequence checks.

Passages are windows of ``WINDOW`` words, every ``STRIDE`` words, over whole
texts.  Their TF-IDF matrix A has the ``VOCABULARY`` terms that most passage
halves hold, ``FLOOR`` at least and ``CEILING`` of all at most, as the commonest
words tell languages apart and no more; the weights count the halves of the
whole corpus.

The randomised SVD is a Nystroem sketch: tasks add up G = A'(A O) over all
passages for a Gaussian O of ``RANK + MORE`` columns, and the driver takes the
``RANK`` leading right singular vectors from the small G and O'G.  Coordinates
are divided by the singular values, and what all items share, their language
above all, is taken from passages and items alike, as it tells none apart.
Words of the same contexts are near in that space, whether or not an item has
them.

Every passage is compared with every item there; a cosine of ``COSINE`` makes a
candidate.  Candidates are checked by longest common subsequences, bit-parallel
over all candidates of a block: of runs of twice the item's words around the
passage, one must have ``PARAPHRASE`` of the item's words in order and
``OF_ANSWER`` of its answer.  The answer is what follows the last "answer:", or
else the last sentence.  Items of fewer than ``LEAST_PARAPHRASE`` words have no
paraphrases, as a few common words would do.

A second branch, without terms or cosines, finds near copies: ``WHOLE`` of the
item's words in order in a passage with ``STRIDE * 2`` words around it.  Its
candidates are all passages that can reach it: what ``WHOLE`` lets be absent is
counted off the rarest words of the item, so many of them that ``EXTRA`` must
be there at least, or all words.

The corpus is read three times, twice for the space and once for a portion of
``PORTION`` item parts; the driver reads the benchmark portion by portion.  A
part has at most 64 words, and longer items have several, of which any may leak.

Defined results: null or empty texts and items of fewer than ``LEAST_WORDS``
words leak nothing; an item repeated in the benchmark is reported under each of
its ids, items without an id are left out; rows without a document id are left
out of the pairs; rows that share an id are reported once; other columns are
dropped.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.llm.store import Scratch
from filingflow.llm.textblocks import LOWER, blocks, prefix_hash, span_hash, word_spans

WINDOW, STRIDE = 64, 32
VOCABULARY, FLOOR, CEILING, LEAST_WORDS = 1 << 15, 3, 0.05, 5
RANK, MORE, COSINE = 32, 16, 0.6
WHOLE, PARAPHRASE, OF_ANSWER, LEAST_PARAPHRASE = 0.8, 0.6, 0.8, 10
EXTRA = 8
PORTION = 4096
#: Pairs checked at once, and in one step of a check; entries of a passages x items or groups x items matrix.
_PAIRS, _FEW, _CELLS, _TABLE = 1 << 14, 1 << 11, 1 << 21, 1 << 24

# Words are runs of ASCII letters and digits and of bytes beyond ASCII.
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bytes, text) of every word."""
    buf = LOWER[buf]
    start, end, owner = word_spans(buf, offs, _GAP)
    return span_hash(prefix_hash(buf), start, end), end - start, owner


class Part:
    def __init__(self, item_id: int, h: np.ndarray, size: np.ndarray, answer: np.ndarray):
        self.item_id, self.h, self.size, self.answer = item_id, h, size, answer


def parts_of(rows: list[tuple[int, str]]) -> list[Part]:
    out = []
    for item_id, text in rows:
        data = (text or "").encode()
        h, size, _ = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        if item_id is None or len(h) < LEAST_WORDS:
            continue
        marked = re.split(r"(?is)answer\s*:", text)
        tail = marked[-1] if len(marked) > 1 else re.split(r"[.!?\n]+\s*(?=\S)", text.strip())[-1]
        tail = tail.encode()
        n = len(words_of(np.frombuffer(tail, np.uint8), np.array([0, len(tail)]))[0])
        answer = np.arange(len(h)) >= len(h) - n
        cuts = np.linspace(0, len(h), -(-len(h) // 64) + 1).astype(int)
        out += [Part(item_id, h[a:b], size[a:b], answer[a:b]) for a, b in zip(cuts, cuts[1:])]
    return out


class Items:
    """Vocabulary, marks and bit masks of some parts."""

    def __init__(self, parts: list[Part]):
        self.vocabulary, code = np.unique(np.concatenate([p.h for p in parts]), return_inverse=True)
        self.first = np.zeros(1 << 16, bool)
        self.first[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        size = np.zeros(len(self.vocabulary), np.int64)
        size[code] = np.concatenate([p.size for p in parts])
        self.words = np.array([len(p.h) for p in parts])
        self.items = np.array([p.item_id for p in parts], np.int64)
        cuts = np.cumsum(self.words)
        codes = np.split(code, cuts[:-1])
        held = np.bincount(np.concatenate([np.unique(c) for c in codes]), minlength=len(self.vocabulary))
        # places of every word of every part, as bits: all words, and those of the answer
        bit = np.uint64(1) << np.concatenate([np.arange(len(c)) for c in codes]).astype(np.uint64)
        answer = np.concatenate([p.answer for p in parts])
        key = np.repeat(np.arange(len(parts)), self.words) * len(self.vocabulary) + code
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.mask = np.stack([np.bitwise_or.reduceat(bit[order], first), np.bitwise_or.reduceat(np.where(answer, bit, np.uint64(0))[order], first)])
        begin = cuts - self.words
        self.every = np.stack([np.bitwise_or.reduceat(bit, begin), np.bitwise_or.reduceat(np.where(answer, bit, np.uint64(0)), begin)])
        self.answers = np.bitwise_count(self.every[1]).astype(np.int64)
        self.table = None
        if len(parts) * (len(self.vocabulary) + 1) <= _TABLE:  # the same as the search for keys, at once
            self.table = np.full(len(parts) * (len(self.vocabulary) + 1), len(self.keys), np.int32)
            self.table[self.keys // len(self.vocabulary) * (len(self.vocabulary) + 1) + self.keys % len(self.vocabulary)] = np.arange(len(self.keys))
        # the items of each mark, a word that WHOLE counts, and the places it has there
        marks, self.least_marks = [], []
        for i, c in enumerate(codes):
            kinds, times = np.unique(c, return_counts=True)
            rarest = np.lexsort((kinds, -size[kinds], held[kinds]))
            absent = next(k for k in range(len(c), -1, -1) if (len(c) - k) / len(c) >= WHOLE)
            places = np.cumsum(times[rarest])
            enough = np.searchsorted(places, min(len(c), absent + EXTRA))
            marks += [(w, i, n) for w, n in zip(kinds[rarest][:enough + 1], times[rarest])]
            self.least_marks.append(places[enough] - absent)
        self.mark = np.full(len(self.vocabulary), -1)
        every_mark = np.unique([w for w, _, _ in marks])
        self.mark[every_mark] = np.arange(len(every_mark))
        self.marks, self.least_marks = len(every_mark), np.array(self.least_marks)
        marks = np.array(sorted((self.mark[w], i, n) for w, i, n in marks))
        self.marked, self.places = marks[:, 1], marks[:, 2]
        self.markers = np.bincount(marks[:, 0], minlength=self.marks)

    def near(self, group: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, item) where a group of words can hold WHOLE of an item; (group, mark) are distinct and in order."""
        first, parts, found = np.cumsum(self.markers) - self.markers, len(self.items), []
        step = max(16, _CELLS // parts)
        cuts = np.searchsorted(group, np.arange(0, group.max(initial=-1) + 1 + step, step))
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            m = mark[a:b]
            n = self.markers[m]
            pair = np.repeat(np.arange(a, b), n)
            entry = np.arange(len(pair)) + np.repeat(first[m] - np.cumsum(n) + n, n)
            key = (group[pair] - number * step) * parts + self.marked[entry]
            there = np.bincount(key, self.places[entry], step * parts).reshape(step, parts)
            g, item = np.nonzero(there >= self.least_marks)
            found.append((g + number * step, item))
        return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, int), np.zeros(0, int))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary numbers, -1 for other words."""
        return _lookup(self.vocabulary, self.first, h)

    def places_of(self, part: np.ndarray, region: np.ndarray) -> np.ndarray:
        """Columns of ``mask`` for pairs x words (-1 for none); where a word isn't in the part, the number of columns."""
        if self.table is not None:  # region -1 is the column after the vocabulary
            return self.table[(part * (len(self.vocabulary) + 1))[:, None] + np.where(region < 0, len(self.vocabulary), region)]
        key = part[:, None] * len(self.vocabulary) + region
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((region >= 0) & (self.keys[at] == key), at, len(self.keys))

    def there(self, part: np.ndarray, begin: np.ndarray, end: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The places, as bits, of each part that the vocabulary numbers known[begin:end] fill."""
        out, mask = np.zeros(len(part), np.uint64), np.append(self.mask[0], np.uint64(0))
        some = np.flatnonzero(begin < end)
        for k in range(0, len(some), _FEW):  # as many words as stay in the processor's cache
            pair = some[k:k + _FEW]
            n = end[pair] - begin[pair]
            first = np.cumsum(n) - n
            word = known[np.arange(n.sum()) + np.repeat(begin[pair] - first, n)]
            if self.table is not None:
                place = self.table[word + np.repeat(part[pair] * (len(self.vocabulary) + 1), n)]
            else:
                place = self.places_of(np.repeat(part[pair], n), word[:, None])[:, 0]
            out[pair] = np.bitwise_or.reduceat(mask[place], first)
        return out

    def common(self, kind: int, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of parts (kind 1: their answers) and regions."""
        return common_subsequences(np.append(self.mask[kind], np.uint64(0))[at], self.every[kind][part])


def common_subsequences(places: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Lengths for pairs of a sequence and a region: pairs x words, the bits where each word stands in the sequence; all its bits."""
    v = np.full(len(places), ~np.uint64(0))
    for m in places.T:
        v = (v + (v & m)) | (v & ~m)
    return np.bitwise_count(~v & every).astype(np.int64)


def _lookup(vocabulary: np.ndarray, first: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.full(len(h), -1, np.int64)
    if len(vocabulary):
        maybe = np.flatnonzero(first[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(vocabulary, h[maybe]), len(vocabulary) - 1)
        hit = vocabulary[at] == h[maybe]
        out[maybe[hit]] = at[hit]
    return out


class _Layout:
    """Words of a block of texts with their halves (STRIDE words) and passages (a half and the next)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.h, _, self.owner = words_of(buf, offs)
        self.n = np.bincount(self.owner, minlength=len(offs) - 1)
        self.first = np.cumsum(self.n) - self.n
        self.step = (np.arange(len(self.h)) - self.first[self.owner]) // STRIDE
        self.halves = -(-self.n // STRIDE)
        self.half_base = np.cumsum(self.halves) - self.halves
        self.half = self.half_base[self.owner] + self.step
        self.windows = np.maximum(self.halves - 1, np.minimum(self.n, 1))
        self.base = np.cumsum(self.windows) - self.windows
        self.total = int(self.windows.sum())
        self.text = np.repeat(np.arange(len(self.n)), self.windows)  # of each passage
        self.left = np.arange(self.total) - np.repeat(self.base - self.half_base, self.windows)  # its first half
        self.two = np.repeat(self.halves > 1, self.windows)

    def passages(self, of_halves: np.ndarray) -> np.ndarray:
        out = of_halves[self.left]
        out[self.two] += of_halves[self.left[self.two] + 1]
        return out

    def back(self, of_passages: np.ndarray) -> np.ndarray:
        """For each half, the sum over the passages it is in."""
        out = np.zeros((int(self.halves.sum()), of_passages.shape[1]), of_passages.dtype)
        out[self.left] += of_passages
        out[self.left[self.two] + 1] += of_passages[self.two]
        return out

    def half_sums(self, word: np.ndarray, rows: np.ndarray, number: np.ndarray | None = None) -> np.ndarray:
        """Sums by half of ``rows``, one for each of the words numbered ``word`` (ascending), or those that ``number`` names."""
        out = np.zeros((int(self.halves.sum()), rows.shape[1]), rows.dtype)
        if len(word):
            half = self.half[word]
            cut = np.flatnonzero(np.append(True, half[1:] != half[:-1]))
            for sums, column in zip(out.T, rows.T):  # a column at a time stays in the processor's cache
                sums[half[cut]] = np.add.reduceat(column if number is None else column[number], cut)
        return out


class Space:
    """Terms with their weights, and what each adds to a passage's coordinates."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray):
        self.vocabulary, self.idf, self.coordinates = vocabulary, idf.astype(np.float32), np.zeros((len(vocabulary), 0), np.float32)
        self.shared = np.zeros(0, np.float32)
        self.first = np.zeros(1 << 16, bool)
        self.first[(vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, terms) of the words that are terms."""
        t = _lookup(self.vocabulary, self.first, h)
        word = np.flatnonzero(t >= 0)
        return word, t[word]

    def sums(self, parts: list[Part]) -> np.ndarray:
        """Coordinates of items, not yet in place."""
        return np.array([self.coordinates[self.terms(p.h)[1]].sum(0) for p in parts], np.float32)

    def share(self, z: np.ndarray) -> None:
        """Take the mean direction of these items for what all items share."""
        self.shared = _unit(z).mean(0)

    def place(self, z: np.ndarray) -> np.ndarray:
        """Rows of length 1, without what all items share; a row of zeros stays."""
        some = z.any(1)[:, None]
        return np.where(some, _unit(_unit(z) - self.shared), 0)


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def _counts(batches):
    """(word hash, passage halves that hold it); null and the halves in all."""
    total = 0
    for batch in batches:
        for _, _, buf, offs in blocks(batch.column("text")):
            lay = _Layout(buf, offs)
            total += int(lay.halves.sum())
            order = np.argsort(lay.h, kind="stable")
            h, half = lay.h[order], lay.half[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, int)
            fresh = np.append(True, (h[1:] != h[:-1]) | (half[1:] != half[:-1]))[:len(h)]
            n = np.add.reduceat(fresh.astype(np.int64), start) if len(h) else start
            yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], ["h", "n"])


def _sketch(shipped):
    def run(batches):
        space, omega = shipped.value
        weighted = np.asfortranarray(space.idf[:, None] * omega)
        g = np.zeros(omega.shape[::-1])
        for batch in batches:
            for _, _, buf, offs in blocks(batch.column("text")):
                lay = _Layout(buf, offs)
                word, t = space.terms(lay.h)
                if not len(word):
                    continue
                y = np.asfortranarray(lay.back(lay.passages(lay.half_sums(word, weighted, t))))
                order = np.argsort(t, kind="stable")
                half, t = lay.half[word[order]], t[order]
                cut = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                for sums, column in zip(g, y.T):
                    sums[t[cut]] += space.idf[t[cut]] * np.add.reduceat(column[half], cut)
        g = g.T
        some = np.flatnonzero(g.any(1))
        if len(some):
            cuts = pa.array(np.arange(len(some) + 1) * g.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.ListArray.from_arrays(cuts, pa.array(g[some].astype(np.float32).ravel()))], ["term", "g"])
    return run


def leading(g: np.ndarray, omega: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms x rank, singular values): leading right singular vectors of A from G = A'A O."""
    core = omega.T @ g
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    ok = values > 1e-9 * max(values.max(initial=0), 1e-300)
    v, s, _ = np.linalg.svd(g @ (vectors[:, ok] / np.sqrt(values[ok])), full_matrices=False)
    ok = s > 1e-5 * s.max(initial=0)
    return v[:, ok][:, :rank], s[ok][:rank]


def fit(texts: DataFrame, scratch: Scratch) -> Space:
    """The latent space of all passages; the driver gets ``VOCABULARY`` terms and as many rows of the sketch."""
    spark = texts.sparkSession
    counts = scratch.put(texts.select("text").mapInArrow(_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "terms")
    total = counts.where("h is null").agg(F.sum("n")).first()[0] or 0
    top = counts.where(F.col("h").isNotNull() & (F.col("n") >= FLOOR) & (F.col("n") <= max(FLOOR, CEILING * total))).orderBy(F.desc("n"), "h").limit(VOCABULARY).toArrow()
    h, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    space = Space(h[order], np.log((1 + total) / (1 + n[order])) + 1e-3)
    if not len(h):
        return space
    omega = np.random.default_rng(11).normal(size=(len(h), min(RANK + MORE, len(h)))).astype(np.float32)
    sketch = texts.select("text").mapInArrow(_sketch(spark.sparkContext.broadcast((space, omega))), "term int, g array<float>")
    sums = sketch.groupBy("term").agg(F.array(*(F.sum(F.col("g")[i]) for i in range(omega.shape[1]))).alias("g")).toArrow()
    g = np.zeros(omega.shape)
    g[sums["term"].to_numpy()] = sums["g"].combine_chunks().flatten().to_numpy().reshape(-1, omega.shape[1])
    vectors, size = leading(g, omega.astype(float), RANK)
    space.coordinates = np.asfortranarray((space.idf[:, None] * vectors / size).astype(np.float32))
    return space


def _leaks(shipped):
    def run(batches):
        items, space, z_items, least = shipped.value
        for batch in batches:
            for a, _, buf, offs in blocks(batch.column("text")):
                lay = _Layout(buf, offs)
                found = _leaks_of(lay, items, space, z_items, least)
                if found:
                    passage, part, cosine, whole, answer = map(np.concatenate, zip(*found))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(a + lay.text[passage])), pa.array(items.items[part]), pa.array(cosine.astype(float)), pa.array(whole), pa.array(answer)],
                                                     ["id", "item_id", "cosine", "words_found", "answer_found"])
    return run


def _leaks_of(lay: _Layout, items: Items, space: Space, z_items: np.ndarray, least: float) -> list[tuple]:
    """(passage, part, cosine, words found, answer found) of a block's leaks."""
    word, t = space.terms(lay.h)
    z = space.place(lay.passages(lay.half_sums(word, space.coordinates, t)))
    number = items.lookup(lay.h)  # among the items' words
    start = lay.first[lay.text] + (lay.left - lay.half_base[lay.text]) * STRIDE
    end = (lay.first + lay.n)[lay.text]
    found = []
    step = max(16, _CELLS // len(items.items))
    for low in range(0, lay.total, step):
        row, part = np.nonzero(z[low:low + step] @ z_items.T >= least)
        able = items.words[part] >= LEAST_PARAPHRASE
        found += _paraphrases(row[able] + low, part[able], number, start, lay.first[lay.text], end, items)
    passage, part = _near_passages(lay, number, items)
    at = np.flatnonzero(number >= 0)  # other words match nothing
    for k in range(0, len(passage), _PAIRS):
        r, p = passage[k:k + _PAIRS], part[k:k + _PAIRS]
        lo = np.searchsorted(at, np.maximum(start[r] - STRIDE * 2, lay.first[lay.text[r]]))
        hi = np.searchsorted(at, np.minimum(start[r] + WINDOW + STRIDE * 2, end[r]))
        index = lo[:, None] + np.arange(max(1, (hi - lo).max(initial=0)))
        region = np.where(index < hi[:, None], number[at[np.minimum(index, len(at) - 1)]], -1) if len(at) else np.full(index.shape, -1)
        places = items.places_of(p, region)
        whole = items.common(0, p, places) / items.words[p]
        leak = whole >= WHOLE
        found.append((r[leak], p[leak], whole[leak], items.common(1, p[leak], places[leak]) / np.maximum(items.answers[p[leak]], 1)))
    return [(r, p, (z[r] * z_items[p]).sum(1), whole, answer) for r, p, whole, answer in found if len(r)]


def _regions(begin: np.ndarray, end: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Vocabulary numbers of the words from ``begin`` to ``end``, -1 after them."""
    index = begin[:, None] + np.arange((end - begin).max(initial=1))
    return np.where(index < end[:, None], number[np.minimum(index, len(number) - 1)], -1)


def _paraphrases(passage, part, number, start, first, end, items: Items) -> list[tuple]:
    """Candidates of which a run of twice the part's words holds enough of it in order."""
    at = np.flatnonzero(number >= 0)  # other words match nothing
    known = number[at]

    def possible(p, begin, end):  # words that are there at all bound those in order
        there = items.there(p, np.searchsorted(at, begin), np.searchsorted(at, end), known)
        answer = np.bitwise_count(there & items.every[1][p])
        return np.flatnonzero((np.bitwise_count(there) >= PARAPHRASE * items.words[p]) & (answer >= OF_ANSWER * items.answers[p]))

    out = []
    for k in range(0, len(passage), _PAIRS):
        r, p = passage[k:k + _PAIRS], part[k:k + _PAIRS]
        low, high = np.maximum(first[r], start[r] - items.words[p]), np.minimum(end[r], start[r] + WINDOW + items.words[p])
        some = possible(p, low, high)
        r, p, low, high = r[some], p[some], low[some], high[some]
        n = items.words[p]
        move = np.maximum(1, n // 2)
        runs = np.maximum(1, -(-(high - low - 2 * n) // move) + 1)
        pair = np.repeat(np.arange(len(r)), runs)
        begin = low[pair] + (np.arange(len(pair)) - np.repeat(np.cumsum(runs) - runs, runs)) * move[pair]
        end_ = np.minimum(begin + 2 * n[pair], high[pair])
        some = possible(p[pair], begin, end_)
        pair, begin, end_ = pair[some], begin[some], end_[some]
        places = items.places_of(p[pair], _regions(begin, end_, number))
        whole = items.common(0, p[pair], places) / n[pair]
        answer = items.common(1, p[pair], places) / np.maximum(items.answers[p[pair]], 1)
        leak = (whole >= PARAPHRASE) & (answer >= OF_ANSWER)
        out.append((r[pair[leak]], p[pair[leak]], whole[leak], answer[leak]))
    return out


def _near_passages(lay: _Layout, number: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(passage, part) that can hold WHOLE of the part."""
    at = np.flatnonzero(number >= 0)
    mark = items.mark[number[at]]
    m = np.flatnonzero(mark >= 0)
    own, step = lay.owner[at[m]], lay.step[at[m]]
    # two passages with the words around them are a group: steps 2 j - 2 to 2 j + 4
    groups = (lay.windows + 1) // 2
    group_base = np.cumsum(groups) - groups
    key = []
    for j in range(4):
        j = (step + 2) // 2 - j
        ok = (j >= 0) & (j < groups[own]) & (step <= 2 * j + 4)
        key.append(((group_base[own] + j) * items.marks + mark[m])[ok])
    key = np.unique(np.concatenate(key))
    group, part = items.near(key // items.marks, key % items.marks)
    doc = np.searchsorted(group_base + groups, group, "right")
    near = lay.base[doc] + 2 * (group - group_base[doc])
    second = near + 1 < (lay.base + lay.windows)[doc]
    return np.append(near, near[second] + 1), np.append(part, part[second])


def _portions(benchmark: DataFrame):
    """Parts of the benchmark, at most about PORTION at a time."""
    parts = []
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        parts += parts_of([(r.item_id, r.text)])
        if len(parts) >= PORTION:
            yield sorted(parts, key=lambda p: p.item_id)
            parts = []
    if parts:
        yield sorted(parts, key=lambda p: p.item_id)


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, cosine: float = COSINE) -> DataFrame:
    """(id, item_id, cosine, words_found, answer_found) for every document and item it leaks, of the passage with most words."""
    spark = df.sparkSession
    schema = "id long, item_id long, cosine double, words_found double, answer_found double"
    scratch, tables, space = Scratch(spark, "leaks"), [], None
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    for number, parts in enumerate(_portions(benchmark)):
        space = space or fit(texts, scratch)
        items = Items(parts)  # at most 64 words a part
        z = space.sums(parts)
        if not number:
            space.share(z)
        z = space.place(z)
        found = texts.mapInArrow(_leaks(spark.sparkContext.broadcast((items, space, z, cosine))), schema)
        tables.append(scratch.put(found, f"portion{number}"))
    if not tables:
        return spark.createDataFrame([], schema.replace("id long", f"{id_col} long", 1))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    best = every.groupBy("id", "item_id").agg(F.max(F.struct("words_found", "answer_found", "cosine")).alias("b"))
    out = scratch.put(best.select(F.col("id").alias(id_col), "item_id", "b.cosine", "b.words_found", "b.answer_found"), "out")
    scratch.drop(*(k for k in scratch.paths if k != "out"))
    return out


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it leaks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id", "text")
