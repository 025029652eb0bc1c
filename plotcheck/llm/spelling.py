"""Spelling variants: words one edit apart, found by products of letter-count blocks.

One replaced letter changes the letter counts of a word by a squared distance of 2 at most, one inserted or deleted letter by
1. So words are dealt to blocks by their length and by their counts over a few groups of letters; a pair one edit apart lies in
one block, or in two whose counts differ by one letter moved or added. Of two such blocks, one NumPy product of the letter
counts gives all squared distances, and what is near enough is verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotcheck.llm.common import partitions, random_words, slices, texts
from plotcheck.storage import materialize

#: Letters of a word: A-Z, a-z and U+00C0 to U+00FF, here in UTF-8 with A-Z in lower case.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_SPACED = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
#: Dimensions of the letter counts: code points modulo this. Letters of the runs above all differ; others may meet, which only adds pairs to verify.
LETTERS = 160
#: Words of a block that one task holds at most; the words compared with them stream by in slices.
BLOCK, SLICE = 2048, 512
#: Distinct words that a task counts before it hands the counts on.
HELD = 200_000


def found_words(text: bytes, doc_id: int | None, least: int, every: int) -> Counter:
    """Words of ``least`` letters and more with their occurrences, after one letter is deleted from the runs whose crc32 ``every`` divides."""
    text = text.lower()
    runs = Counter(text.translate(_SPACED).split() if text.isascii() else _RUN.findall(text))
    start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    out: Counter = Counter()
    for run, n in runs.items():
        if len(run) < least:  # bytes: at least as many as letters
            continue
        h = zlib.crc32(run, start)
        word = run.decode()
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            out[word] += n
    return out


def vocabulary(docs: DataFrame, least: int = 7, repeats: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of ``least`` letters and more that occur ``repeats`` times and more in all texts, with typing errors as op12 plants them.

    Null and empty texts have none; a null id reads as the empty string; rows that repeat an id count each. Counts combine in
    tasks of bounded memory before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in slices(batches, "text"):
            for text, i in zip(texts(batch.column("text")), batch.column("doc_id").to_pylist()):  # noqa: B905
                counts.update(found_words(text, i, least, every))
                if len(counts) > HELD:
                    yield hand_on()
        if counts:
            yield hand_on()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= repeats)


def _codes(words: pa.Array) -> np.ndarray:
    """Code points of words of one length, a row each."""
    data, at = words.buffers()[2], np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    text = bytes(memoryview(data)[at[0] : at[-1]]).decode() if len(words) else ""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Row by row: do they differ by exactly one replaced letter (same length), or by one more letter in ``long``?"""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    head = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


class _Homes:
    """The words of a block, all of one length, with their letter counts."""

    def __init__(self, words: pa.Array, n: np.ndarray) -> None:
        self.words, self.n, self.codes = words, n, _codes(words)
        letters = np.unique(self.codes % LETTERS)
        # Letters that no home has count together: a word with two of them is near none.
        self.column = np.full(LETTERS, len(letters))
        self.column[letters] = np.arange(len(letters))
        self.width = len(letters) + 1
        h = self.counts(self.codes)
        self.right = np.ascontiguousarray(np.hstack([h, np.ones((len(h), 1), h.dtype), (h * h).sum(axis=1, keepdims=True) / -2]).T)

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """Letter counts, a row for each word; exact as floats up to 4000 letters, else in double precision."""
        at = np.repeat(np.arange(len(codes)) * self.width, codes.shape[1]) + self.column[codes.ravel() % LETTERS]
        return np.bincount(at, minlength=len(codes) * self.width).reshape(-1, self.width).astype(np.float32 if codes.shape[1] < 4000 else np.float64)

    def near(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(guest, home) numbers of pairs one edit apart; guests are as long as the homes, or one letter shorter."""
        less = self.codes.shape[1] - codes.shape[1]
        g = self.counts(codes)
        # Two more columns each, so that the product is minus half of the squared distance.
        left = np.hstack([g, (g * g).sum(axis=1, keepdims=True) / -2, np.ones((len(g), 1), g.dtype)])
        a, b = np.divmod(np.flatnonzero(left @ self.right >= less / 2 - 1), len(self.codes))  # at most 2 apart, or 1 where a letter is missing
        step = max(1, 1_000_000 // self.codes.shape[1])
        for at in range(0, len(a), step):
            i, j = a[at : at + step], b[at : at + step]
            met = _one_edit(codes[i], self.codes[j])
            yield i[met], j[met]


#: What a word is in a block: home, guest in its own block, guest of the homes' length, guest one letter shorter.
_HOME, _OWN, _MOVED, _SHORTER = range(4)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every (block, part): rows come sorted, homes before guests. A pair within a block counts once, the smaller word first."""
    key, held, homes = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, parts, guest, n = (batch.column(c).to_numpy() for c in ("block", "part", "guest", "n"))
        words = batch.column("word").cast(pa.string())
        new = np.r_[True, (blocks[1:] != blocks[:-1]) | (parts[1:] != parts[:-1]) | (guest[1:] != guest[:-1])]
        cuts = [*np.flatnonzero(new).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            mine = (blocks[a], parts[a])
            if mine != key:
                key, held, homes = mine, [], None
            if guest[a] == _HOME:
                held.append((words.slice(a, b - a), n[a:b]))
                continue
            if homes is None and held:
                homes = _Homes(pa.concat_arrays([w for w, _ in held]), np.concatenate([k for _, k in held]))
            for at in range(a, b, SLICE) if held else ():
                visitors = words.slice(at, min(SLICE, b - at))
                for x, y in homes.near(_codes(visitors)):
                    if not len(x):
                        continue
                    one, two = visitors.take(pa.array(x)), homes.words.take(pa.array(y))
                    out = pa.RecordBatch.from_arrays([one, pa.array(n[at + x]), two, pa.array(homes.n[y])], names=["a", "n_a", "b", "n_b"])
                    yield out.filter(pc.less(one.cast(pa.binary()), two.cast(pa.binary()))) if guest[a] == _OWN else out


def _visits(batches: Iterator[pa.RecordBatch], groups: int, homes: bool) -> Iterator[pa.RecordBatch]:
    """(block, guest, word, n): each word as home of its block, and (unless ``homes``) as guest of those that its near words may lie in.

    Letters fall into groups by their code point modulo LETTERS. A block is the hash of a word's counts in these, and of nothing else.
    """
    factor = random_words(groups, seed=17)
    unit = lambda add, drop: (factor[add] if add is not None else np.uint64(0)) - (factor[drop] if drop is not None else np.uint64(0))
    # To its own block, to those with a letter moved to a later group, and to those with a letter more.
    moves = [(_OWN, np.uint64(0))] + [(_MOVED, unit(j, i)) for i in range(groups) for j in range(i + 1, groups)] + [(_SHORTER, unit(i, None)) for i in range(groups)]
    for whole in batches:
        for batch in slices(iter([whole]), "word", 1_000_000):
            words, n = batch.column("word").cast(pa.string()), batch.column("n")
            codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32) % LETTERS % groups
            size = pc.utf8_length(words).to_numpy()
            at = np.repeat(np.arange(len(size)) * groups, size) + codes
            with np.errstate(over="ignore"):
                own = (np.bincount(at, minlength=len(size) * groups).reshape(-1, groups).astype(np.uint64) * factor).sum(axis=1, dtype=np.uint64)
                for guest, by in [(_HOME, np.uint64(0))] + ([] if homes else moves):
                    yield pa.RecordBatch.from_arrays([pa.array((own + by).view(np.int64)), pa.array(np.full(len(size), guest, np.int32)), words, n], names=["block", "guest", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of ``words`` (word, n), distinct and not null, that differ by one inserted, deleted or replaced letter, once.

    The number of letter groups follows the number of words, so that blocks hold few of them; blocks of over BLOCK words are
    dealt in parts, which their guests visit all.
    """
    n = words.count()
    groups = 1
    while groups < 10 and n >> (2 * groups) > 2000:
        groups += 1
    some = words.filter("word <> ''").select("word", "n")
    visits = lambda homes: some.mapInArrow(lambda b: _visits(b, groups, homes), "block long, guest int, word string, n long")
    sizes = visits(True).groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    # Blocks without homes are left out by the join.
    part = F.when(F.col("guest") == _HOME, F.array(F.pmod(F.xxhash64("word", F.lit(5)), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = visits(False).join(sizes, "block").select("block", F.explode(part).alias("part"), "guest", "word", "n")
    dealt = dealt.repartition(partitions(words.sparkSession), "block", "part").sortWithinPartitions("block", "part", "guest")
    return dealt.mapInArrow(_compare, "a string, n_a long, b string, n_b long")


def spelling_groups(docs: DataFrame, least: int = 7, repeats: int = 2, ratio: int = 10, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary.

    form: the near word of largest n (ties: smallest in code-point order) if that n is ``ratio`` times the word's or more,
    else null; root: the last word that forms lead to. n grows by the ratio with each step, so 32 steps reach every root
    while n fits a long; they are taken in five doublings. Rows as in vocabulary; an empty table gives no rows.
    """
    words = materialize(vocabulary(docs, least, repeats, every, id_col, text_col), "words")
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    known = words.join(best, "word", "left")
    leads = -F.col("best.less") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.other")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n"))
    known = materialize(known, "forms")
    step = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(5):
        step = materialize(step.alias("x").join(step.alias("y"), F.col("x.root") == F.col("y.word"), "left").select("x.word", F.coalesce("y.root", "x.root").alias("root")), "roots", replaces=step)
    return known.join(step, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
