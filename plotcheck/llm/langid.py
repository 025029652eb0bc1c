"""Language identification by cross-parsing: the language whose text describes a document in the fewest phrases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotcheck.llm.common import held_out, slices

#: Texts of each language that are learnt from at most, those with the least hash of their id, and the characters of
#: them together: texts that would exceed it are passed over whole (if all would, the shortest is taken).
TEXTS, CHARACTERS = 60, 32_768
#: The commonest letters of a language have a column of their transition table each; the rest are looked up.
DENSE = 64
#: Long texts are parsed in stretches of so many characters side by side, then joined as one parse.
STRETCH = 512
_AGAIN = np.int32(1 << 30)
_SPACE, _UNSEEN = 0, 1


def automaton(text: list[int]) -> tuple[list[dict[int, int]], int]:
    """Transitions of the suffix automaton of ``text``: from state 0, exactly its substrings can be read."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return to, len(text)


@dataclass
class Parser:
    """Transitions of one language's automaton. A letter's column is its own, or the last but one if it is looked up."""

    column: np.ndarray  # for each code of a letter; those that the language lacks lie in column ``width - 3``
    rare: np.ndarray  # for each code: its number among the letters looked up, or -1
    table: np.ndarray  # next state (times the width) for each state and column; with _AGAIN, a phrase ends before it
    keys: np.ndarray  # state * letters + letter of every transition on a letter looked up, sorted
    next: np.ndarray  # their next states, times the width
    first: np.ndarray  # next state (times the width) of a phrase that starts with each letter looked up
    width: int
    size: int

    def step(self, state: np.ndarray, columns: np.ndarray, rare: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(next state, does a phrase start with this letter) of parses that read one letter each."""
        to = self.table[state + columns]
        again = to >= _AGAIN
        to = to & ~_AGAIN
        if rare is not None:
            at = np.flatnonzero(rare >= 0)
            letter = rare[at]
            key = (state[at] // self.width).astype(np.int64) * len(self.first) + letter
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[place] == key
            to[at] = np.where(found, self.next[place], self.first[letter])
            again[at] = ~found
        return to, again


@dataclass
class Model:
    languages: list[str]
    points: np.ndarray  # code points of all letters in the samples, sorted
    parsers: list[Parser]

    @property
    def sizes(self) -> list[int]:
        return [p.size for p in self.parsers]


def _fold(text: str) -> str:
    return text.lower()


def _parser(codes: np.ndarray, letters: int) -> Parser:
    """The parser of one language's sample, over ``letters`` codes in all."""
    states, _ = automaton(codes.tolist())
    lone = len(states)  # after a letter that the language does not have: a phrase of its own
    counts = np.bincount(codes, minlength=letters)
    own = np.flatnonzero(counts)
    own = own[np.argsort(-counts[own], kind="stable")]
    dense, looked_up = own[:DENSE], own[DENSE:]
    width = len(dense) + 3  # lacking, looked up, and a filler that changes nothing
    lacking = len(dense)
    column = np.full(letters + 1, lacking, np.int32)
    column[dense], column[looked_up], column[letters] = np.arange(len(dense)), lacking + 1, lacking + 2
    rare = np.full(letters + 1, -1, np.int32)
    rare[looked_up] = np.arange(len(looked_up))
    start = np.full(width, _AGAIN | (lone * width), np.int32)
    first = np.zeros(max(len(looked_up), 1), np.int32)
    for c, s in states[0].items():
        if rare[c] >= 0:
            first[rare[c]] = s * width
        else:
            start[column[c]] = _AGAIN | (s * width)
    table = np.tile(start, (lone + 1, 1))
    keys, to = [], []
    for i, row in enumerate(states):
        for c, s in row.items():
            if i and rare[c] >= 0:
                keys.append(i * len(first) + int(rare[c]))
                to.append(s * width)
            elif i:
                table[i, column[c]] = s * width
    table[:, -1] = np.arange(lone + 1, dtype=np.int32) * width
    order = np.argsort(np.array(keys, np.int64))
    filler = (np.array([-1], np.int64), np.zeros(1, np.int32))
    known = (np.array(keys, np.int64)[order], np.array(to, np.int32)[order]) if keys else filler
    return Parser(column, rare, table.ravel(), *known, first, width, max(len(codes), 2))


def _codes(text: str, lookup: np.ndarray) -> np.ndarray:
    """Letters as numbers; each run of other characters is one space."""
    points = np.frombuffer(_fold(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = lookup[points]
    keep = np.r_[True, ~((codes[1:] == _SPACE) & (codes[:-1] == _SPACE))] if len(codes) else np.zeros(0, bool)
    return codes[keep]


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(points: np.ndarray) -> np.ndarray:
    """Code of every code point: 0 for what is no letter, 1 for letters of no sample."""
    key = points.tobytes()
    if key not in _LOOKUPS:
        table = np.array([_UNSEEN if chr(i).isalpha() else _SPACE for i in range(0x110000)], np.int32)
        table[points] = np.arange(2, 2 + len(points))
        _LOOKUPS.clear()
        _LOOKUPS[key] = table
    return _LOOKUPS[key]


def train(samples: dict[str, list[str]]) -> Model:
    """The model of each language's texts, in the order given."""
    languages = sorted(samples)
    joined = {k: _fold(" ".join(samples[k])) for k in languages}
    points = np.array(sorted({ord(c) for t in joined.values() for c in t if c.isalpha()}), np.uint32)
    codes = [_codes(joined[k], _lookup(points)) for k in languages]
    return Model(languages, points, [_parser(c, 2 + len(points)) for c in codes])


def phrases(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(phrases of each text by language, characters of each text). Phrases are longest matches, one after the other.

    A letter that the language's sample lacks counts as two: it stands in no place that a phrase could name.

    Every stretch is parsed as if it began a phrase. The phrase that really reaches into it goes on until a phrase of
    its own starts where one of the stretch's parse does: from there both are one. A text in which a stretch never
    meets is parsed again in one go, so that the count is that of one parse in all cases.
    """
    lookup, filler = _lookup(model.points), 2 + len(model.points)
    codes = [_codes(t, lookup) for t in texts]
    size = np.array([len(c) for c in codes])
    lanes = -(-size // STRETCH)
    owner = np.repeat(np.arange(len(texts)), lanes)
    grid = np.full((len(owner), STRETCH), filler, np.int32)
    at = 0
    for c, n in zip(codes, lanes.tolist()):  # noqa: B905
        grid[at : at + n].reshape(-1)[: len(c)] = c
        at += n
    grid = np.ascontiguousarray(grid.T)
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # stretches that go on with the one before
    for k, parser in enumerate(model.parsers):
        columns, rare = parser.column[grid], parser.rare[grid] if (parser.rare >= 0).any() else None
        rows = [r if r is not None and (r >= 0).any() else None for r in (rare if rare is not None else [None] * STRETCH)]
        starts = np.zeros(grid.shape, bool)
        state = np.zeros(len(owner), np.int32)
        for t in range(STRETCH):
            state, starts[t] = parser.step(state, columns[t], rows[t])
        starts[0] = True
        count = starts.sum(axis=0)
        live, state, apart = follows, state[follows - 1], np.zeros(len(owner), bool)
        for t in range(STRETCH):
            if not len(live):
                break
            state, own = parser.step(state, columns[t, live], None if rows[t] is None else rows[t][live])
            theirs = starts[t, live]
            met = own & theirs
            count[live] += np.where(met, 0, own.astype(np.int64) - theirs)
            live, state = live[~met], state[~met]
        apart[live] = True
        # The last stretch of a text may end before the parses meet; any other that does leaves its successor open.
        apart[-1:] = False
        apart[:-1] &= owner[1:] == owner[:-1]
        out[:, k] = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        for i in np.unique(owner[apart]).tolist():
            out[i, k] = _one_parse(codes[i], parser)
        out[:, k] += np.bincount(owner, weights=(columns == parser.width - 3).sum(axis=0), minlength=len(texts)).astype(np.int64)
    return out, size


def _one_parse(codes: np.ndarray, parser: Parser) -> int:
    columns, rare = parser.column[codes], parser.rare[codes]
    state, n = np.zeros(1, np.int32), 1
    for t in range(len(codes)):
        state, again = parser.step(state, columns[t : t + 1], rare[t : t + 1] if rare[t] >= 0 else None)
        n += int(t > 0 and again[0])
    return n


def identify(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """(language, score) of each text; ("und", 0.0) if it is null or has no letter, or no language is known.

    Phrases are weighted by the logarithm of the language's sample, as each names a place in it. The score is the share
    of the best language if each needs its bits.
    """
    known = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
    out = [("und", 0.0)] * len(texts)
    if known:
        count, size = phrases([texts[i] for i in known], model)
        bits = count * np.log2(np.array(model.sizes)) / np.maximum(size, 1)[:, None]
        best = bits.argmin(axis=1)
        gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(size, 64)[:, None] / 8
        share = 1 / np.exp2(-np.minimum(gap, 500)).sum(axis=1)
        for i, b, s in zip(known, best.tolist(), share.tolist()):  # noqa: B905
            out[i] = (model.languages[b], s)
    return out


def learn(docs: DataFrame, texts: int = TEXTS) -> Model:
    """Learn from at most ``texts`` texts of each lang that are not held out; their ids are chosen first, without text.

    Rows with a null id, text or lang are not learnt from; repeated rows count once each. Of the chosen texts those are
    taken, in order, that keep within CHARACTERS, each whole. The texts and the model that the driver holds are bounded
    for each language.
    """
    labelled = docs.select("doc_id", "lang", F.length("text").alias("size"), F.xxhash64("text").alias("hash"))
    labelled = labelled.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("size").isNotNull() & ~held_out(F.col("doc_id")))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "hash")
    chosen = labelled.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= texts)
    taken, room = {}, {}
    listed = sorted((r["lang"], r["nth"], r["size"], r["doc_id"], r["hash"]) for r in chosen.collect())
    for lang, nth, size, doc_id, text in listed:
        if size <= room.setdefault(lang, CHARACTERS):
            room[lang] -= size
            taken.setdefault(lang, {})[doc_id, text] = nth
    for lang, _, doc_id, text in sorted((lang, size, doc_id, text) for lang, _, size, doc_id, text in listed):
        taken.setdefault(lang, {(doc_id, text): 1})
    if not taken:
        return train({})
    wanted = docs.sparkSession.createDataFrame([(k, d, h, n) for k, own in taken.items() for (d, h), n in own.items()], "lang string, doc_id long, hash long, nth int")
    rows = docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    rows = rows.join(F.broadcast(wanted), ["lang", "doc_id", "hash"]).dropDuplicates(["lang", "nth"]).select("lang", "nth", "text")
    samples: dict[str, list[str]] = {}
    for r in sorted(rows.collect()):
        samples.setdefault(r["lang"], []).append(r["text"])
    return train(samples)


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``, from its whole text alone.

    A null or empty text, one without letters, and every text if no language is known, give ("und", 0.0). Ties go to
    the language that sorts first. Null and repeated ids keep a row each; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            found = identify(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found]), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def predicted_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``, learnt from its own labelled rows.

    Nulls, empty texts, ties and repeated rows as in ``languages``; without labelled rows all are ("und", 0.0).
    """
    out = languages(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
