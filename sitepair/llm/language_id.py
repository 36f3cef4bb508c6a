"""Operator 10, language identification by cross-parsing entropy.

Labelled text of each language gives a suffix automaton. A text is parsed against it from left to
right into the longest phrases that occur in the labelled text; a letter that doesn't occur there is a
phrase of its own. The language that needs the fewest phrases for each character wins. The automata are
built on the driver from a bounded sample; their transitions are kept sparsely, so that any number of
letters and scripts will do, and are walked many blocks of text in step.

Texts are folded to lower case and runs of other than letters become one space; a text is parsed in
blocks of ``BLOCK`` characters, all of them. Null texts and texts without a letter are ``und`` with score 0. Ties
go to the language that sorts first. The sample takes ``FIT_DOCS`` labelled documents for each language
(those of least hashed id) and ``FIT_CHARS`` characters for each language, whatever the number of languages:
about 1.3 MB of tables each. More than ``MAX_LANGS`` languages are refused. Without any labelled row every
text is ``und``. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out

FIT_DOCS = 64
FIT_CHARS = 24_000
MAX_LANGS = 500
BLOCK = 256
UNKNOWN = "und"


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the least automaton that reads every substring of ``symbols``."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


_LATIN = np.array([ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else 32 for c in range(0x250)], np.uint32)


def fold(text: str) -> np.ndarray:
    """Code points of letters in lower case, anything between them one space; empty if there is no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if points.size and points.max() < 0x250:
        out = _LATIN[points]
    else:
        low = text.lower()
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = points.copy()
        for p in np.unique(points).tolist():
            if not chr(p).isalpha():
                out[points == p] = 32
    gap = out == 32
    if gap.all():
        return np.empty(0, np.uint32)
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    return out[keep]


class Automaton:
    """Transitions as one array of slots: that of ``state`` by symbol ``c`` is in slot ``base[state] + c``, which
    holds the state it belongs to and the state it leads to. Symbol 0 leads nowhere, and no transition to state 0."""

    def __init__(self, moves: list[dict[int, int]], symbols: int):
        steps = [{c: to for c, to in m.items() if c} for m in moves]
        free = np.ones(0, bool)
        self.base = np.zeros(len(steps), np.int32)
        first, end = symbols, symbols  # no slot before the first is used, so that no base is negative; none from the end on
        for state in sorted(range(len(steps)), key=lambda s: -len(steps[s])):
            own = np.array(list(steps[state]), np.int64)
            if not len(own):
                continue
            if end + symbols + 512 > len(free):
                free = np.concatenate([free, np.ones(len(free) + symbols + 1024, bool)])
            while not free[first]:
                first += 1
            starts = first + np.flatnonzero(free[first : first + 256]) - int(own[0])
            fits = starts[free[starts[:, None] + own].all(1)]
            at = int(fits[0]) if len(fits) else end
            end = max(end, at + int(own.max()) + 1)
            self.base[state] = at
            free[at + own] = False
        self.slots = np.full(end + symbols + 1, -1, np.int64)
        for state, m in enumerate(steps):
            for c, to in m.items():
                self.slots[self.base[state] + c] = state << 32 | to
        self.root = np.zeros(symbols + 1, np.int64)
        self.root[list(steps[0])] = list(steps[0].values())

    def phrases(self, steps: np.ndarray) -> np.ndarray:
        """The number of phrases of each column of ``steps`` (columns end in -1): longest matches, from left to right."""
        state = np.zeros(steps.shape[1], np.int64)
        n = np.zeros(steps.shape[1], np.int64)
        for c in steps:
            live = c >= 0
            if not live.all():
                c = np.maximum(c, 0)
            slot = self.slots[self.base[state] + c]
            ends = (slot >> 32) != state
            n += (ends | (state == 0)) & live
            state = np.where(ends, self.root[c], slot & 0xFFFFFFFF)
        return n


class Model:
    """``points`` are the letters of all samples, numbered from 1; 0 is any other letter."""

    def __init__(self, texts: dict[str, list[str]], fit_chars: int = FIT_CHARS):
        self.langs = sorted(texts)
        folded = {}
        for lang in self.langs:
            parts, n = [], 0
            for t in sorted(map(fold, texts[lang]), key=len):
                share = max(1, (fit_chars - n) // (len(texts[lang]) - len(parts)))  # short texts leave their part to longer ones
                parts.append(t[:share])
                n += len(parts[-1])
            folded[lang] = parts
        every = [p for parts in folded.values() for p in parts]
        self.points = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint32)
        self.automata = []
        for lang in self.langs:
            symbols: list[int] = []
            for p in folded[lang]:
                symbols += [0, *self.number(p).tolist()]
            self.automata.append(Automaton(suffix_automaton(symbols), len(self.points)))

    def number(self, points: np.ndarray) -> np.ndarray:
        if not len(self.points):
            return np.zeros(len(points), np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 1, 0)

    def phrases(self, blocks: np.ndarray) -> list[np.ndarray]:
        """Phrases of each row of ``blocks`` (rows end in -1), for each language."""
        steps = np.ascontiguousarray(blocks.T)
        return [a.phrases(steps) for a in self.automata]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [self.number(fold(t)) if t else np.empty(0, np.int64) for t in texts]
        counts = [-(-len(c) // BLOCK) for c in codes]
        total = np.zeros((len(self.langs), len(texts)), np.int64)
        rows = np.full((sum(counts), BLOCK), -1, np.int32)
        owner = np.repeat(np.arange(len(texts)), counts)
        at = 0
        for c, n in zip(codes, counts, strict=True):
            rows[at : at + n].reshape(-1)[: len(c)] = c
            at += n
        for start in range(0, len(rows), 4096):
            part = slice(start, start + 4096)
            found = self.phrases(rows[part])
            for k in range(len(self.langs)):
                np.add.at(total[k], owner[part], found[k])
        langs, scores = [], []
        for i, c in enumerate(codes):
            if not len(c) or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            order = sorted(range(len(self.langs)), key=lambda k: (total[k, i], k))
            best = int(total[order[0], i])
            second = int(total[order[1], i]) if len(order) > 1 else len(c) + 1
            langs.append(self.langs[order[0]])
            scores.append(1 - best / second if second else 0.0)
        return langs, scores


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """From ``labelled(doc_id, text, lang)``: whole documents with the least hashed ids of each language."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", F.col("text").cast("string"))
    if labelled.where("lang is not null").select("lang").distinct().limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id", F.xxhash64("text"))
    # The limit on the row number is applied before the shuffle too: fit_docs rows for each language and task.
    chosen = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fit_docs)
    texts: dict[str, list[str]] = {}
    for lang, text in chosen.orderBy("lang", "n").select("lang", F.substring("text", 1, fit_chars)).collect():
        texts.setdefault(lang, []).append(text)
    return Model(texts, fit_chars)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each of ``docs``; reads ``text`` only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FIT_CHARS characters of MAX_LANGS languages at most

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                langs, scores = shared.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def learn_and_identify(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> DataFrame:
    """Learns from the documents that aren't held out and identifies all."""
    learned = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return identify(docs, fit(learned, fit_docs, fit_chars))
