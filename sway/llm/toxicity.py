"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over the texts of all documents. Tokens that
may hide a word (leetspeak, symbols inside, spaced letters, repeated letters) are
read as a lattice: each character may stand for itself, for the letters it
imitates, for nothing, or, between spaced letters, for a space. Viterbi decoding
finds the reading that channel and character model like best; words that hide
nothing have one reading and are taken as they are. A word with a letter twice in a
row counts both as it is and as decoded; so do the parts of a token, which may be
words without white space between them.

The restored words are scored by features, the word and its beginnings, whose
weights are learned from a bounded sample of labelled documents: one half finds
the features that go with the label, the other fits how a document's strongest
weights turn into a probability. Everything else runs over all documents."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.llm.common import byte_texts, hashed_unit, saved, shared, unshared

#: classes of the character model: a-z, any other letter, no letter
OTHER, EDGE, CLASSES = 26, 27, 28
#: what a character may stand for, besides itself if it is a letter
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
            "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
#: log-probabilities of the channel
AS_READ, DROPPED, DROPPED_READABLE, REPEATED, SPACE_KEPT, SPACE_DROPPED = -1.0, -1.0, -9.0, -1.0, -3.0, -0.3
SPACED = re.compile(r"(?<!\S)(?:\S(?:\s++|[.\-_*])){2,}\S(?!\S)")
TWICE, THRICE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
LETTERS = re.compile(r"[^\W\d_]+")
#: what the parts of a token consist of
PART = re.compile(r"[a-z0-9@$!|+(€£]+")
ENDING = re.compile(r"""[.,;:?"')\]}*#%&!-]+$|([$@!+*#%&])\1+$""")
BEGINNING = re.compile(r"""^[.,;:?"'(\[{*#%&-]+""")


def class_counts(texts):
    """Counts of the class trigrams of texts in UTF-8, case folded."""
    import numpy as np

    table = np.full(256, EDGE, np.uint8)
    for i in range(26):
        table[65 + i] = table[97 + i] = i
    table[0xC0:] = OTHER
    table[0x80:0xC0] = 255  # the rest of a character
    counts = np.zeros(CLASSES ** 3, np.int64)
    for text in texts:
        codes = table[np.frombuffer(b" " + text + b" ", np.uint8)]
        codes = codes[codes != 255]
        codes = codes[np.concatenate([[True], (codes[1:] != EDGE) | (codes[:-1] != EDGE)])].astype(np.int64)
        if len(codes) > 2:
            counts += np.bincount(codes[:-2] * CLASSES ** 2 + codes[1:-1] * CLASSES + codes[2:], minlength=len(counts))
    return counts


def character_model(docs: DataFrame, text: str = "text") -> list[float]:
    """Log-probabilities of a class after two others, from all of ``docs``: each
    task counts what it reads, the sums have ``CLASSES`` ** 3 rows at most."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = np.zeros(CLASSES ** 3, np.int64)
        for batch in batches:
            total += class_counts(t for t in byte_texts(batch.column(0)) if t)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    counts = np.full(CLASSES ** 3, 0.1)
    for r in docs.select(text).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r.at] += r.n
    counts = counts.reshape(CLASSES ** 2, CLASSES)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).reshape(-1).tolist()


def class_of(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else OTHER if c.isalpha() else EDGE


def decode(token: str, model: list[float], spaced: bool = False) -> str:
    """The likeliest reading of a lower-case token."""
    best = {(EDGE, EDGE): (0.0, None)}  # last two classes: score, reading as linked characters
    before = ""
    for c in token:
        if spaced and c in " .-_*":
            options = [("", SPACE_DROPPED), (" ", SPACE_KEPT)]
        else:
            options = [(r, AS_READ) for r in READINGS.get(c, "")]
            options += [(c, 0.0)] if c.isalpha() else [("", DROPPED_READABLE if options else DROPPED)]
            if c == before:
                options.append(("", REPEATED))
        if c != " ":
            before = c
        after = {}
        for (a, b), (score, read) in best.items():
            for out, cost in options:
                if not out or out == " " and b == EDGE:
                    key, new = (a, b), (score + cost, read)
                else:
                    k = class_of(out)
                    key, new = (b, k), (score + cost + model[(a * CLASSES + b) * CLASSES + k], (read, out))
                if key not in after or after[key][0] < new[0]:
                    after[key] = new
        best = after
    _, read = max(((s + (0.0 if b == EDGE else model[(a * CLASSES + b) * CLASSES + EDGE]), r)
                   for (a, b), (s, r) in best.items()), key=lambda x: x[0])
    out = []
    while read:
        read, c = read
        out.append(c)
    return "".join(reversed(out))


def restored(token: str, model: list[float]) -> tuple[str, ...]:
    """The words that a lower-case token without white space stands for."""
    bare = BEGINNING.sub("", ENDING.sub("", token))
    if bare.isalpha() and not TWICE.search(bare):
        return (bare,)
    words = LETTERS.findall(decode(bare, model))
    if bare.isalpha() and not THRICE.search(bare):
        words.append(bare)
    # what hides a word may split it into short runs of letters: longer ones are words too,
    # and what stands between other signs is read by itself
    if not bare.isalpha():
        words += [w for w in LETTERS.findall(bare) if len(w) > 3]
        for part in set(PART.findall(bare)) - {bare}:
            if len(part) > 2:
                words += [part] if part.isalpha() and not TWICE.search(part) else LETTERS.findall(decode(part, model))
    return tuple(dict.fromkeys(words))


def spaced_words(text: str, model: list[float]):
    """The words of the runs of spaced letters of a lower-case text."""
    for run in SPACED.findall(text):
        yield from decode(" ".join(run.split()), model, spaced=True).split()


def words_of(text: str, model: list[float], known: dict) -> set[str]:
    """The distinct restored words of a text. ``known`` remembers tokens."""
    text = text.lower()
    out = set(spaced_words(text, model))
    for token in set(text.split()):
        words = known.get(token)
        if words is None:
            if len(known) > 500_000:  # it is refilled, so results don't depend on it
                known.clear()
            words = known[token] = restored(token, model)
        out.update(words)
    return out


def features(word: str) -> list[str]:
    """The word and its beginnings of three characters or more."""
    return [f"={word}", *(word[:n] for n in range(3, min(len(word), 8) + 1))]


@dataclass
class Scorer:
    model: list
    weights: dict = field(default_factory=dict)
    line: list = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])

    def strength(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)))

    def evidence(self, text: str | None, known: dict) -> list[float]:
        """1, the two largest weights of the words, and the log of their number.
        ``known`` remembers for each token its words that have a weight."""
        found = {}
        if text:
            text = text.lower()
            found.update((w, s) for w in spaced_words(text, self.model) if (s := self.strength(w)) > 0)
            for token in set(text.split()):
                hits = known.get(token)
                if hits is None:
                    if len(known) > 500_000:  # it is refilled, so results don't depend on it
                        known.clear()
                    hits = known[token] = tuple((w, s) for w in restored(token, self.model) if (s := self.strength(w)) > 0)
                if hits:
                    found.update(hits)
        top = sorted(found.values(), reverse=True)
        return [1.0, *(top + [0.0, 0.0])[:2], math.log1p(len(top))]

    def score(self, evidence: list[float]) -> float:
        x = sum(a * b for a, b in zip(self.line, evidence))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def fit_line(rows, answers, shares, rounds: int = 30, ridge: float = 1.0):
    """Weighted logistic regression by Newton's method."""
    import numpy as np

    x, y, s = np.array(rows, float), np.array(answers, float), np.array(shares, float)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (s * p * (1 - p))[:, None]).T @ x + penalty
        w -= np.linalg.solve(h, x.T @ (s * (p - y)) + penalty @ w)
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, every: DataFrame, sample: int = 6000, most: int = 4096, least: float = 18.0,
          key: str = "doc_id", text: str = "text", label: str = "toxic", broadcast_rows: int = 5_000_000) -> Scorer:
    """Learn from the rows of ``docs`` that ``labels`` marks, at most ``sample`` of
    them, half of each label, chosen by a hash. ``every`` is what the character model
    is counted over. ``most`` features are kept, those whose log-likelihood ratio is
    ``least`` or more. A document with several labels is toxic if one says so;
    rows with the same key and text count once, so copies crowd nothing out; without
    documents of both labels all scores are the share of toxic ones."""
    marks = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
             .groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic")))
    # 16 bytes a label; beyond the bound the join shuffles
    marks = F.broadcast(marks) if marks.count() <= broadcast_rows else marks
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(marks, "key")
    scorer = Scorer(character_model(every, text))
    place = hashed_unit(F.col("key"), F.col("text"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count_distinct(place).alias("n")).collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        scorer.line[0] = math.log((share + 1e-6) / (1 - share + 1e-6))
        return scorer
    rate = {k: min(1.0, sample / 2 / n) for k, n in sizes.items()}
    part = hashed_unit(F.lit("half"), F.col("key"), F.col("text")) < 0.5
    # the smallest hashes, wherever their rows lie; bounded, so read from one table from here on
    chosen = (known.where(place < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
              .select("text", "toxic", part.alias("first"), place.alias("place"))
              .dropDuplicates(["place"]).orderBy("place").limit(2 * sample))
    chosen = saved(chosen.drop("place"), "sample")
    model = scorer.model

    def spread(batches):
        import pyarrow as pa

        seen = {}
        for batch in batches:
            names, toxic = [], []
            for t, y, first in zip(*(c.to_pylist() for c in batch.columns)):
                if first and t:
                    mine = {f for w in words_of(t, model, seen) for f in features(w)}
                    names += mine
                    toxic += [y] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32())], names=["f", "toxic"])

    halves = {(r.first, r.toxic): r["count"] for r in chosen.groupBy("first", "toxic").count().collect()}
    n1, n0 = halves.get((True, 1), 0), halves.get((True, 0), 0)
    counts = chosen.mapInArrow(spread, "f string, toxic int").groupBy("f").agg(
        F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    a, b, n = F.col("a"), F.col("b"), F.lit(float(max(1, n1 + n0)))
    log_part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = 2 * (log_part(a, (a + b) * n1 / n) + log_part(b, (a + b) * n0 / n))
    top = (counts.where((a * n0 > b * n1) & (a + b > 2)).withColumn("g", g).where(F.col("g") >= least)
           .orderBy(F.desc("g"), "f").limit(most).collect())
    for r in top:
        scorer.weights[r.f] = math.log((r.a + 0.5) / (n1 - r.a + 0.5)) - math.log((r.b + 0.5) / (n0 - r.b + 0.5))
    unchanged = Scorer(model, scorer.weights)

    def weigh(batches):
        import pyarrow as pa

        seen = {}
        for batch in batches:
            rows = [(unchanged.evidence(t, seen), y) for t, y, first in zip(*(c.to_pylist() for c in batch.columns))
                    if not first]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())),
                                              pa.array([r[1] for r in rows], pa.int32())], names=["x", "toxic"])

    rows = sorted(((list(r.x), r.toxic) for r in chosen.mapInArrow(weigh, "x array<double>, toxic int").collect()))
    if rows:
        scorer.line = fit_line([r[0] for r in rows], [r[1] for r in rows], [1 / rate[r[1]] for r in rows])
    return scorer


def score(docs: DataFrame, scorer: Scorer, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` without ``text``, with ``name``: the probability of the label, which
    replaces a column of this name. Null, empty and wordless texts score as a text
    without evidence; equal texts score alike; whole texts are read."""
    rest = [c for c in docs.columns if c not in (text, name)]
    schema = docs.select(*rest).withColumn(name, F.lit(0.0)).schema
    model = shared(docs.sparkSession, scorer)  # the character model and the features: bounded

    def run(batches):
        import pyarrow as pa

        mine, seen = unshared(model), {}
        for batch in batches:
            texts = (t.decode() if t else t for t in byte_texts(batch.column(len(rest))))
            scores = [mine.score(mine.evidence(t, seen)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*rest, text).mapInArrow(run, schema)
