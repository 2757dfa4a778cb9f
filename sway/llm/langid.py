"""Language identification by a byte convolutional network.

Bytes are embedded, convolved with filters of several widths, max-pooled over a
fixed-length window and classified by a softmax layer. The network is trained in
numpy on windows of a bounded sample of labelled documents and applied to all
windows of every whole text, in batches; a document's probabilities are the mean
over its windows, weighed by their bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.llm.common import byte_texts, hashed_unit

WINDOW = 160
UNKNOWN = "und"


@dataclass
class ByteCNN:
    labels: list
    window: int = WINDOW
    embedding: int = 8
    filters: int = 16
    widths: tuple = (2, 3, 4)  # ascending
    weights: dict = field(default_factory=dict)

    def start(self, seed: int = 11) -> None:
        import numpy as np

        draw = np.random.default_rng(seed)
        normal = lambda scale, *shape: (draw.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {"embed": normal(0.5, 256, self.embedding),
                        "out": normal(0.1, len(self.widths) * self.filters, len(self.labels)),
                        "out_bias": np.zeros(len(self.labels), np.float32)}
        for k in self.widths:
            self.weights[f"w{k}"] = normal((2 / (k * self.embedding)) ** 0.5, k * self.embedding, self.filters)
            self.weights[f"b{k}"] = np.zeros(self.filters, np.float32)

    def tables(self) -> dict:
        """The filters as lookups: by width, for each offset the responses to a
        byte there, ``(256, filters)``."""
        d = self.embedding
        return {k: [self.weights["embed"] @ self.weights[f"w{k}"][j * d:(j + 1) * d] for j in range(k)]
                for k in self.widths}

    def responses(self, windows, tables, space=None):
        """The responses ``(positions, windows, filters)`` without bias,
        one width after another. ``space`` holds two arrays that are used again."""
        import numpy as np

        bytes_first = np.ascontiguousarray(windows.T)
        for k in self.widths:
            n = self.window - k + 1
            out, more = (np.empty((n, len(windows), self.filters), np.float32) if space is None
                         else x[:n, :len(windows)] for x in (space or (0, 0)))
            tables[k][0].take(bytes_first[:n], axis=0, out=out, mode="clip")
            for j in range(1, k):
                tables[k][j].take(bytes_first[j:j + n], axis=0, out=more, mode="clip")
                out += more
            yield k, out

    def hidden(self, tops):
        import numpy as np

        return np.maximum(np.concatenate([top + self.weights[f"b{k}"] for k, top in tops], axis=1), 0)

    def probabilities(self, windows):
        import numpy as np

        out, tables, many = [np.zeros((0, len(self.labels)), np.float32)], self.tables(), 64
        full = [np.empty((self.window, many, self.filters), np.float32) for _ in range(2)]
        for at in range(0, len(windows), many):
            part = windows[at:at + many]
            space = full if len(part) == many else None
            hidden = self.hidden([(k, x.max(axis=0)) for k, x in self.responses(part, tables, space)])
            logits = hidden @ self.weights["out"] + self.weights["out_bias"]
            logits = np.exp(logits - logits.max(axis=1, keepdims=True))
            out.append(logits / logits.sum(axis=1, keepdims=True))
        return np.concatenate(out)

    def step(self, windows, answers) -> dict:
        """Gradients of the mean cross entropy over a batch."""
        import numpy as np

        w, n = self.weights, len(windows)
        found = [(k, x.max(axis=0), x.argmax(axis=0)) for k, x in self.responses(windows, self.tables())]
        hidden = self.hidden([x[:2] for x in found])
        logits = hidden @ w["out"] + w["out_bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), answers] -= 1
        p /= n
        grads = {"out": hidden.T @ p, "out_bias": p.sum(axis=0), "embed": np.zeros_like(w["embed"])}
        back = (p @ w["out"].T) * (hidden > 0)
        rows = np.arange(n)[:, None]
        for i, k in enumerate(self.widths):
            mine = slice(i * self.filters, (i + 1) * self.filters)
            g, at = back[:, mine], found[i][2]
            patches = w["embed"][windows[rows[:, :, None], at[:, :, None] + np.arange(k)]].reshape(n, self.filters, -1)
            grads[f"w{k}"] = np.einsum("nfd,nf->df", patches, g)
            grads[f"b{k}"] = g.sum(axis=0)
            by_place = (g[:, :, None] * w[f"w{k}"].T[None]).reshape(n, self.filters, k, self.embedding)
            for j in range(k):
                np.add.at(grads["embed"], windows[rows, at + j], by_place[:, :, j])
        return grads

    def train(self, windows, answers, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 3) -> None:
        """Adam over shuffled batches."""
        import numpy as np

        self.start()
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        t = 0
        for _ in range(epochs):
            order = draw.permutation(len(windows))
            for at in range(0, len(order), batch):
                t += 1
                pick = order[at:at + batch]
                for k, g in self.step(windows[pick], answers[pick]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9 ** t))
                                        / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)

    def document_probabilities(self, texts):
        """For each of ``texts`` (bytes): the mean over its windows."""
        import numpy as np

        counts = np.array([max(1, -(-len(t) // self.window)) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(starts[-1] * self.window, np.uint8)
        for t, s in zip(texts, starts):
            flat[s * self.window:s * self.window + len(t)] = np.frombuffer(t, np.uint8)
        windows = flat.reshape(-1, self.window)
        weight = np.maximum((windows != 0).sum(axis=1), 1)[:, None]
        total = np.add.reduceat(self.probabilities(windows) * weight, starts[:-1])
        return total / np.add.reduceat(weight, starts[:-1])


def cut(text: str, window: int = WINDOW) -> bytes:
    return text.encode()[:window].ljust(window, b"\0")


def train(docs: DataFrame, sample: int = 2400, windows: int = 5, text: str = "text", lang: str = "lang",
          key: str = "doc_id", **options) -> ByteCNN:
    """Fit the network on at most ``sample`` labelled rows of ``docs``, spread
    evenly over the languages and chosen by a hash, ``windows`` evenly spaced
    windows of each. Null languages and texts are left out; rows with the same key,
    text and language count once, so copies crowd nothing out."""
    import numpy as np

    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    place = hashed_unit(F.col(key), F.col(text))
    sizes = {r[0]: r[1] for r in known.groupBy(lang).agg(F.count_distinct(place)).orderBy(lang).limit(sample).collect()}
    model = ByteCNN(sorted(sizes), **options)
    if not sizes:
        return model
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, sample / len(sizes) / n)])
    # many long documents' windows stay small: only the cuts reach the driver
    cuts = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring(
        F.col(text), (i * F.length(text) / windows).cast("int") + 1, F.lit(WINDOW)))
    # the smallest hashes, wherever their rows lie
    rows = (known.where(place < share[F.col(lang)])
            .select(F.col(lang).alias("lang"), F.array_distinct(cuts).alias("cuts"), F.xxhash64(key, text).alias("at"),
                    place.alias("place")).dropDuplicates(["lang", "place"])
            .orderBy("place", "lang").limit(sample).select("lang", "cuts", "at").collect())
    place = {k: i for i, k in enumerate(model.labels)}
    pairs = [(cut(c, model.window), place[r[0]]) for r in sorted(rows, key=lambda r: (r["at"], r[0])) for c in r["cuts"] if c]
    data = np.frombuffer(b"".join(p[0] for p in pairs), np.uint8).reshape(-1, model.window)
    model.train(data, np.array([p[1] for p in pairs]))
    return model


def identify(docs: DataFrame, model: ByteCNN, text: str = "text", label: str = "lang_pred",
             score: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` without ``text`` (unless it is kept), with ``label`` (most likely
    language) and ``score`` (its probability), which replace columns of these names.

    Null texts and texts without a letter, empty ones too, are ``und`` with score
    0, and so is every text if the model has no languages. Equal texts get equal
    results; ties go to the smaller label; texts of any length are read whole."""
    rest = [c for c in docs.columns if c not in (text, label, score)]
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = len(rest)
            texts = list(byte_texts(batch.column(n)))
            found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            part, size = [], 0
            for i, (t, has) in enumerate(zip(texts, batch.column(n + 1).to_pylist())):
                if has and model.labels:
                    part.append(i)
                    size += len(t)
                if part and (size > 1 << 21 or i == len(texts) - 1):
                    p = model.document_probabilities([texts[j] for j in part])
                    for j, best, top in zip(part, p.argmax(axis=1), p.max(axis=1)):
                        found[j], scores[j] = model.labels[best], min(1.0, float(top))
                    part, size = [], 0
            kept = batch.columns[:n + keep_text]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    schema = docs.select(*rest, *[text] * keep_text).withColumn(label, F.lit("")).withColumn(score, F.lit(0.0)).schema
    return docs.select(*rest, text, letters.alias("__letters")).mapInArrow(run, schema)


def held_out(key, parts: int, part: int):
    """Whether the row belongs to the fold; a null key counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == part
