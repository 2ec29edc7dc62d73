"""Language identification by a byte convolutional network.

A text is read in windows of a fixed number of bytes.  Byte vectors pass through filters of
several widths, each filter's maximum over the window is taken, and a softmax layer gives the
languages' probabilities.  Training is plain numpy on windows of labelled texts.  In use, a filter's
response is a sum of tables looked up by byte or pair of bytes, so no vectors are built; the windows
of a text are weighed by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.common import bounded_batches

WINDOW, WIDTHS, FILTERS, VECTOR = 256, (2, 3, 4), 16, 12
SAMPLE_PER_LANGUAGE, SAMPLE_WINDOWS, EPOCHS, BATCH, RATE, SEED = 600, 3, 6, 64, 0.003, 5
UNKNOWN = "und"


class Network(NamedTuple):
    """Byte vectors, per width the filters (width, vector, filter) and biases, and the last layer."""

    languages: list[str]
    vectors: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray


def as_windows(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows over the whole of each text, the last filled up with zeros; and whose each is."""
    counts = np.array([max(1, -(-len(t) // window)) for t in texts], np.int64)
    flat = b"".join(t.ljust(n * window, b"\0") for t, n in zip(texts, counts))
    return (np.frombuffer(flat, np.uint8).reshape(-1, window),
            np.repeat(np.arange(len(texts)), counts))


def _stacked(parameters: Network, windows: np.ndarray, width: int) -> np.ndarray:
    rows = parameters.vectors[windows]
    n = windows.shape[1] - width + 1
    return np.concatenate([rows[:, i:i + n] for i in range(width)], axis=2)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS,
          seed: int = SEED) -> Network:
    """Fit a network to windows with label numbers, by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    k, total = len(languages), FILTERS * len(WIDTHS)
    net = Network(languages, rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
                  [rng.normal(0, (2 / (w * VECTOR)) ** 0.5, (w, VECTOR, FILTERS)).astype(np.float32)
                   for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                  rng.normal(0, total ** -0.5, (total, k)).astype(np.float32),
                  np.zeros(k, np.float32))
    arrays = [net.vectors, *net.filters, *net.biases, net.weights, net.offset]
    first, second = ([np.zeros_like(a) for a in arrays] for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            pick = order[start:start + BATCH]
            step += 1
            for a, g, m, v in zip(arrays, _gradients(net, windows[pick], labels[pick]),
                                  first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def _gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    n, pooled, tops = len(windows), [], []
    for width, filters, bias in zip(WIDTHS, net.filters, net.biases):
        response = _stacked(net, windows, width) @ filters.reshape(-1, FILTERS) + bias
        tops.append(response.argmax(axis=1))
        pooled.append(response.max(axis=1))
    features = np.maximum(np.concatenate(pooled, axis=1), 0)
    slope = softmax(features @ net.weights + net.offset)
    slope[np.arange(n), labels] -= 1
    slope /= n
    back = (slope @ net.weights.T) * (features > 0)
    vectors, of_filters, of_biases = np.zeros_like(net.vectors), [], []
    for i, (width, filters) in enumerate(zip(WIDTHS, net.filters)):
        part = back[:, i * FILTERS:(i + 1) * FILTERS]
        grad = np.zeros_like(filters)
        for j in range(width):  # only the top place of each filter passes its slope on
            bytes_ = np.take_along_axis(windows, tops[i] + j, axis=1)
            seen = net.vectors[bytes_]
            grad[j] = np.einsum("nf,nfv->vf", part, seen)
            np.add.at(vectors, bytes_, part[:, :, None] * filters[j].T[None])
        of_filters.append(grad)
        of_biases.append(part.sum(axis=0))
    return [vectors, *of_filters, *of_biases, features.T @ slope, slope.sum(axis=0)]


def softmax(values: np.ndarray) -> np.ndarray:
    values = np.exp(values - values.max(axis=1, keepdims=True))
    return values / values.sum(axis=1, keepdims=True)


class Classifier:
    """A network with its filters turned into tables of responses by byte and pair of bytes."""

    def __init__(self, net: Network):
        self.net = net
        single = [[net.vectors @ f[j] for j in range(len(f))] for f in net.filters]
        pair = [(s[0][:, None, :] + s[1][None, :, :]).reshape(-1, FILTERS) for s in single]
        later = (single[2][2][:, None, :] + single[2][3][None, :, :]).reshape(-1, FILTERS)
        self.tables = [[(pair[0], 0)], [(pair[1], 0), (single[1][2], 2)],
                       [(pair[2], 0), (later, 2)]]

    def probabilities(self, windows: np.ndarray, piece: int = 512) -> np.ndarray:
        out = np.empty((len(windows), len(self.net.languages)), np.float32)
        for start in range(0, len(windows), piece):
            part = windows[start:start + piece].astype(np.int32)
            pairs, pooled = (part[:, :-1] << 8) | part[:, 1:], []
            for width, tables, bias in zip(WIDTHS, self.tables, self.net.biases):
                n, response = part.shape[1] - width + 1, None
                for table, shift in tables:
                    index = part if len(table) == 256 else pairs
                    looked = np.take(table, index[:, shift:shift + n], axis=0)
                    response = looked if response is None else np.add(response, looked, response)
                pooled.append(response.max(axis=1) + bias)
            features = np.maximum(np.concatenate(pooled, axis=1), 0)
            out[start:start + piece] = softmax(features @ self.net.weights + self.net.offset)
        return out


_LETTERS = np.zeros(256, np.float32)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def training_rows(docs: DataFrame, held_out: Column, per_language: int = SAMPLE_PER_LANGUAGE,
                  windows: int = SAMPLE_WINDOWS, window: int = WINDOW) -> DataFrame:
    """(lang, text): windows of texts that are not held out, about `per_language` a language.

    Texts are drawn by a hash of their content at a rate taken from the language's count of
    different texts, so the sample stays of one size and is the same in every run; copies of a text
    count once.  A language of no more texts than that gives all of them.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & ~F.coalesce(held_out, F.lit(False))).select("lang", "text")
    texts = known.groupBy("lang", F.xxhash64("text").alias("hash")).count()
    counts = {r[0]: r[1] for r in texts.groupBy("lang").count().orderBy("lang").collect()}
    chance = F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    if not counts:
        return known.where(F.lit(False))
    rates = F.create_map(*(F.lit(x) for lang, n in counts.items()
                           for x in (lang, min(1.0, per_language / n))))
    drawn = known.where(chance < F.element_at(rates, F.col("lang")))
    places = [F.pmod(F.xxhash64("text", F.lit(i)), F.greatest(
        F.length("text") - window // 2, F.lit(1))) + 1 for i in range(windows)]
    return drawn.select("lang", F.explode(F.array(*(
        F.substring("text", place.cast("int"), F.lit(window)) for place in places))).alias("text")
    ).distinct()


def fit(docs: DataFrame, held_out: Column, **sample) -> Network:
    """Train on labelled texts; languages come in order of their names.

    About `per_language` texts of each language reach the driver, `windows` short windows of each.
    """
    rows = training_rows(docs, held_out, **sample).collect()
    languages = sorted({r[0] for r in rows})
    rows.sort(key=lambda r: (r[0], r[1]))
    if not languages:
        languages, rows = [UNKNOWN], [(UNKNOWN, "")]
    texts = [r[1].encode("utf-8", "surrogatepass")[:WINDOW] for r in rows]
    windows, _ = as_windows(texts)
    numbers = {lang: i for i, lang in enumerate(languages)}
    return train(windows, np.array([numbers[r[0]] for r in rows]), languages)


def with_language(docs: DataFrame, net: Network, keep: list[str] | None = None,
                  lang: str = "lang_pred", score: str = "score",
                  text: str = "text") -> DataFrame:
    """Columns `keep` of the documents with the predicted language and its probability.

    Every byte of a text counts.  A text that is null or has no letter is `und` with score 0.
    """
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(lang, T.StringType()),
                           T.StructField(score, T.DoubleType())])
    letters = "__letters"
    rows = docs.withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(net)
        for batch in batches:
            best, sure = predict(model, batch.column(text), batch.column(letters).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(best, pa.string()),
                 pa.array(sure, pa.float64())], [*keep, lang, score])

    return rows.select(*dict.fromkeys([*keep, text, letters])).mapInArrow(run, schema)


def predict(model: Classifier, texts: pa.Array, lettered: list[bool],
            most: int = 1 << 20) -> tuple[list[str], list[float]]:
    """Language and probability per text; texts go through in groups of about `most` bytes."""
    best, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
    group, size = [], 0

    def close() -> None:
        sums = np.zeros((len(group), len(model.net.languages)))
        for start in range(0, max(len(t) for _, t in group), most):
            left = [i for i, (_, t) in enumerate(group) if start < max(1, len(t))]
            windows, of = as_windows([group[i][1][start:start + most] for i in left])
            weight = _LETTERS[windows].sum(axis=1) + 1e-3
            np.add.at(sums, np.array(left)[of], model.probabilities(windows) * weight[:, None])
        sums /= sums.sum(axis=1, keepdims=True)
        for (place, _), row in zip(group, sums):
            best[place] = model.net.languages[int(row.argmax())]
            sure[place] = float(min(row.max(), 1.0))

    for place, (text, ok) in enumerate(zip(texts, lettered)):
        if ok:
            group.append((place, text.as_py().encode("utf-8", "surrogatepass")))
            size += len(group[-1][1])
        if group and size >= most:
            close()
            group, size = [], 0
    if group:
        close()
    return best, sure


def held_out_rows() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per document, learned from those not held out."""
    net = fit(docs, held_out_rows())
    rows = docs.select("doc_id", F.coalesce(held_out_rows(), F.lit(False)).alias("held_out"), "text")
    return with_language(rows, net, ["doc_id", "held_out"])


def in_known_language(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The documents whose language is recognised: neither `und` nor below `min_score`.

    Where no text has a label, no language can be told, and all documents with letters stay.
    """
    net = fit(docs, held_out_rows())
    if net.languages == [UNKNOWN]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = with_language(docs, net, docs.columns, "__lang", "__score")
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= min_score)).select(
        docs.columns)
