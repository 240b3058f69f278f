"""Document quality by co-training a text view and a page-metadata view.

Each view has a logistic classifier over features of its own, fitted on a bounded sample of labelled rows and calibrated on
a held-out part of it. In each round both score all other documents; each view's most confident ones, by calibrated
probability, go with their pseudo-labels into the other view's training set. In the end the calibrated views are combined
as independent given the class, and one pass scores every document. A view that can't tell the classes apart never becomes
confident, adds nothing to the other and leaves its score as it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyad.llm.common import as_struct, bound_batches, from_struct, given_back, id_back, id_of, materialize, sized

#: Bound on the labelled rows that are fitted on, chosen by hash.
MAX_LABELLED = 8_000
#: One labelled row in so many is held out for calibration.
HELD_OUT = 4
ROUNDS = 2
#: Pseudo-labels a view gives in a round for each class: a share of the documents within these bounds; and the least probability for one.
PSEUDO_SHARE, LEAST_PSEUDO, MOST_PSEUDO = 2e-3, 100, 2_000
CONFIDENT = 0.95
#: Most features of a view, and bound on what the driver keeps of each training row.
MAX_FEATURES = 100_000
#: A feature counts once so many training rows have it.
MIN_ROWS = 5
#: ... and if its share of good rows is so many standard deviations off the share of all rows, so that long texts aren't judged by chance words.
DEVIATIONS = 4
#: Bytes of the stems that stand for inflected words.
STEMS = (4, 5)
KEEP_FROM = 0.5
#: Files at most of each bounded set; a file for each shuffle partition would hold a few rows, and the driver and executors handle every one of them.
FEW_FILES = 16
MEMO = 1 << 18
META = ("lang", "source", "n_chars")
#: Bytes of texts whose rows are sent at a time.
BATCH_TEXT = 8 << 20
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"


def _bucket(x: float, *bounds: float) -> int:
    return sum(x > b for b in bounds)


def text_features(text: bytes) -> set[bytes]:
    """Distinct lower-cased words without marks, their stems, and buckets of what the writing looks like; these start with a blank."""
    n = max(1, len(text))
    plain = text.translate(None, _MARKS).lower().split()
    words, m = set(plain), max(1, len(plain))
    marks = {c: text.count(c) / n for c in (b"!", b"|", b"%", b"$", b"*", b"&", b"#")}
    shape = {
        "same": _bucket(sum(map(eq, plain, plain[1:])) / m, 0.01, 0.05, 0.1, 0.2, 0.4),
        "upper": _bucket((n - len(text.translate(None, _UPPER))) / n, 0.02, 0.05, 0.1, 0.2, 0.4),
        "digits": _bucket((n - len(text.translate(None, _DIGITS))) / n, 0.01, 0.05, 0.1, 0.3),
        "marks": _bucket((n - len(text.translate(None, _MARKS))) / n, 0.02, 0.05, 0.1, 0.2, 0.3),
        "distinct": _bucket(len(words) / m, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
        "words": _bucket(m, 1, 4, 16, 64, 256, 1024, 4096),
        "length": _bucket(n / m, 3, 5, 7, 10, 15),
    } | {f"mark{c.decode()}": _bucket(v, 0, 0.002, 0.01, 0.03, 0.1) for c, v in marks.items()}
    stems = {w[:k] + b"*" for k in STEMS for w in words if len(w) > k}
    return words | stems | {f" {k}={v}".encode() for k, v in shape.items()}


def meta_features(values: dict) -> set[bytes]:
    """One feature per column: numbers by power of two, others by value, null on its own."""
    return {f"{k}={'null' if v is None else int(math.log2(v + 1)) if isinstance(v, (int, float)) and v >= 0 else v}".encode() for k, v in values.items()}


def hashed(features: set[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, features), np.uint64, len(features))


class _Weights(dict):
    """Weight by feature, filled as features are met, and emptied when full."""

    def __init__(self, by_hash: dict[int, float]) -> None:
        super().__init__()
        self.by_hash = by_hash

    def __missing__(self, feature: bytes) -> float:
        if len(self) >= MEMO:
            self.clear()
        self[feature] = w = self.by_hash.get(xxhash.xxh64_intdigest(feature), 0.0)
        return w


class Classifier:
    """Logistic regression over present features, known by their hashes, with a calibrated margin."""

    def __init__(self) -> None:
        self.names, self.weights = np.zeros(0, np.uint64), np.zeros(0)
        self.bias, self.scale, self.shift = 0.0, 1.0, 0.0
        self.memo: _Weights | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}

    def _index(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(feature, row) numbers of the features in use."""
        flat, owner = np.concatenate([*rows, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(rows)), list(map(len, rows)))
        at = np.searchsorted(self.names, flat)
        known = np.append(self.names, np.uint64(0))[at] == flat if len(self.names) else np.zeros(len(flat), bool)
        known &= at < len(self.names)
        return at[known], owner[known]

    def fit(self, names: np.ndarray, rows: list[np.ndarray], labels: list[int], steps: int = 120, l2: float = 2e-4) -> Classifier:
        """``names`` are the features to use, in order; ``rows`` the features of each row."""
        y = np.array(labels, float)
        self.names = names
        index, owner = self._index(rows)
        n = len(self.names)
        w, b, m, v = np.zeros(n), 0.0, np.zeros(n + 1), np.zeros(n + 1)
        for t in range(1, steps + 1):
            z = np.bincount(owner, w[index], len(rows)) + b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
            grad = np.append(np.bincount(index, g[owner], n) + l2 * w, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.weights, self.bias = w, float(b)
        return self

    def margin(self, features: set[bytes]) -> float:
        if self.memo is None:
            self.memo = _Weights(dict(zip(self.names.tolist(), self.weights.tolist())))
        return self.bias + sum(map(self.memo.__getitem__, features))

    def calibrate(self, rows: list[np.ndarray], labels: list[int]) -> Classifier:
        """Fit scale and shift of the margin on rows that weren't trained on, with smoothed labels."""
        index, owner = self._index(rows)
        z, n1 = np.bincount(owner, self.weights[index], len(rows)) + self.bias, sum(labels)
        t = np.where(np.array(labels) == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            s = p * (1 - p) + 1e-9
            h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
            d = np.linalg.solve(h, [((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
            a, b = a - d[0], b - d[1]
            if abs(d).max() < 1e-6:
                break
        self.scale, self.shift = max(0.0, float(a)), float(b)
        return self

    def logit(self, features: set[bytes]) -> float:
        return max(-30.0, min(30.0, self.scale * self.margin(features) + self.shift))


class Model:
    """Both views and the prior of the good class."""

    def __init__(self, text: Classifier | None, meta: Classifier | None, prior: float) -> None:
        self.text, self.meta, self.prior = text, meta, prior

    def scores(self, text: bytes, values: dict) -> tuple[float, float, float]:
        if not self.text:
            return 1.0, 1.0, 1.0
        a, b = self.text.logit(text_features(text)), self.meta.logit(meta_features(values))
        return tuple(1 / (1 + math.exp(-x)) for x in (a, b, max(-60.0, min(60.0, a + b - self.prior))))


def _map(docs: DataFrame, columns: list, schema: str | T.StructType, row: Callable) -> DataFrame:
    """Rows of ``row(text, metadata)`` beside the leading columns."""
    bound_batches(docs.sparkSession)
    n, meta = len(columns), [c for c in META if c in docs.columns]
    picked = docs.select(*columns, F.col("text").cast("binary").alias("__text"), *[F.col(c).alias(f"__meta_{c}") for c in meta])
    names = schema.names if isinstance(schema, T.StructType) else [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, n, BATCH_TEXT):
            values = list(zip(*(batch.column(n + 1 + i).to_pylist() for i in range(len(meta))))) or [()] * batch.num_rows
            out = [row(t.as_py() or b"", dict(zip(meta, v))) for t, v in zip(batch.column(n), values)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array([o[k] for o in out]) for k in range(len(out[0])))], names=names)

    return picked.mapInArrow(given_back(run), schema)


def _features(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, good, text, meta): hashed features of the bounded set ``wanted`` (wanted_id, wanted_good), written; of rows that repeat an id, those least by features."""
    meta = [c for c in META if c in docs.columns]
    mine = docs.select(id_of("doc_id").alias("id"), "text", *meta).join(F.broadcast(wanted), F.col("id") == F.col("wanted_id"))
    rows = _map(mine, ["id", "wanted_good"], "id bigint, good int, text binary, meta binary", lambda t, m: (np.sort(hashed(text_features(t))).tobytes(), np.sort(hashed(meta_features(m))).tobytes()))
    return materialize(rows.groupBy("id").agg(F.min(F.struct("good", "text", "meta")).alias("one")).select("id", "one.*").coalesce(FEW_FILES), "features")


def _telling(rows: DataFrame, view: str, base: float) -> np.ndarray:
    """Features of ``rows`` (good, and ``view`` binary) that tell good rows from others, at most MAX_FEATURES, the most telling ones; counted where the rows are."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 1, 8 << 20):
            held = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(1)]
            flat, good = np.concatenate(held), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), list(map(len, held)))
            h, of = np.unique(flat, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(of, minlength=len(h)).astype(np.int64)), pa.array(np.bincount(of, good, len(h)).astype(np.int64))], names=["h", "n", "good"])

    sums = rows.select("good", view).mapInArrow(given_back(count), "h bigint, n bigint, good bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    off = F.abs(F.col("good") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
    found = sums.filter(F.col("n") >= MIN_ROWS).withColumn("off", off).filter(F.col("off") >= DEVIATIONS).orderBy(F.desc("off"), "h").limit(MAX_FEATURES).select("h")
    return np.sort(found.toArrow().column("h").to_numpy().view(np.uint64))


def _rows(rows: DataFrame, view: str, names: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Features of each row that are among ``names``, and its label, in the order of id, label and features."""

    def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.intersect1d(np.frombuffer(x.as_py(), np.uint64), names).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], names=["id", "good", "kept"])

    got = rows.select("id", "good", view).mapInArrow(given_back(thin), "id bigint, good int, kept binary").toArrow()
    listed = sorted(zip(got.column("id").to_pylist(), got.column("good").to_pylist(), got.column("kept").to_pylist()))
    return [np.frombuffer(k, np.uint64) for *_, k in listed], [g for _, g, _ in listed]


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> Model:
    """Co-train on the labelled rows of ``docs`` (at most ``max_labelled`` labels) and on pseudo-labels among all its other rows.

    The driver gets, of each training row, only the features that the classifiers use.
    """
    known = (
        labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
        .groupBy(F.col("doc_id").cast("long").alias("wanted_id"))
        .agg(F.min(F.when((F.coalesce("quality", F.lit(1)) >= 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("wanted_good"))
    )
    sample = _features(docs, materialize(known.orderBy(F.xxhash64("wanted_id"), "wanted_id").limit(max_labelled), "labelled"))
    place = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(HELD_OUT))
    held, fit = sample.filter(place == 0), sample.filter(place != 0)
    counts = {(r["h"], r["good"]): r["n"] for r in sample.groupBy((place == 0).alias("h"), "good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 4:
        return Model(None, None, 0.0)
    good, bad = (sum(n for (_, g), n in counts.items() if g == k) for k in (1, 0))
    prior = math.log((good + 1) / (bad + 1))
    sets = {"text": fit, "meta": fit}
    used = sample.select("id").distinct()
    enough = min(MOST_PSEUDO, max(LEAST_PSEUDO, int(PSEUDO_SHARE * docs.count())))
    for left in range(rounds, -1, -1):
        views = {}
        for view, rows in sets.items():
            n, ones = rows.agg(F.count(F.lit(1)), F.sum("good")).first()
            names = _telling(rows, view, min(max(ones / n, 1e-3), 1 - 1e-3))
            views[view] = Classifier().fit(names, *_rows(rows, view, names)).calibrate(*_rows(held, view, names))
        model = Model(views["text"], views["meta"], prior)
        if not left:
            return model
        scored = materialize(
            _map(docs, [id_of("doc_id").alias("id")], "id bigint, text double, meta double, both double", model.scores)
            .filter(F.greatest("text", "meta", 1 - F.col("text"), 1 - F.col("meta")) >= CONFIDENT)
            .join(F.broadcast(used), "id", "left_anti"),
            "confident",
        )
        # Documents go by id; rows that repeat one are as sure as the least sure of them.
        sure = scored.groupBy("id").agg(*[f(v).alias(f"{v}{k}") for v in ("text", "meta") for k, f in ((1, F.min), (0, F.max))])
        chosen = None
        for view, other in (("text", "meta"), ("meta", "text")):
            for label, p in ((1, F.col(f"{view}1")), (0, 1 - F.col(f"{view}0"))):
                top = sure.filter(p >= CONFIDENT).orderBy(p.desc(), F.xxhash64("id"), "id").limit(enough).select(F.col("id").alias("wanted_id"), F.lit(label).alias("wanted_good"), F.lit(other == "meta").alias("for_meta"))
                chosen = top if chosen is None else chosen.unionByName(top)
        # A document that both views chose goes by the text's label.
        once = materialize(chosen.groupBy("wanted_id").agg(F.max_by("wanted_good", "for_meta").alias("wanted_good"), F.max("for_meta").alias("for_meta")).coalesce(FEW_FILES), "pseudo")
        found = _features(docs, once.select("wanted_id", "wanted_good"))
        split = found.join(F.broadcast(once), F.col("id") == F.col("wanted_id")).select("id", "good", "text", "meta", "for_meta")
        sets["text"] = sets["text"].unionByName(split.filter(~F.col("for_meta")).drop("for_meta"))
        sets["meta"] = sets["meta"].unionByName(split.filter("for_meta").drop("for_meta"))
        used = used.unionByName(found.select("id").distinct())
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, text_score, meta_score, score, keep`` (score of at least ``KEEP_FROM``).

    Good means quality 1 and not toxic. A document labelled twice is good if each of its labels is; null quality counts as
    1, null toxic as 0, and rows with both null are left out. Null texts count as empty, null metadata as a value of its own.
    Repeated rows are scored alike. Without labels of both classes every score is 1 and all documents are kept. An empty
    table gives an empty result; columns besides doc_id, text and the metadata are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return _map(docs, [id_of("doc_id").alias("id")], "id bigint, text_score double, meta_score double, score double", lambda t, m: model.value.scores(t, m)).select(
        id_back("id").alias("doc_id"), "text_score", "meta_score", "score", (F.col("score") >= KEEP_FROM).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``score`` keeps, with all their columns, whatever their names, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    scored = _map(docs, [as_struct(docs).alias("row")], T.StructType([T.StructField("row", docs.select(as_struct(docs).alias("row")).schema["row"].dataType), T.StructField("score", T.DoubleType())]), lambda t, m: (model.value.scores(t, m)[2],))
    return from_struct(scored.filter(F.col("score") >= KEEP_FROM), "row", docs.columns)
