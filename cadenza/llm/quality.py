"""Quality classifier by co-training of two views.

View one is a text's content: which words, beginnings of words and runs of marks it has. View two is the page's metadata: source,
language, and the layout (length, lines, capitals, digits, punctuation, repeated lines). For each view a logistic regression is fitted
on labelled documents. In rounds, each view looks through all unlabelled documents for the `GIVEN` that it is surest of, in the shares
of the classes, and gives them with its labels to the other. Both views are calibrated on labelled documents kept out of the fit, and
their log-odds are added, the prior counted once. A document is kept if it is probably good and probably not toxic; each of the two
has its own pair of views.

* The fit uses at most `labelled` labelled documents, a parameter: each pair of a quality and a toxicity label gives all it has, the
  rarest first, and the others share the rest, chosen by hash of their ids. Documents weigh by how many of their pair they stand for,
  so that the priors are those of all labels. Which features tell most is counted over these documents, by Spark.
* Layout means and deviations, and the search for pseudo-labels, cover all documents: their features are written once, a tenth of the
  texts' size, and every round reads them. Equal documents count once there. The driver gets the features of the labelled sample and
  of the documents given, and nothing else that grows.
* Scoring reads every document once, whole, and shuffles nothing.

Edge cases: null texts count as empty, other nulls as values of their own; labels that are null, or whose documents disagree or are
missing, are not used; of rows that repeat a labelled id, the least by features is fitted on; a label with fewer than `LEAST` documents
of a class rejects nothing (its score is the accepting one); repeated rows get equal scores; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm import features
from cadenza.llm.common import table, written

#: Labelled documents that a fit uses at most.
LABELLED = 6000
#: Features for each label, and documents of the sample that a feature must be in.
VOCABULARY, LEAST_DOCS = 2000, 3
#: Least documents of a class; every how-manieth labelled document calibrates; rounds; pseudo-labels of a round; how sure.
LEAST, HELD_OUT, ROUNDS, GIVEN, SURE = 10, 4, 3, 200, 0.95
BINS = 64
LABELS = {"quality": 1, "toxic": 0}
_META = "lang int, source int, layout array<float>"


class Marks:
    """Documents by features: where the ones are."""

    def __init__(self, found: list[np.ndarray], width: int):
        self.cols = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
        self.rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
        self.shape = len(found), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.cols], minlength=self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=g[self.rows], minlength=self.shape[1])


class Table:
    """Documents by numbers."""

    def __init__(self, values: np.ndarray):
        self.values, self.shape = values, values.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.values @ w

    def back(self, g: np.ndarray) -> np.ndarray:
        return self.values.T @ g


def bin_of(kind: str, value: str | None) -> int:
    return zlib.crc32(f"{kind}={value}".encode("utf-8", "surrogatepass")) % BINS


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: Marks | Table, y: np.ndarray, weight: np.ndarray, scale: np.ndarray | None = None, decay: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Weights, the intercept last; full-batch Adam, which needs no tuning here. ``scale``: how easily a column gets weight."""
    scale = np.ones(x.shape[1]) if scale is None else scale
    w, m, v = np.zeros(x.shape[1] + 1), 0.0, 0.0
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        gap = weight * (sigmoid(x.dot(w[:-1] * scale) + w[-1]) - y)
        g = np.append(x.back(gap) * scale + decay * w[:-1], gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return np.append(w[:-1] * scale, w[-1])


def odds(x: Marks | Table, w: np.ndarray) -> np.ndarray:
    return x.dot(w[:-1]) + w[-1]


class Learner:
    """One label's two views: what each has been taught, and the models of the moment.

    ``views`` and ``y`` are of the labelled sample; ``y`` is 0, 1, or -1 where this label is not known.
    """

    def __init__(self, found: list[np.ndarray], meta: np.ndarray, y: np.ndarray, stands_for: np.ndarray, scale: np.ndarray):
        self.found, self.meta, self.y, self.many, self.scale = found, meta, y, stands_for, scale
        # every HELD_OUT-th of each class calibrates
        self.held = np.concatenate([np.flatnonzero(y == c)[::HELD_OUT] for c in (0, 1)])
        self.fit = np.setdiff1d(np.flatnonzero(y >= 0), self.held)
        self.taught: list[dict] = [{}, {}]  # by view: key to (found, meta, label)
        self.share = float(np.average(y[self.fit], weights=stands_for[self.fit]))
        prior = float(np.average(y[self.held], weights=stands_for[self.held]))
        self.prior = math.log(prior / (1 - prior))

    def train(self) -> None:
        fit, width = self.fit, len(self.scale)
        self.weights, self.calibration = [], []
        for view, own in enumerate(self.taught):
            new = list(own.values())
            y = np.concatenate([self.y[fit], [label for _, _, label in new]]).astype(float)
            many = np.concatenate([self.many[fit], np.ones(len(new))])
            if view == 0:
                w = logistic(Marks([self.found[k] for k in fit] + [f for f, _, _ in new], width), y, many, self.scale)
                z = odds(Marks([self.found[k] for k in self.held], width), w)
            else:
                w = logistic(Table(np.concatenate([self.meta[fit], *[m[None] for _, m, _ in new]])), y, many, decay=1e-3)
                z = odds(Table(self.meta[self.held]), w)
            self.weights.append(w)
            self.calibration.append(logistic(Table(z[:, None]), self.y[self.held].astype(float), self.many[self.held], steps=400))

    def model(self) -> dict:
        return {"weights": self.weights, "scale": self.calibration, "prior": self.prior}

    def wanted(self) -> list[int]:
        """Pseudo-labels of class 0 and 1 that a view may give in a round."""
        return [max(1, round(GIVEN * (1 - self.share))), max(1, round(GIVEN * self.share))]

    def keys(self) -> set[int]:
        return {key for own in self.taught for key in own}


def _wanted(docs: DataFrame, labels: DataFrame, id_col: str, labelled: int = LABELLED) -> DataFrame:
    """At most ``labelled`` ids with their labels, and how many labelled documents each stands for."""
    names = list(LABELS)
    known = written(_clear(labels, id_col).join(docs.select(id_col).where(F.col(id_col).isNotNull()).distinct(), id_col, "left_semi"))
    cells = sorted(known.groupBy(*names).count().collect(), key=lambda r: (r["count"], str(r)))  # at most nine
    parts, left = [], labelled
    for k, cell in enumerate(cells):
        most = min(cell["count"], left // (len(cells) - k))
        left -= most
        own = reduce(and_, [F.col(c).eqNullSafe(F.lit(cell[c])) for c in names])
        parts.append(known.where(own).orderBy(F.xxhash64(id_col), id_col).limit(most).withColumn("stands_for", F.lit(cell["count"] / max(1, most))))
    return reduce(DataFrame.unionByName, parts) if parts else known.withColumn("stands_for", F.lit(1.0))


def _clear(labels: DataFrame, id_col: str) -> DataFrame:
    """One row per labelled id; a label that its rows don't agree on is null."""
    names = list(LABELS)
    clear = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.min(c).alias(c) for c in names], *[F.max(c).alias(f"_{c}") for c in names])
    return clear.select(id_col, *[F.when((F.col(c) == F.col(f"_{c}")) & F.col(c).isin(0, 1), F.col(c)).cast("int").alias(c) for c in names])


def _columns(docs: DataFrame, id_col: str) -> list:
    return [F.col(id_col), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]


def _described(batch: pa.RecordBatch):
    """Parts of a batch (id, text, lang, source, ...) with their features, how many each has, layout, and bins."""
    for at, end in features.groups(batch.column(1)):
        part = batch.slice(at, end - at)
        found, counts, layout = features.describe(part.column(1).to_pylist())
        bins = [np.array([bin_of(kind, x) for x in part.column(k).to_pylist()], np.int32) for k, kind in ((2, "lang"), (3, "source"))]
        yield part, found, counts, layout.astype(np.float32), bins


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def _noted(docs: DataFrame, at: np.ndarray | None, extra: str = "") -> DataFrame:
    """(id, text, lang, source, more) to (id, found, lang, source, layout, more); ``at`` gives features' columns, or -1 for those left out."""
    kind, names = docs.schema[0].dataType.simpleString(), ["id", "found", "lang", "source", "layout", *[x.split()[0] for x in extra.split(", ") if x]]
    held = None if at is None else docs.sparkSession.sparkContext.broadcast(at)  # 2^BITS numbers

    def run(batches):
        for batch in batches:
            for part, found, counts, layout, bins in _described(batch):
                if held is not None:
                    found, counts = _known(found, counts, held.value)
                cols = [part.column(0), _lists(found.astype(np.int32), counts), *map(pa.array, bins), _lists(layout.ravel(), np.full(len(layout), layout.shape[1]))]
                yield pa.RecordBatch.from_arrays([*cols, *(part.column(k) for k in range(4, part.num_columns))], names)

    return docs.mapInArrow(run, f"id {kind}, found array<int>, {_META}" + (f", {extra}" if extra else ""))


def _known(found: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the features that have one, and how many each document has."""
    col = at[found]
    kept = np.concatenate([[0], np.cumsum(col >= 0)])
    ends = np.cumsum(counts)
    return col[col >= 0], kept[ends] - kept[ends - counts]


def _vocabulary(sample: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Column of each feature number, or -1, and for each label how far each column's count among the ones is from chance."""
    told, width = {}, 0
    rows = sample.select(F.explode("found").alias("f"), *LABELS, "stands_for")
    for label in LABELS:
        own = sample.where(F.col(label).isNotNull())
        share = own.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
        counts = rows.where(F.col(label).isNotNull()).groupBy("f").agg(F.count("*").alias("c"), F.sum(label).alias("ones")).where(F.col("c") >= LEAST_DOCS)
        far = F.abs(F.col("ones") - F.col("c") * share) / F.sqrt(F.col("c") * share * (1 - share) + 1)
        told[label] = [(r["f"], r["z"]) for r in counts.select("f", far.alias("z")).where("z > 0").orderBy(F.desc("z"), "f").limit(VOCABULARY).collect()]
    at = np.full(1 << features.BITS, -1, np.int32)
    for f in sorted({f for own in told.values() for f, _ in own}):
        at[f] = width
        width += 1
    scales = {label: np.zeros(width) for label in LABELS}
    for label, own in told.items():
        for f, z in own:
            scales[label][at[f]] = 3 * z / own[0][1]
    return at, scales


def meta_view(layout: np.ndarray, lang: np.ndarray, source: np.ndarray, model: dict) -> np.ndarray:
    marks = np.zeros((len(layout), BINS), np.float32)
    marks[np.arange(len(layout)), lang] = 1
    marks[np.arange(len(layout)), source] = 1
    scaled = np.clip((layout - model["mean"]) / model["std"], -5, 5).astype(np.float32)
    return np.concatenate([scaled, scaled**2 / 5, marks], 1)


def _views(batch: pa.RecordBatch, model: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """Content and metadata of rows with found, lang, source and layout."""
    found = batch.column("found")
    ends, flat = np.asarray(found.offsets), found.flatten().to_numpy()
    layout = batch.column("layout").flatten().to_numpy().reshape(batch.num_rows, features.LAYOUT)
    return np.split(flat, (ends - ends[0])[1:-1]) if batch.num_rows else [], meta_view(layout, batch.column("lang").to_numpy(), batch.column("source").to_numpy(), model)


def view_odds(found: list[np.ndarray], meta: np.ndarray, own: dict | None) -> list[np.ndarray]:
    """The calibrated log-odds of each view; not numbers where there is no model."""
    if own is None:
        return [np.full(len(meta), np.nan)] * 2
    content, metadata = own["weights"]
    z = odds(Marks(found, len(content) - 1), content), odds(Table(meta), metadata)
    return [x * scale[0] + scale[1] for x, scale in zip(z, own["scale"], strict=True)]


def probability(z: list[np.ndarray], own: dict | None, otherwise: float) -> np.ndarray:
    return np.full(len(z[0]), float(otherwise)) if own is None else sigmoid(sum(z) - own["prior"])


def surest(pool: DataFrame, learners: dict[str, Learner], model: dict) -> list:
    """Rows (label, view, class, key, found, lang, source, layout): the unlabelled documents that each view is surest of, as many as it may give."""
    now = {label: (own.model(), own.wanted(), own.keys()) for label, own in learners.items()}
    groups = [(label, view, c) for label in now for view in (0, 1) for c in (0, 1)]

    def look(batches):
        best: dict[int, list] = {g: [] for g in range(len(groups))}
        for batch in batches:
            found, meta = _views(batch, model)
            keys = batch.column("key").to_numpy()
            for label, (own, wanted, taught) in now.items():
                free = ~np.isin(keys, list(taught))
                for view, z in enumerate(view_odds(found, meta, own)):
                    for c in (0, 1):
                        p = sigmoid(z if c else -z)
                        rows = np.flatnonzero(free & (p >= SURE))
                        rows = rows[np.lexsort((keys[rows], -p[rows]))][: wanted[c]]
                        g = groups.index((label, view, c))
                        best[g] = sorted([*best[g], *((-p[r], int(keys[r]), batch.slice(r, 1)) for r in rows)], key=lambda x: x[:2])[: wanted[c]]
        for g, rows in best.items():
            for p, _, row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([-p]), *row.columns], names)

    names = ["g", "task", "p", *pool.columns]
    found = pool.mapInArrow(look, f"g int, task int, p double, key long, found array<int>, {_META}")
    some = F.element_at(F.array(*[F.lit(now[label][1][c]) for label, _, c in groups]), F.col("g") + 1)
    for by in (["g", F.floor(F.sqrt("task"))], ["g"]):  # of groups of tasks first, so that one task does not get all tasks' rows
        found = found.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("p"), "key"))).where(F.col("at") <= some).drop("at")
    return [(*groups[r["g"]], r) for r in found.orderBy("g", F.desc("p"), "key").collect()]  # bounded: what a round may give


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", labelled: int = LABELLED, rounds: int = ROUNDS) -> dict:
    """Features, layout statistics, and for each label both views' weights and calibration."""
    chosen = docs.select(*_columns(docs, id_col)).join(F.broadcast(_wanted(docs, labels, id_col, labelled)), id_col)  # at most `labelled` rows
    extra = ", ".join(f"{c} int" for c in LABELS) + ", stands_for double"
    noted = _noted(chosen.select(id_col, "text", "lang", "source", *LABELS, "stands_for"), None, extra)
    least = F.min(F.struct("found", "lang", "source", "layout", *LABELS, "stands_for")).alias("x")
    sample = written(noted.groupBy("id").agg(least).select("id", "x.*"))
    at, scales = _vocabulary(sample)
    model = {"at": at}
    everything = written(_noted(docs.select(*_columns(docs, id_col)), at))
    spread = everything.agg(*[f(F.col("layout")[k].cast("double")) for f in (F.avg, F.stddev_pop) for k in range(features.LAYOUT)]).first()
    model["mean"] = np.array([x or 0 for x in spread[: features.LAYOUT]])
    model["std"] = np.array([x or 0 for x in spread[features.LAYOUT :]]) + 1e-6
    rows = sample.orderBy("id").select("found", "lang", "source", "layout", *LABELS, "stands_for").toArrow().combine_chunks().to_batches()  # at most `labelled` rows
    learners: dict[str, Learner] = {}
    if rows:
        all_found, counts = _known(rows[0].column("found").flatten().to_numpy(), np.diff(np.asarray(rows[0].column("found").offsets)), at)
        found = np.split(all_found, np.cumsum(counts)[:-1])
        meta = _views(rows[0], model)[1]
        for label in LABELS:
            y = np.array([-1 if v is None else v for v in rows[0].column(label).to_pylist()])
            if min((y == 0).sum(), (y == 1).sum()) >= LEAST:
                learners[label] = Learner(found, meta, y, rows[0].column("stands_for").to_numpy(), scales[label])
                learners[label].train()
    if learners and rounds:
        free = everything.join(_clear(labels, id_col).select(F.col(id_col).alias("id")), "id", "left_anti").select("found", "lang", "source", "layout")
        pool = written(free.distinct().select(F.xxhash64("found", "lang", "source", "layout").alias("key"), "found", "lang", "source", "layout"))
        for _ in range(rounds):
            given = surest(pool, learners, model)
            for label, view, c, row in given:
                if row["key"] not in learners[label].keys():
                    meta = meta_view(np.array([row["layout"]]), np.array([row["lang"]]), np.array([row["source"]]), model)[0]
                    learners[label].taught[1 - view][row["key"]] = np.array(row["found"], np.int64), meta, c
            for own in learners.values():
                own.train()
            if not given:
                break
    return model | {label: learners[label].model() if label in learners else None for label in LABELS}


def _judged(batch: pa.RecordBatch, model: dict):
    """For each part of a batch (id, text, lang, source): ids, for each label the two views' log-odds and the probability, and keep."""
    for part, found, counts, layout, bins in _described(batch):
        known, counts = _known(found, counts, model["at"])
        lists, meta = np.split(known, np.cumsum(counts)[:-1]), meta_view(layout, *bins, model)
        cols, keep = [], np.ones(part.num_rows, bool)
        for label, good in LABELS.items():
            z = view_odds(lists, meta, model[label])
            p = probability(z, model[label], good)
            cols += [*z, p]
            keep &= (p >= 0.5) == bool(good)
        yield part.column(0), cols, keep


def score(docs: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """id, for each label the two views' log-odds and the combined probability, and keep."""
    chosen = docs.select(*_columns(docs, id_col))
    names = [id_col, *[f"{label}_{x}" for label in LABELS for x in ("content", "metadata", "score")], "keep"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers and two models

    def run(batches):
        for batch in batches:
            for ids, cols, keep in _judged(batch, shared.value):
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c.astype(np.float64), from_pandas=True) for c in cols], pa.array(keep)], names)

    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names[1:-1]) + ", keep boolean")


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that the classifier keeps, as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col))

    @F.pandas_udf("boolean")
    def good(text, lang, source):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(range(len(text))), pa.array(text, pa.binary()), pa.array(lang, pa.string()), pa.array(source, pa.string())], ["k", "text", "lang", "source"])
        return pd.Series([bool(x) for _, _, keep in _judged(batch, shared.value) for x in keep], dtype=bool)

    _, text, lang, source = _columns(docs, id_col)
    return docs.where(good(text, lang, source))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
