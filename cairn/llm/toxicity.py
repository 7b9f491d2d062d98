"""Toxicity by class-conditional Kneser-Ney word models.

Two models, of toxic and of ordinary labelled texts, give every word a
probability. A word's own discounted count backs off to its prefixes of five,
four and three bytes, whose weights are Kneser-Ney continuation counts (how
many distinct words of the class begin so), and at last to one distribution
that both classes share. A rare inflected form thereby inherits what its stem
shows, and a word that neither class knows decides nothing. A text's score
compares the length-normalised log-likelihoods of the two models, together
with the strongest single words, on a scale that logistic regression fits on
labelled rows which the counts haven't seen.

Learning uses a bounded sample of labelled rows: at most ``toxic_rows`` and
``ordinary_rows``, in the order of a checksum of their identifiers, a
fold of them for the scale and the others for counts. All words of these rows
count, however rare; the levels are tables, grouped and joined by Spark, and
only their ratios (twelve bytes a word of the bounded sample) are broadcast.
Scoring covers all rows and whole texts and reads nothing but the text.

Nulls and edges: a null text is empty and gets the score of a text without
evidence; labels that are null, or whose row has no document, are not used; a
label repeated for a document counts once. The scale is fitted on the last
fold that has both classes; without one, every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.hashing import Words, words
from cairn.llm.tasks import id_and_text, map_columns, slices
from cairn.plans.durable import materialize

PREFIXES = (5, 4, 3)
DISCOUNT = 0.75
FEATURES = ["mean", "evidence", "strongest", "length"]


def crc_of(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, toxic_rows: int, ordinary_rows: int, folds: int = 5) -> tuple[DataFrame, dict, int | None]:
    """(text, toxic, fold) of the sampled labelled rows outside fold 0, how many rows each class has in all, the last fold with both classes."""
    crc = crc_of(id_col)
    usable = (
        labels.select(id_col, F.col("toxic").cast("int").alias("toxic"), crc.alias("crc"))
        .where(f"toxic in (0, 1) and {id_col} is not null")
        .where(F.col("crc") % folds != 0)
        .groupBy(id_col, "crc")
        .agg(F.max("toxic").alias("toxic"))
    )
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("crc"), id_col]
    chosen = usable.where("toxic = 1").orderBy(*order).limit(toxic_rows)
    chosen = chosen.union(usable.where("toxic = 0").orderBy(*order).limit(ordinary_rows))
    chosen = chosen.select(F.col(id_col).alias("id"), "toxic", (F.col("crc") % folds).alias("fold"))
    chosen = materialize(chosen, "chosen")  # at most toxic_rows + ordinary_rows rows of three numbers
    sample = materialize(id_and_text(docs, id_col, "text").join(F.broadcast(chosen), "id").select("text", "toxic", "fold"), "sample")
    both = sample.groupBy("fold").agg((F.min("toxic") < F.max("toxic")).alias("both")).where("both")
    return sample, totals, both.agg(F.max("fold").alias("fold")).first()["fold"]


def units(w: Words) -> list[np.ndarray]:
    """Each word's hash and those of its prefixes, longest first."""
    return [w.hash] + [w.range_hash(w.start, np.minimum(w.start + n, w.end)) for n in PREFIXES]


def count_words(sample: DataFrame) -> DataFrame:
    """(word, p5, p4, p3, ordinary, toxic): occurrences by class; summed in the task before the shuffle."""
    names = ["word", *(f"p{n}" for n in PREFIXES)]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                if not len(w.hash):
                    continue
                label = np.repeat(part.column("toxic").to_numpy(), np.diff(w.offsets))
                keys = units(w)
                _, first, inverse = np.unique(keys[0], return_index=True, return_inverse=True)
                columns = [pa.array(k[first].view(np.int64)) for k in keys]
                columns += [pa.array(np.bincount(inverse[label == c], minlength=len(first))) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ordinary", "toxic"])

    schema = ", ".join(f"{c} long" for c in [*names, "ordinary", "toxic"])
    rows = sample.select("text", "toxic").mapInArrow(run, schema)
    return rows.groupBy(*names).agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def smoothed_levels(counted: DataFrame) -> list[DataFrame]:
    """(key, ratio) of the words and of each prefix level, longest first: log P(key | toxic) - log P(key | ordinary).

    Prefixes weigh by how many distinct words of a class begin so. Discounted
    mass goes to the next shorter prefix's probability, which its words share
    alike in both classes; the shortest prefixes back off to one distribution
    for both.
    """
    out, lower, parent = [], None, None
    for name in [*(f"p{n}" for n in reversed(PREFIXES)), "word"]:
        keys = [F.col(name).alias("key"), *([F.col(parent).alias("up")] if parent else [])]
        if name == "word":
            level = counted.select(*keys, F.col("ordinary").alias("n0"), F.col("toxic").alias("n1"))
        else:
            kinds = [F.count_if(F.col(c) > 0).alias(k) for c, k in (("ordinary", "n0"), ("toxic", "n1"))]
            level = counted.groupBy(*keys).agg(*kinds)
        level = materialize(level, "level")
        t = level.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1")], *[F.count_if(F.col(c) > 0).alias(f"k{c}") for c in ("n0", "n1")]).first()
        both = F.col("n0") + F.col("n1")
        if lower is None:
            everything = float(t["n0"] + t["n1"] or 1)
            level = level.withColumns({f"low{c}": both / everything for c in ("n0", "n1")})
        else:
            level = level.join(lower, "up")
        for c in ("n0", "n1"):
            total = float(t[c] or 1)
            level = level.withColumn(f"q{c}", F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / total + DISCOUNT * t[f"k{c}"] / total * F.col(f"low{c}"))
        out.append(level.select("key", (F.log(F.col("qn1") + 1e-12) - F.log(F.col("qn0") + 1e-12)).cast("float").alias("ratio")))
        lower = level.select(F.col("key").alias("up"), *[(F.col(f"q{c}") / both).alias(f"low{c}") for c in ("n0", "n1")])
        parent = name
    return out[::-1]


class Ratios:
    """The levels' ratios as sorted arrays."""

    def __init__(self, levels: list[pa.Table]):
        self.levels = []
        for table in levels:
            key, ratio = table.column("key").to_numpy(), table.column("ratio").to_numpy()
            order = np.argsort(key)
            self.levels.append((key[order], ratio[order]))

    def of(self, w: Words) -> np.ndarray:
        """Each word's ratio: its own, else that of its longest known prefix, else 0."""
        out = np.zeros(len(w.hash), np.float32)
        rest = np.arange(len(w.hash))
        for level, (key, ratio) in enumerate(self.levels):
            if not len(rest) or not len(key):
                continue
            if level == 0:
                h = w.hash.view(np.int64)
            else:
                a = w.start[rest]
                h = w.range_hash(a, np.minimum(a + PREFIXES[level - 1], w.end[rest])).view(np.int64)
            at = np.minimum(np.searchsorted(key, h), len(key) - 1)
            hit = key[at] == h
            out[rest[hit]] = ratio[at[hit]]
            rest = rest[~hit]
        return out


def features(texts: pa.Array, ratios: Ratios) -> np.ndarray:
    """(rows, 4): mean ratio, summed strong evidence, the strongest word, length."""
    w = words(texts)
    r = ratios.of(w).astype(np.float64)
    n = np.diff(w.offsets)
    out = np.zeros((len(n), 4))
    some = n > 0
    if some.any():
        at = w.offsets[:-1][some]
        out[some, 0] = np.add.reduceat(r, at) / n[some]
        out[some, 1] = np.log1p(np.add.reduceat(np.maximum(r - 1, 0), at))
        out[some, 2] = np.maximum.reduceat(r, at)
    out[:, 3] = np.log1p(n)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> dict:
    """Weighted ridge logistic regression by Newton steps on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta, penalty = np.zeros(z.shape[1]), ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = z.T @ (z * (weight * p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "beta": beta}


class Model:
    """What scoring needs, small enough to broadcast: ratios of the words of a bounded number of rows, and of their prefixes."""

    def __init__(self, ratios: Ratios | None, scale: dict | None):
        self.ratios, self.scale = ratios, scale

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.ratios is None:
            return np.zeros(len(texts))
        x = (features(texts, self.ratios) - self.scale["mean"]) / self.scale["scale"]
        return 1 / (1 + np.exp(-np.clip(self.scale["beta"][0] + x @ self.scale["beta"][1:], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", toxic_rows: int = 6000, ordinary_rows: int = 12000) -> Model:
    spark = docs.sparkSession
    sample, totals, held = labelled_sample(docs, labels, id_col, toxic_rows, ordinary_rows)
    if held is None:
        return Model(None, None)
    counted = materialize(count_words(sample.where(F.col("fold") != held)), "counted")
    ratios = Ratios([level.toArrow() for level in smoothed_levels(counted)])
    shared = spark.sparkContext.broadcast(ratios)

    def run(batch: pa.RecordBatch) -> dict:
        x = np.concatenate([features(p.column("text"), shared.value) for p in slices(batch)]) if batch.num_rows else np.zeros((0, 4))
        return dict(zip(FEATURES, x.T, strict=True))

    held = map_columns(sample.where(F.col("fold") == held), ["toxic"], ", ".join(f"{f} double" for f in FEATURES), run).toArrow()
    y = held.column("toxic").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return Model(None, None)
    share = totals[1] / (totals[0] + totals[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(ratios, fit_logistic(np.column_stack([held.column(f).to_numpy() for f in FEATURES]), y, weight))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        parts = [shared.value.score(p.column("text")) for p in slices(batch)]
        return {"score": np.concatenate(parts) if parts else np.zeros(0)}

    return map_columns(id_and_text(docs, id_col, text_col), ["id"], "score double", run).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the model calls toxic, decided row by row as they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(shared.value.score(part.column(text_col)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    scored = score(docs, learn(docs, labels, id_col), id_col)
    return scored.select(
        id_col, (crc_of(id_col) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
