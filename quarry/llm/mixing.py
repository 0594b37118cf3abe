"""Mixing sources to target shares of all tokens, with soft membership.

1. A classifier of source is fitted on a bounded sample of labelled documents (SAMPLE of each source,
   chosen by hash), and gives every document a posterior over the sources; the document's own label is evidence of
   reliability TRUST. This and its tokens under a public tokenizer are read in one narrow pass.
2. Document rates between 0 and ``max_repeats`` are fitted by projected-gradient least squares, so that
   the expected tokens of each source, soft memberships counted, match the targets. Gradients are
   accumulated in one number for each source and the projection is applied to each document's accumulated
   step, so an iteration is one aggregation over the documents and nothing is kept for each of them.
3. Rates become whole copies by a hash of the document, and one factor for each source is
   fitted by further aggregations so that the tokens of the documents that carry its label match the target.

The size of the mixture is the largest at which every source that has documents can reach its share, or the
``size`` asked for; then sources that are too small stay below their share and the report says so.
Shares are those among the sources that have documents; of the others the report gives 0.

Defined cases. Sources are compared trimmed and in lower case. Documents without a source, or of one that
is not in the targets, are in no mixture. Null, empty and blank texts have no tokens and are left
out. Repeated documents are documents of their own. Targets that are null or not above 0, and
``max_repeats`` below 1, take nothing. If no source has tokens the mixture is empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import tokenizer

SAMPLE, TRUST = 400, 0.95
DIMENSIONS = 1 << 12
_WORD = re.compile(r"[^\W\d_]+|\d|[^\w\s]")


def normal_source(c: str = "source") -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


_places: dict[str, int] = {}


def _place(word: str) -> int:
    at = _places.get(word)
    if at is None:
        if len(_places) > 200_000:
            _places.clear()
        at = _places[word] = zlib.crc32(word.encode()) % DIMENSIONS
    return at


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a text and their dampened counts, of length one."""
    seen = Counter(map(_place, _WORD.findall(text.lower())))
    at = np.fromiter(seen.keys(), np.int64, len(seen))
    x = np.log1p(np.fromiter(seen.values(), np.float64, len(seen)))
    return at, x / (np.linalg.norm(x) or 1.0)


class Classifier:
    """Softmax regression on hashed words, fitted by gradient descent on a bounded sample."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, rounds: int = 150, rate: float = 4.0, shrink: float = 1e-4):
        x = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, (at, v) in enumerate(rows):
            x[i, at] = v
        y = np.zeros((len(rows), classes), np.float32)
        y[np.arange(len(rows)), labels] = 1
        # classes count alike, however many documents each has
        weight = 1 / np.maximum(y.sum(axis=0), 1)
        weight = (y * weight).sum(axis=1, keepdims=True) / max(1, int((y.sum(axis=0) > 0).sum()))
        self.w, self.b = np.zeros((DIMENSIONS, classes), np.float32), np.zeros(classes, np.float32)
        for _ in range(rounds if rows else 0):
            p = self._softmax(x @ self.w + self.b)
            g = (p - y) * weight
            self.w -= rate * (x.T @ g + shrink * self.w)
            self.b -= rate * g.sum(axis=0)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def posterior(self, text: str) -> np.ndarray:
        return self.posteriors([text])[0]

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """A row for each text: its words' weights are added up for many texts at once."""
        z = np.tile(self.b, (len(texts), 1))
        for k in range(0, len(texts), 512):
            found = [features(t) for t in texts[k : k + 512]]
            size = np.array([len(at) for at, _ in found])
            some = np.flatnonzero(size)
            if len(some):
                at, v = (np.concatenate([found[i][j] for i in some]) for j in (0, 1))
                z[k + some] += np.add.reduceat(self.w[at] * v[:, None].astype(np.float32), np.cumsum(size[some]) - size[some])
        return self._softmax(z)


def fit(documents: DataFrame, sources: list[str], sample: int = SAMPLE, odd: bool | None = None) -> Classifier:
    """The classifier, fitted on ``sample`` documents of each source at most, those with the smallest
    hashes. odd: only documents of odd or even hash, for tests on held-out ones."""
    labelled = documents.select("doc_id", "text", normal_source().alias("s")).where(F.col("s").isin(sources) & (F.trim("text") != ""))
    if odd is not None:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == int(odd))
    counts = {r["s"]: r["n"] for r in labelled.groupBy("s").agg(F.count("*").alias("n")).collect()}  # a row per source
    unit = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    below = F.lit(0.0)
    for s, n in counts.items():
        below = F.when(F.col("s") == s, min(1.0, 1.3 * sample / n)).otherwise(below)

    def read(batches):
        for batch in batches:
            found = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in found], pa.list_(pa.float32()))], names=["s", "u", "at", "v"])

    # some 1.3 * sample rows of each source, of DIMENSIONS numbers at most
    rows = labelled.where(unit < below).select("s", unit.alias("u"), "text").mapInArrow(read, "s string, u double, at array<int>, v array<float>").collect()
    per: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["u"]):
        per.setdefault(r["s"], []).append((np.array(r["at"], np.int64), np.array(r["v"], np.float32)))
    chosen = [(x, k) for k, s in enumerate(sources) for x in per.get(s, [])[:sample]]
    return Classifier([x for x, _ in chosen], [k for _, k in chosen], len(sources))


class Mixture:
    """documents: (doc_id, source, tokens, rate, copies) of every document of the sources. shares: a
    dict for each source: ``share`` by label, ``expected_share`` of the fitted rates and ``mixed_share`` of the copies by soft membership.
    settled: whether the fit has met its targets within its rounds."""

    def __init__(self, documents: DataFrame, targets: list[tuple[str, float | None, int | None]], vocabulary: str, size: float | None = None, rounds: int = 25):
        spark = documents.sparkSession
        self.targets = [((s or "").strip().lower(), max(0.0, t or 0.0), max(0, r or 0)) for s, t, r in targets]
        names = [s for s, _, _ in self.targets]
        k = len(names)
        model = spark.sparkContext.broadcast(fit(documents, names))  # DIMENSIONS numbers for each source

        def read(batches):
            e = tokenizer.encoder(vocabulary)
            for batch in batches:
                texts, labels = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), np.int64)
                tokens = [len(x) for x in e.encode(texts)]
                m = model.value.posteriors(texts).astype(np.float64)
                evidence = np.full((len(texts), k), (1 - TRUST) / max(1, k - 1))
                evidence[np.arange(len(texts)), labels] = TRUST
                m = m * evidence
                m /= m.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), *[pa.array(m[:, j], pa.float64()) for j in range(k)]], names=["doc_id", "label", "tokens", *[f"m{j}" for j in range(k)]])

        source = normal_source()
        label = F.coalesce(*[F.when(source == s, j) for j, s in enumerate(names)]).cast("int")
        slim = documents.select("doc_id", "text", label.alias("label")).where("label is not null and text is not null").where(F.col("text").rlike(r"(?U)\S"))
        d = cut(slim.mapInArrow(read, "doc_id bigint, label int, tokens bigint, " + ", ".join(f"m{j} double" for j in range(k))), "mix")
        have = {r["label"]: r["t"] for r in d.groupBy("label").agg(F.sum("tokens").alias("t")).collect()}  # a row per source
        live = [j for j, (_, t, r) in enumerate(self.targets) if t > 0 and r > 0 and have.get(j)]
        whole = sum(self.targets[j][1] for j in live)
        share = {j: self.targets[j][1] / whole for j in live}
        room = {j: self.targets[j][2] * have[j] for j in live}
        largest = min((room[j] / share[j] for j in live), default=0.0)
        self.size = largest if size is None else float(size)
        goal = {j: min(share[j] * self.size, room[j]) for j in live}
        base = [goal[j] / have[j] if j in goal else 0.0 for j in range(k)]
        most = [float(self.targets[j][2]) if j in goal else 0.0 for j in range(k)]
        pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("label") + 1)
        start, top = pick(base), pick(most)
        steps = np.zeros(k)

        def rate(s: np.ndarray) -> Column:
            return F.greatest(F.lit(0.0), F.least(top, start * (1 + sum((F.col(f"m{j}") * float(s[j]) for j in range(k)), F.lit(0.0)))))

        self.expected, self.settled = np.zeros(k), False
        if live and self.size > 0:
            aim = np.array([goal.get(j, 0.0) for j in range(k)])
            for _ in range(rounds):
                t = d.withColumn("w", rate(steps) * F.col("tokens"))
                got = t.agg(*[F.sum(F.col("w") * F.col(f"m{j}")).alias(f"a{j}") for j in range(k)], *[F.sum(start * F.col("tokens") * F.col(f"m{j}") * F.col(f"m{j}")).alias(f"c{j}") for j in range(k)]).first()
                self.expected = np.array([got[f"a{j}"] or 0.0 for j in range(k)])
                curve = np.array([got[f"c{j}"] or 0.0 for j in range(k)])
                gap = aim - self.expected
                if np.abs(gap).max() < 1e-4 * self.size:
                    self.settled = True
                    break
                steps += np.where(curve > 0, gap / np.maximum(curve, 1e-9), 0.0).clip(-0.5, 0.5)
        # whole copies: the same hash each time, and a factor for each source
        u = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
        factor = np.ones(k)

        def copies(f: np.ndarray) -> Column:
            return F.least(top, F.floor(F.least(top, rate(steps) * pick(f)) + u)).cast("int")

        low, high = np.zeros(k), np.full(k, 8.0)
        got = {}
        for _ in range(24 if live and self.size > 0 else 0):
            got = {r["label"]: r["t"] for r in d.groupBy("label").agg(F.sum(copies(factor) * F.col("tokens")).alias("t")).collect()}
            off = [abs((got.get(j) or 0) - goal[j]) / goal[j] for j in live]
            if max(off) < 5e-4:
                break
            for j in live:
                if (got.get(j) or 0) < goal[j]:
                    low[j] = factor[j]
                else:
                    high[j] = factor[j]
                nearer = factor[j] * goal[j] / got[j] if got.get(j) else 2 * factor[j]
                factor[j] = nearer if low[j] < nearer < high[j] and _ < 6 else (low[j] + high[j]) / 2
        name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("label") + 1) if names else F.lit(None).cast("string")
        self.documents = d.select("doc_id", name.alias("source"), "tokens", rate(steps).alias("rate"), copies(factor).alias("copies"))
        self.documents = self.documents.where("copies >= 1")
        used = {r["source"]: r for r in self.documents.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most")).collect()}
        domain = d.select(*[F.sum(copies(factor) * F.col("tokens") * F.col(f"m{j}")).alias(f"a{j}") for j in range(k)]).first() if k else []
        domain = np.array([x or 0.0 for x in domain])
        total = sum(r["tokens"] for r in used.values()) or 1
        self.shares = [
            {"source": s, "target_share": float(self.targets[j][1]), "available_tokens": int(have.get(j) or 0), "documents": used[s]["documents"] if s in used else 0,
             "tokens": int(used[s]["tokens"]) if s in used else 0, "share": used[s]["tokens"] / total if s in used else 0.0, "attainable_share": float(share.get(j, 0.0)),
             "expected_share": float(self.expected[j] / max(self.expected.sum(), 1e-9)), "mixed_share": float(domain[j] / max(domain.sum(), 1e-9)), "most_copies": used[s]["most"] if s in used else 0}
            for j, s in enumerate(names)
        ]
