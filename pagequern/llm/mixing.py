"""Problem 9: mixing sources to target weights by soft membership.

1. A softmax classifier over hashed tokens of a public tokenizer and layout marks
   is fitted on at most FIT_ROWS labelled documents, chosen by a hash of the id.
2. One pass over the text counts the tokens of every document and gives it a
   posterior over the domains (the listed sources), rounded to GRAIN-ths so that
   equal posteriors meet.  The posterior is that of the text; the label does not
   overwrite it.
3. Projected-gradient least squares fits document rates 0 <= r <= max_repeat.  Each
   document belongs to the domains by its posterior and to its source by its label;
   the expected token totals of all domains and the token totals of all sources are
   to meet the targets, the latter with weight LABEL_WEIGHT, for the shares asked
   for are those of sources.  A step is the gradient in the metric of the Gram
   matrix of documents that can still move; rates are projected to [0, cap] after
   it.  The matrix has two rows a source and takes one aggregation an iteration.
4. Rates become whole copies: the integer part for all, one more by sequential
   Poisson sampling: documents in the order of hash / fraction until the source's
   tokens are reached.  The running totals are cut into buckets, so no task holds a
   whole source.

A document without a listed source has a posterior too (``posteriors``) but no
target, and is not drawn.  The total is the largest for which every source that
has documents can meet its target within its cap, unless ``total_tokens`` is given.
A listed source without documents reaches 0; the others share its part in proportion.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

FIT_ROWS = 10_000
DIMENSIONS = 512  # hashed tokens
GRAIN = 32
BUCKETS = 512
ITERATIONS = 30
TOLERANCE = 1e-3
LABEL_WEIGHT = 10.0
DAMPING = 1e-3
MOST_SOURCES = 1_000  # rows of the recipe, which are collected and sent to all executors
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Layout marks whose frequency tells export styles apart.
MARKS = ["In [", "Out[", "# %%", "\n# ", "# Out:", "```", "In [ ]", "\n\n", "    ", "<ipython", "%%", "# %% [markdown]"]

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, once a process."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def source_name(c):
    """Letter case and outer spaces of a source name do not matter; blank is null."""
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(F.length(s) > 0, s)


def features(text: str, ids: list[int]) -> np.ndarray:
    """Hashed token counts (logarithms, of length 1 together) and rates of layout marks."""
    x = np.zeros(DIMENSIONS + len(MARKS) + 1, np.float32)
    if ids:
        v = np.log1p(np.bincount(np.array(ids, np.int64) * 40503 % DIMENSIONS, minlength=DIMENSIONS))
        x[:DIMENSIONS] = v / max(1e-9, float(np.sqrt((v * v).sum())))
    k = 100.0 / (len(text) + 200)
    x[DIMENSIONS:-1] = [min(2.0, text.count(m) * k) for m in MARKS]
    x[-1] = np.log1p(len(text)) / 10
    return x


class Softmax:
    """Multinomial logistic regression by accelerated full-batch gradient steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int, steps: int = 150, decay: float = 3e-3):
        self.mean, self.sd = x.mean(0), x.std(0) + np.float32(1e-3)
        z = self._z(x)
        # the largest curvature bounds the step: power iterations on z'z
        v = np.ones(z.shape[1], np.float32)
        for _ in range(8):
            v = z.T @ (z @ v)
            v /= np.linalg.norm(v)
        rate = 1.0 / (0.5 * float(v @ (z.T @ (z @ v))) / len(z) + decay)
        goal = np.eye(k, dtype=np.float32)[y]
        self.w = w = np.zeros((z.shape[1], k), np.float32)
        for i in range(steps):
            ahead = self.w + i / (i + 3) * (self.w - w)
            w = self.w
            self.w = (ahead - rate * (z.T @ (self._softmax(z @ ahead) - goal) / len(z) + decay * ahead)).astype(np.float32)

    def _z(self, x):
        return np.hstack([np.clip((x - self.mean) / self.sd, -5, 5), np.ones((len(x), 1), np.float32)]).astype(np.float32)

    @staticmethod
    def _softmax(s):
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(self._z(x) @ self.w)


class Uniform:
    """Stands for a classifier where there is no labelled document."""

    def __init__(self, k: int):
        self.k = k

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full((len(x), self.k), 1.0 / max(1, self.k))


def rounded(p: np.ndarray) -> np.ndarray:
    """Posteriors as GRAIN-ths that still sum to GRAIN (largest remainders)."""
    if not p.size:
        return np.zeros(p.shape, np.int64)
    x = p.astype(float) * GRAIN
    low = np.floor(x)
    short = np.rint(GRAIN - low.sum(1)).astype(int)
    rank = np.argsort(np.argsort(-(x - low), axis=1, kind="stable"), axis=1, kind="stable")
    return (low + (rank < short[:, None])).astype(np.int64)


def classifier(documents: DataFrame, sources: list[str], tokenizer: str = TOKENIZER, fit_rows: int = FIT_ROWS):
    """The classifier fitted on about fit_rows labelled documents (doc_id, src, text), chosen by a hash of the id."""
    known = documents.where(F.col("src").isin(sources)) if sources else documents.limit(0)
    share = fit_rows / max(1, known.count()) if sources else 0.0  # counts without reading a text
    chosen = known if share >= 1 else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            x = [features(t or "", enc.encode_ordinary(t or "")).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("src"), pa.array(x, pa.binary())], names=["src", "x"])

    sample = chosen.select("src", "text").mapInArrow(run, "src string, x binary").collect() if sources else []  # about fit_rows rows of 1 KB
    if not sample:
        return Uniform(len(sources))
    index = {s: i for i, s in enumerate(sources)}
    x = np.stack([np.frombuffer(r.x, np.float16) for r in sample]).astype(np.float32)
    return Softmax(x, np.array([index[r.src] for r in sample]), len(sources))


def posteriors(documents: DataFrame, sources: list[str], model, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, src (normalised source), tokens and posterior (GRAIN-ths, in the order of sources) of every document."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            tokens, x = [], []
            for t in b.column("text").to_pylist():
                ids = enc.encode_ordinary(t or "")
                tokens.append(len(ids))
                x.append(features(t or "", ids))
            p = rounded(model.predict(np.stack(x))) if x else np.zeros((0, len(sources)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("src"), pa.array(tokens, pa.int64()), pa.array(p.tolist(), pa.list_(pa.int16()))], names=["doc_id", "src", "tokens", "posterior"]
            )

    return documents.mapInArrow(run, "doc_id long, src string, tokens long, posterior array<short>")


class Rates:
    """Rates as a function of posterior, source and cap: steps taken so far, each followed by its projection.

    Nothing is written between iterations; a rate is folded anew from the steps.
    """

    def __init__(self, sources: list[str]):
        self.k = len(sources)
        self.index = {s: i for i, s in enumerate(sources)}
        self.steps: list[np.ndarray] = []

    def membership(self, posterior, src) -> np.ndarray:
        """Rows over 2k columns: posterior, then the label."""
        m = np.zeros((len(src), 2 * self.k))
        if len(src):
            m[:, : self.k] = np.asarray(posterior, float).reshape(len(src), self.k) / GRAIN
            m[np.arange(len(src)), [self.k + self.index[s] for s in src]] = 1.0
        return m

    def __call__(self, m: np.ndarray, cap: np.ndarray) -> np.ndarray:
        r = np.zeros(len(m))
        for s in self.steps:
            r = np.clip(r + m @ s, 0.0, cap)
        return r

    def _sum(self, groups: DataFrame, size: int, part) -> np.ndarray:
        """Sum over all groups of part(membership, rates, caps, tokens), a vector of ``size`` numbers."""
        rates = self

        def run(batches):
            x = np.zeros(size)
            for b in batches:
                m = rates.membership(b.column("posterior").to_pylist(), b.column("src").to_pylist())
                cap = b.column("cap").to_numpy(zero_copy_only=False).astype(float)
                x += part(m, rates(m, cap), cap, b.column("tokens").to_numpy(zero_copy_only=False)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64()))], names=["x"])

        out = np.zeros(size)
        for row in groups.mapInArrow(run, "x array<double>").select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[row.i] = row.v
        return out

    def fit(self, groups: DataFrame, goals: np.ndarray, mass: np.ndarray, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> None:
        """groups: posterior, src, cap, tokens.  goals, mass: token totals wanted and present of the sources.

        The first step gives every source its own rate; the others are least-squares
        steps, halved as long as they make the misses larger.
        """
        k2 = 2 * self.k
        want = np.concatenate([goals, goals])
        scale = np.where(want > 0, want, max(goals.sum(), 1.0))  # what has no target counts by the total
        weight = np.concatenate([np.ones(self.k), np.full(self.k, LABEL_WEIGHT)]) / scale
        self.steps.append(np.concatenate([np.zeros(self.k), goals / np.maximum(mass, 1.0)]))
        best, halved = np.inf, 0
        for _ in range(iterations):
            got = self._sum(groups, k2, lambda m, r, cap, t: m.T @ (t * r))
            miss = (want - got) * weight
            if (now := float(miss @ miss)) > best * (1 - tolerance):
                if halved == 3 or now == best:
                    self.steps.pop()
                    break
                self.steps[-1] = self.steps[-1] / 2
                halved += 1
                continue
            best, halved = now, 0
            if now < tolerance**2:
                break
            up = miss * weight  # the way the gradient pushes a document: membership @ up

            def gram(m, r, cap, t, up=up):
                free = np.where(m @ up > 0, r < cap, r > 0)  # those that can still move that way
                return (m[free] * t[free, None]).T @ m[free]

            a = weight[:, None] * self._sum(groups, k2 * k2, gram).reshape(k2, k2)
            ridge = DAMPING * np.linalg.norm(a, 2) * np.eye(k2)
            self.steps.append(np.linalg.lstsq(np.vstack([a, ridge]), np.concatenate([miss, np.zeros(k2)]), rcond=None)[0])


class Mixture:
    """documents: doc_id, source, text; targets: source, target_share, max_repeat.

    ``documents`` has one row per document drawn (doc_id, source, tokens, the domain
    of the largest posterior and its confidence, rate, copies >= 1); ``shares`` one
    row per listed source with the share its documents reach and the share expected
    by posteriors.  Null, blank or unlisted sources are not drawn; null or empty
    texts have 0 tokens and are not drawn; targets with null, blank or repeated names
    keep their first share by name; a recipe of more than MOST_SOURCES sources is an error.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, model=None):
        t = targets.select(source_name(F.col("source")).alias("src"), F.col("target_share").cast("double").alias("share"), F.greatest(F.lit(0), F.coalesce(F.col("max_repeat").cast("int"), F.lit(1))).alias("cap"))
        t = t.where("src IS NOT NULL AND share > 0").groupBy("src").agg(F.max("share").alias("share"), F.max("cap").alias("cap"))
        rows = sorted(t.limit(MOST_SOURCES + 1).collect())
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources have a target")
        self.sources = [r.src for r in rows]
        self.table = targets.sparkSession.createDataFrame(rows, t.schema)
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("src"), "text")
        self.model = model or classifier(docs, self.sources, tokenizer)
        self.scored = cut(posteriors(docs, self.sources, self.model, tokenizer))
        self.members = self.scored.where(F.col("tokens") > 0).join(F.broadcast(self.table.select("src", "cap")), "src")  # at most MOST_SOURCES rows
        groups = cut(self.members.groupBy("posterior", "src", "cap").agg(F.sum("tokens").cast("double").alias("tokens")))
        have = {r.src: r.n for r in groups.groupBy("src").agg(F.sum("tokens").alias("n")).collect()}
        share = np.array([r.share if have.get(r.src) and r.cap > 0 else 0.0 for r in rows])
        room = [r.cap * have[r.src] / s for r, s in zip(rows, share / max(share.sum(), 1e-12)) if s > 0]
        self.total = float(total_tokens if total_tokens is not None else min(room, default=0.0))
        self.goals = share / max(share.sum(), 1e-12) * self.total
        self.rates = Rates(self.sources)
        if share.any():
            self.rates.fit(groups, self.goals, np.array([float(have.get(s, 0)) for s in self.sources]))

    def _rated(self) -> DataFrame:
        rates, sources = self.rates, self.sources

        def run(batches):
            for b in batches:
                post = b.column("posterior").to_pylist()
                p = np.asarray(post, float).reshape(b.num_rows, len(sources)) / GRAIN
                r = rates(rates.membership(post, b.column("src").to_pylist()), b.column("cap").to_numpy(zero_copy_only=False).astype(float))
                best = p.argmax(1) if p.size else np.zeros(b.num_rows, int)
                extra = [pa.array([sources[i] for i in best], pa.string()), pa.array(p.max(1) if p.size else []), pa.array(np.round(r, 6))]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "domain", "confidence", "rate"])

        m = self.members.select("doc_id", "src", "tokens", "cap", "posterior")
        return m.mapInArrow(run, "doc_id long, src string, tokens long, cap int, posterior array<short>, domain string, confidence double, rate double")

    def _drawn(self) -> DataFrame:
        """Documents with their copies, at least one."""
        rated = self._rated().withColumn("h", F.xxhash64("doc_id")).withColumn("whole", F.floor("rate"))
        rated = rated.withColumn("part", F.col("rate") - F.col("whole"))
        u = (F.pmod(F.shiftrightunsigned("h", 11), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        # order of drawing: hash over fraction; the far ones, which are hardly reached, by hash alone
        rated = rated.withColumn("u", u).withColumn("key", F.when((F.col("part") > 0) & (F.col("u") < 2 * F.col("part")), F.col("u") / F.col("part")).otherwise(2 + F.col("u")))
        rated = rated.withColumn("bucket", F.floor(F.col("key") * (BUCKETS / 3)).cast("int"))
        loose = F.when((F.col("part") > 0) & (F.col("whole") < F.col("cap")), F.col("tokens")).otherwise(0)
        rated = rated.withColumn("loose", loose)
        goals = self.table.sparkSession.createDataFrame([(s, float(g)) for s, g in zip(self.sources, self.goals)], "src string, goal double")
        sums = rated.groupBy("src", "bucket").agg(F.sum("loose").alias("n"), F.sum(F.col("whole") * F.col("tokens")).alias("given"))  # at most MOST_SOURCES * BUCKETS rows
        w = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("given", F.sum("given").over(Window.partitionBy("src"))).join(F.broadcast(goals), "src")
        rated = rated.join(F.broadcast(sums.select("src", "bucket", "before", (F.col("goal") - F.col("given")).alias("need"))), ["src", "bucket"])
        inner = Window.partitionBy("src", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = F.col("before") + F.sum("loose").over(inner) - F.col("loose") / 2
        extra = F.when((F.col("loose") > 0) & (upto <= F.col("need")), 1).otherwise(0)
        return rated.withColumn("copies", F.least(F.col("cap"), F.col("whole") + extra).cast("int")).where("copies > 0")

    def documents(self) -> DataFrame:
        return self._drawn().select("doc_id", F.col("src").alias("source"), "tokens", "domain", F.round("confidence", 6).alias("confidence"), "rate", "copies")

    def posteriors(self) -> DataFrame:
        """doc_id, source, domain and posterior (array in the order of ``sources``) of every document, drawn or not."""
        names = F.array(*[F.lit(s) for s in self.sources]) if self.sources else F.array().cast("array<string>")
        p = F.transform("posterior", lambda x: x / float(GRAIN))
        return self.scored.select("doc_id", F.col("src").alias("source"), F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1).alias("domain"), p.alias("posterior"))

    def shares(self) -> DataFrame:
        drawn = cut(self._drawn().select("src", "tokens", "copies", "posterior"))
        by_label = drawn.groupBy("src").agg(F.count("*").alias("documents"), F.sum(F.col("copies").cast("long")).alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
        by_domain = drawn.select(F.posexplode("posterior").alias("i", "p"), (F.col("tokens") * F.col("copies")).alias("n")).groupBy("i").agg((F.sum(F.col("n") * F.col("p")) / GRAIN).alias("expected"))
        at = self.table.sparkSession.createDataFrame(list(enumerate(self.sources)), "i int, src string")
        out = self.table.join(by_label, "src", "left").join(at.join(by_domain, "i", "left").drop("i"), "src", "left").select(
            F.col("src").alias("source"), F.col("share").alias("target_share"), F.col("cap").alias("max_repeat"),
            *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("documents", "copies", "most_copies", "tokens")], F.coalesce("expected", F.lit(0.0)).alias("expected"),
        )
        everything = F.greatest(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(1))  # one row a source
        return out.withColumn("reached_share", F.round(F.col("tokens") / everything, 6)).withColumn("expected_share", F.round(F.col("expected") / everything, 6)).drop("expected")
