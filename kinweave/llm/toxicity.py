"""Toxic passages by maximum-scoring segments over token log-odds.

A token is a word (A-Z lower-cased, ASCII punctuation at its ends cut off) or the beginning of one, its first
``SHORTEST`` to 8 bytes. Words are counted in the texts of either label class that hold them, beginnings
in the different words that start so, each split as its texts are. Log-odds have Dirichlet priors: a
beginning's prior is the share of toxic words, a word's prior is the odds of its longest significant
beginning, so inflected forms that no label shows inherit the odds of their stem. A word counts by its own odds
if it was seen and is significant or stands under a significant beginning, else by those of that beginning, and if there is
none it costs ``drift``; significance is the root of the log-likelihood ratio (a z-score for large counts).
A linear-time scan finds all maximal segments of positive score. Under the clean token distribution such
scores follow an extreme-value law: lambda is the root of sum p_w exp(lambda s_w) = 1 and K is fitted to
the clean documents, so a segment of score S in n tokens has the p-value 1 - exp(-K n exp(-lambda S)). A
logistic curve over the document's evidence turns this into a probability.

The classifier is fitted on at most ``max_labelled`` labelled training documents, the first by a hash of
their doc_id; equal texts count once. It is cross-fitted: the labels of ``FOLDS`` - 1 parts give token scores, by
which the remaining part, dealt by its texts, is read; the evidence of all parts together gives the curve, and
the least significance is the one of ``LEAST_Z`` with the smallest loss. Then all labels give the token
scores. Only texts are inputs of a score. Scoring reads all tokens of all documents.

Null texts are empty and get the score of no evidence. Labels that are null are ignored; a doc_id or a text
labelled twice counts as toxic if any label says so. Without labels of both classes in every part every score is
the share of toxic labels (0 without any). Rows that repeat a doc_id, or have none, are scored one by
one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards, words

MAX_LABELLED = 20_000
FOLDS = 3
PRIOR = 1.0
LEAST_Z = (3.0, 4.0, 5.0)
DRIFT = 0.1
SHORTEST, LONGEST = 3, 8
SIGNIFICANT = 1e-3
_ENDS = np.ones(256, bool)  # bytes that a token may start and end with
_ENDS[[c for c in range(128) if not chr(c).isalnum()]] = False


def _tokens(column):
    """For each block: (first row, row word index, word hashes, hashes of beginnings from the longest, starts, ends, bytes).

    A beginning that the word is too short for is 0.
    """
    data, offsets = words.text_buffer(column)
    for i, j in words.blocks(offsets):
        part = words.FOLD[data[offsets[i] : offsets[j]]]
        starts, ends, index = words.word_bounds(part, offsets[i : j + 1] - offsets[i])
        place = np.flatnonzero(_ENDS[part])
        if len(place) and len(starts):
            first = place[np.minimum(np.searchsorted(place, starts), len(place) - 1)]
            last = place[np.maximum(np.searchsorted(place, ends) - 1, 0)] + 1
            solid = (first >= starts) & (last <= ends) & (first < last)
            starts, ends = np.where(solid, first, starts), np.where(solid, last, ends)
        size = ends - starts
        begun = np.zeros((LONGEST - SHORTEST + 1, len(starts)), np.uint64)
        for row, k in enumerate(range(LONGEST, SHORTEST - 1, -1)):
            have = np.flatnonzero(size >= k)
            # one step from the hash of the k-byte word, so that a beginning isn't taken for a word
            begun[row, have] = words.mix(words.word_hashes(part, starts[have], starts[have] + k) + np.uint64(k))
        yield i, index, words.word_hashes(part, starts, ends), begun, starts, ends, part


@dataclass
class Table:
    """Sorted hashes, with scores and significances beside them."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    z: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each hash is here, its place)."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[at] == h, at

    def least(self, z: float) -> Table:
        keep = self.z >= z
        return Table(self.hashes[keep], self.scores[keep], self.z[keep])


@dataclass
class Model:
    """Scores of words and of beginnings; a word's z is that of its longest significant beginning if that is greater."""

    words: Table = field(default_factory=Table)
    begun: Table = field(default_factory=Table)
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 0.1
    curve: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0, 0, 0]))

    def least(self, z: float) -> Model:
        return replace(self, words=self.words.least(z), begun=self.begun.least(z), curve=self.curve.copy())

    def of(self, hashes: np.ndarray, begun: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -self.drift)
        hit, at = self.words.find(hashes)
        out[hit] = self.words.scores[at[hit]]
        left = np.flatnonzero(~hit)
        for row in begun if len(self.begun.hashes) else ():
            hit, at = self.begun.find(row[left])
            out[left[hit]] = self.begun.scores[at[hit]]
            left = left[~hit]
        return out

    def p_value(self, score, n):
        return -np.expm1(-self.k * np.maximum(n, 1) * np.exp(-self.lam * np.asarray(score, float)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.curve[0] + x @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time; only the positive tokens are walked."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.append(0.0, np.cumsum(scores))
    stack: list[tuple[float, float, int, int]] = []  # (sum before, sum after, start, end)
    links: list[int] = []  # for each candidate, the nearest earlier one with a smaller sum before it; -1 if none
    for i in up.tolist():
        low, high, start = total[i], total[i + 1], i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = links[j]
            if j < 0 or stack[j][1] >= high:
                break
            low, start = stack[j][0], stack[j][2]
            del stack[j:], links[j:]
        stack.append((low, high, start, i + 1))
        links.append(j)
    return [(a, b, high - low) for low, high, a, b in stack]


def _evidence(model: Model, column):
    """For each row: (n tokens, best score, evidence row, significant segments as word ranges, token scores)."""
    for i, index, h, begun, *_ in _tokens(column):
        s = model.of(h, begun)
        whole = np.append(0, np.cumsum(s > 0))
        for r in range(len(index) - 1):
            a, b = index[r], index[r + 1]
            n = int(b - a)
            if whole[a] == whole[b]:
                yield i + r, n, 0.0, (0.0, 0.0, 0.0), [], s[a:b]
                continue
            found = segments(s[a:b])
            score = np.array([x for _, _, x in found])
            best = float(score.max())
            p = np.maximum(model.p_value(score, n), 1e-300)
            keep = [(*found[j], float(p[j])) for j in np.flatnonzero(p <= SIGNIFICANT).tolist()]
            logs = -float(np.log10([x[3] for x in keep]).sum())
            yield i + r, n, best, (min(-float(np.log10(p.min())), 40.0), np.sqrt(min(logs, 400.0)), best / np.sqrt(n + 1.0)), keep, s[a:b]


def _training(table: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).filter(~held_out("_id"))
    # bounded by its limit, and so small enough for a broadcast
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    docs = shards.documents(table).withColumn("text", F.coalesce("text", F.lit("")))
    rows = docs.join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy(F.sha2("text", 256).alias("mark")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    return shards.checkpointed(rows.select("text", F.least("toxic", F.lit(1)).alias("toxic"), F.pmod(F.xxhash64("mark"), F.lit(FOLDS)).cast("int").alias("fold")))


def held_out(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


_COUNTED = [f"n{fold}_{toxic}" for fold in range(FOLDS) for toxic in (1, 0)]


def _counts(batches):
    """In how many texts of each part and class a word stands: one text that repeats it is one witness."""
    for batch in batches:
        kind = batch.column("fold").to_numpy() * 2 + (batch.column("toxic").to_numpy() == 0)
        for i, index, h, begun, *_ in _tokens(batch.column("text")):
            row = np.repeat(np.arange(len(index) - 1), np.diff(index))
            order = np.lexsort((row, h))
            token, row = h[order], row[order]
            once = shards.runs(token, row)
            first = shards.runs(token[once])
            if not len(first):
                continue
            cells = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(once)))) * (2 * FOLDS) + kind[i + row[once]]
            n = np.bincount(cells, minlength=len(first) * 2 * FOLDS).reshape(len(first), -1)
            at = order[once[first]]
            yield words.plain(["token", *_BEGUN, *_COUNTED], [h[at].view(np.int64), *begun[:, at].view(np.int64), *n.T.astype(np.int64)])


_BEGUN = [f"b{k}" for k in range(LONGEST, SHORTEST - 1, -1)]


def _without(model: int, toxic: int) -> list[str]:
    """The counts of a class that a model is fitted on: those of all parts but its own, or all (model FOLDS)."""
    return [f"n{fold}_{toxic}" for fold in range(FOLDS) if fold != model]


def _odds(bad, good, n1: float, n0: float, share) -> np.ndarray:
    return np.clip(np.log((bad + PRIOR * share) / n1) - np.log((good + PRIOR * (1 - share)) / n0), -4, 8)


def _significance(bad, good, n1: float, n0: float) -> np.ndarray:
    """Root of the log-likelihood ratio that a token's share differs between the classes."""

    def part(x, expected):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / expected), 0.0)

    both = bad + good
    return np.sqrt(2 * np.maximum(part(bad, both * n1 / (n1 + n0)) + part(good, both * n0 / (n1 + n0)), 0))


def _tables(counts: DataFrame) -> list[Model] | None:
    """The token scores without each part, and of all parts; None where a class has no token."""
    every = range(FOLDS + 1)
    bad = {m: sum(F.col(c) for c in _without(m, 1)) for m in every}
    good = {m: sum(F.col(c) for c in _without(m, 0)) for m in every}
    total = counts.agg(*[F.sum(x[m]).alias(f"{y}{m}") for m in every for x, y in ((bad, "bad"), (good, "good"))]).first()
    if not all(total):
        return None
    # each word is one witness for its beginnings, split as its texts are
    shares = [(x[m] / F.greatest(bad[m] + good[m], F.lit(1))).alias(f"{y}{m}") for m in every for x, y in ((bad, "bad"), (good, "good"))]
    begun = counts.select(F.explode(F.array(*_BEGUN)).alias("token"), *shares).filter("token != 0")
    sums = [F.sum(f"{y}{m}").alias(f"{y}{m}") for m in every for y in ("bad", "good")]
    whole = counts.select(*shares).agg(*sums).first()
    begun = begun.groupBy("token").agg(*sums)

    def stems(batches):
        for batch in batches:
            for m in every:
                b, g = batch.column(f"bad{m}").to_numpy(), batch.column(f"good{m}").to_numpy()
                n1, n0 = whole[f"bad{m}"], whole[f"good{m}"]
                z = _significance(b, g, n1, n0)
                keep = z >= min(LEAST_Z)
                score = _odds(b, g, n1, n0, n1 / (n1 + n0))
                yield words.plain(["model", "token", "score", "z"], [np.full(int(keep.sum()), m), batch.column("token").to_numpy()[keep], score[keep], z[keep]])

    kept = "model long, token long, score double, z double"
    models = [Model(begun=t) for t in _collected(begun.mapInArrow(stems, kept))]

    def whole_words(batches):
        for batch in batches:
            n = {c: batch.column(c).to_numpy().astype(float) for c in _COUNTED}
            token, starts = batch.column("token").to_numpy(), [batch.column(c).to_numpy().view(np.uint64) for c in _BEGUN]
            for m in every:
                b, g = sum(n[c] for c in _without(m, 1)), sum(n[c] for c in _without(m, 0))
                n1, n0 = float(total[f"bad{m}"]), float(total[f"good{m}"])
                stem, above = np.zeros(len(token)), np.zeros(len(token))
                for row in reversed(starts):  # the longest comes last and stays
                    hit, at = models[m].begun.find(row)
                    stem[hit], above[hit] = models[m].begun.scores[at[hit]], models[m].begun.z[at[hit]]
                z = np.maximum(_significance(b, g, n1, n0), above)
                keep = (z >= min(LEAST_Z)) & (b + g > 0)
                score = _odds(b, g, n1, n0, 1 / (1 + np.exp(-stem) * n0 / n1))
                yield words.plain(["model", "token", "score", "z"], [np.full(int(keep.sum()), m), token[keep], score[keep], z[keep]])

    for model, t in zip(models, _collected(counts.mapInArrow(whole_words, kept)), strict=True):
        model.words = t
    return models


def _collected(rows: DataFrame) -> list[Table]:
    """The tokens that count, by model: no more than the bounded sample of texts holds."""
    got = rows.toPandas().assign(token=lambda d: d["token"].to_numpy(np.int64).view(np.uint64)).sort_values("token")
    parts = [got[got["model"] == m] for m in range(FOLDS + 1)]
    return [Table(p["token"].to_numpy(np.uint64), p["score"].to_numpy(float), p["z"].to_numpy(float)) for p in parts]


_BINS = np.append(np.arange(-4, 8, 0.25), 8.0)


def _read(models: dict, every: bool):
    """Reads each text by the model of its part, for each significance: by row, or (not every) what the extreme-value law needs of clean rows."""

    def run(batches):
        for batch in batches:
            for (fold, which), model in models.items():
                own = batch.filter(pa.array(batch.column("fold").to_numpy() == fold))
                if not every:
                    own = own.filter(pa.array(own.column("toxic").to_numpy() == 0))
                found = list(_evidence(model, own.column("text")))
                if every:
                    columns = np.array([x[3] for x in found], float).reshape(-1, 3).T
                    yield words.plain(["which", "toxic", "a", "b", "c"], [np.full(len(own), which), own.column("toxic"), *columns])
                elif found:
                    drift = np.concatenate([x[5] for x in found])
                    share = np.bincount(np.rint((np.clip(drift, -4, 8) + 4) * 4).astype(int), minlength=len(_BINS))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([fold] * len(found)), pa.array([which] * len(found)), pa.array([x[1] for x in found]), pa.array([x[2] for x in found]), pa.array([share.tolist()] + [None] * (len(found) - 1), pa.list_(pa.int64()))],
                        ["fold", "which", "n", "best", "bins"],
                    )

    return run


def _lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(x s) = 1 over the clean tokens' scores."""
    if not (s[p > 0] > 0).any() or p @ s >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while p @ np.exp(high * s) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * s) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * np.append(0, w[1:])
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(np.append(1e-9, np.full(len(w) - 1, ridge)))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _law(model: Model, clean) -> None:
    """Fits lambda and K to clean rows that the model wasn't fitted on: their token scores and best segments."""
    bins = np.sum([x for x in clean["bins"] if x is not None], axis=0) if len(clean) else np.zeros(len(_BINS))
    if not np.sum(bins):
        return
    middle = np.where(_BINS == np.rint(-model.drift * 4) / 4, -model.drift, _BINS)
    model.lam = _lambda(bins / bins.sum(), middle)
    level = float(np.quantile(clean["best"], 0.95))
    level = level if level > 0 else float(model.words.scores.max(initial=1.0))
    above = max(0.5, float((clean["best"] >= level).sum()))
    model.k = float(np.clip(above / max(1.0, clean["n"].sum()) * np.exp(model.lam * level), 1e-12, 10))


def fit(table: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    rows = _training(table, labels, max_labelled)
    classes = {(r["fold"], r["toxic"] > 0): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    model = Model()
    bad, every = sum(n for (_, t), n in classes.items() if t), sum(classes.values())
    schema = ", ".join(f"{c} long" for c in ["token", *_BEGUN, *_COUNTED])
    models = None
    if all(classes.get((f, t)) for f in range(FOLDS) for t in (False, True)):
        counts = rows.mapInArrow(_counts, schema).groupBy("token", *_BEGUN).agg(*[F.sum(c).alias(c) for c in _COUNTED])
        models = _tables(shards.checkpointed(counts))
    if not models:
        share = bad / every if every else 0.0
        model.curve[0] = np.log(max(share, 1e-13) / max(1 - share, 1e-13))
        return model
    apart = {(fold, which): models[fold].least(z) for fold in range(FOLDS) for which, z in enumerate(LEAST_Z)}
    clean = rows.mapInArrow(_read(apart, False), "fold long, which long, n long, best double, bins array<long>").toPandas()  # at most max_labelled rows
    for (fold, which), m in apart.items():
        _law(m, clean[(clean["fold"] == fold) & (clean["which"] == which)])
    seen = rows.mapInArrow(_read(apart, True), "which long, toxic int, a double, b double, c double").toPandas()
    best = np.inf
    for which, z in enumerate(LEAST_Z):
        own = seen[seen["which"] == which]
        x, y = own[["a", "b", "c"]].to_numpy(float), own["toxic"].to_numpy(float)
        trial = models[FOLDS].least(z)
        trial.curve = _logistic(x, y)
        p = np.clip(trial.probability(x), 1e-9, 1 - 1e-9)
        loss = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if loss < best:
            best, model = loss, trial
            # the law of the final model is that of clean rows read by models without them
            model.lam = float(np.median([apart[f, which].lam for f in range(FOLDS)]))
            model.k = float(np.median([apart[f, which].k for f in range(FOLDS)]))
    return model


def _score(model: Model):
    def run(batches):
        for batch in batches:
            rows = list(_evidence(model, batch.column("text")))
            p = model.probability(np.array([x[3] for x in rows], float).reshape(-1, 3))
            yield words.plain(["doc_id", "score", "segments"], [batch.column("doc_id"), p, np.array([len(x[4]) for x in rows], np.int32)])

    return run


def score(table: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, segments (number of significant ones) of every row."""
    docs = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.mapInArrow(_score(model), "doc_id long, score double, segments int")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "segments")


def passages(table: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, start and end byte in the UTF-8 text, passage, score, p_value."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                column = pa.array([text or ""])
                for *_, starts, ends, _ in _tokens(column):
                    for *_, keep, _ in _evidence(model, column):
                        out += [(doc, int(starts[a]), int(ends[b - 1]), raw[starts[a] : ends[b - 1]].decode(), x, p) for a, b, x, p in keep]
            names = ["doc_id", "start", "end", "passage", "score", "p_value"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    docs = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, start long, end long, passage string, score double, p_value double")


def clean_documents(table: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the table that aren't predicted toxic, with all columns, in one pass over the table."""
    model = fit(table, labels)

    def run(batches):
        for batch in batches:
            rows = list(_evidence(model, batch.column("text")))
            p = model.probability(np.array([x[3] for x in rows], float).reshape(-1, 3))
            yield batch.filter(pa.array(p < 0.5))

    return table.mapInArrow(run, table.schema)
