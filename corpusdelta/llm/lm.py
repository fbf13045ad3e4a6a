"""Language-model scores by a log-bilinear model (operator 8).

Tokens: ASCII letters lower-cased, words split at ASCII white space, then one
end token for each document. Counts of all training tokens are made on the
cluster. The ``CLASSES`` most frequent words, the end and one class for all
other words are predicted by a log-bilinear network: the two classes before a
token are embedded, each by its own matrix, and their sum is multiplied with
the target embeddings. It is trained in numpy by noise-contrastive estimation on all
training positions: it starts from places of ``FIT_DOCS`` documents, and then
every share of about ``SHARE`` positions goes on from the network as it is, on the
cluster, and the means of the parameters, by positions, are the next network
(``ROUNDS`` times, each with its own part of the documents). In scoring, matrix products give the
logits of all classes after each pair of classes that occurs, hence normalised
log-probabilities. Within the class of other words a word has the add-one share
of its training count, so the score is the log10 probability of the whole text.

Scale: the counts stay on the cluster. Words of the highest count bands, at most
``HOT`` of them, are broadcast with their counts; all other words of a document
are joined with the counts by word (each is rare, so no key is hot).

Defined cases: a null text is the empty text (the end token alone); without
training tokens all counts are zero; rows of equal id and text are scored alike
and all returned; a null id is an id; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdelta.llm.quality import fold
from corpusdelta.llm.shared import scratch_path

#: Bounds of what is broadcast: words with counts, word classes; of the start:
#: documents, places of each; words a task counts at a time.
HOT, CLASSES, FIT_DOCS, FIT_PLACES, COUNTED = 1 << 17, 1022, 2000, 128, 400_000
DIM, NOISE, EPOCHS, BATCH, RATE = 24, 8, 3, 1024, 0.15
#: The passes over all positions: rounds, positions of a share, about, and of a
#: step, noise words that the positions of a step have in common, rate.
ROUNDS, SHARE, STEP, COMMON, GO_RATE = 2, 1 << 21, 1024, 64, 0.05
#: Networks that one task adds up.
ADDED = 8
OTHER, END = 0, 1
#: The end token's key in the counts; no word holds white space.
END_WORD = "\n"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def token_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c) of all tokens, each document's end included."""
    def run(batches):
        seen: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(words(t))
                if len(seen) > COUNTED:
                    yield flush()
                    seen.clear()
            seen[END_WORD.encode()] += b.num_rows
        if seen:
            yield flush()

    return (docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "word string, c long")
            .groupBy("word").agg(F.sum("c").alias("c")))


def _band():
    """Sixteen bands of counts for each power of two."""
    return F.floor(F.log2("c") * 16)


def _hot(counts: DataFrame, limit: int) -> int:
    """The lowest band that can be broadcast with all higher ones."""
    kept, least = 0, 1 << 30
    for band, n in sorted(((r[0], r[1]) for r in counts.groupBy(_band()).count().collect()), reverse=True):  # 16 bands a power of two
        kept += n
        if kept > limit:
            break
        least = band
    return least


class LogBilinear:
    """The network over classes; ``unigram`` are class counts."""

    def __init__(self, unigram: np.ndarray, places: np.ndarray, seed: int = 11):
        """places: rows of (class before last, class before, target)."""
        rng = np.random.default_rng(seed)
        n = len(unigram)
        p = (unigram + 1) / (unigram.sum() + n)
        self.context = rng.normal(0, 0.1, (n, DIM))
        self.matrix = [np.eye(DIM) * 0.5 + rng.normal(0, 0.02, (DIM, DIM)) for _ in range(2)]
        self.target = rng.normal(0, 0.1, (n, DIM))
        self.bias, self.p = np.log(p), p
        self._train(places, p, rng)
        self._ready()

    def _ready(self) -> None:
        self.logits = [(self.context @ m @ self.target.T).astype(np.float32) for m in self.matrix]
        self.scored_bias = self.bias.astype(np.float32)
        self.normaliser = None

    @property
    def params(self) -> list[np.ndarray]:
        return [self.context, self.target, self.bias, *self.matrix]

    def _train(self, places: np.ndarray, p: np.ndarray, rng) -> None:
        """Noise-contrastive estimation: tell each target from ``NOISE`` words
        of the unigram distribution. AdaGrad steps on mean gradients."""
        cdf, expected = np.cumsum(p), np.log(NOISE * p)
        params = self.params
        self.sums = sums = [np.full_like(x, 1e-2) for x in params]
        for _ in range(EPOCHS):
            rng.shuffle(places)
            for k in range(0, len(places), BATCH):
                far, near, true = places[k:k + BATCH].T
                m = len(true)
                noise = np.minimum(np.searchsorted(cdf, rng.random((m, NOISE))), len(p) - 1)
                w = np.concatenate([true[:, None], noise], axis=1)
                rows = [self.context[far], self.context[near]]
                guess = rows[0] @ self.matrix[0] + rows[1] @ self.matrix[1]
                vectors = self.target[w]
                delta = np.einsum("md,mwd->mw", guess, vectors) + self.bias[w] - expected[w]
                error = 1 / (1 + np.exp(-np.clip(delta, -30, 30)))
                error[:, 0] -= 1
                error /= m
                back = np.einsum("mw,mwd->md", error, vectors)
                flat = w.ravel()
                grads = [np.zeros_like(self.context), np.zeros_like(self.target), np.bincount(flat, error.ravel(), len(p))]
                for rows_at, matrix in ((far, self.matrix[0]), (near, self.matrix[1])):
                    _scatter(grads[0], rows_at, back @ matrix.T)
                _scatter(grads[1], flat, (error[:, :, None] * guess[:, None, :]).reshape(-1, DIM))
                grads += [r.T @ back for r in rows]
                for x, g, s in zip(params, grads, sums):
                    g *= m  # sums of a batch, so rare rows move too
                    s += g * g
                    x -= RATE * g / np.sqrt(s)

    def gone_on(self, far: np.ndarray, near: np.ndarray, true: np.ndarray, rng) -> np.ndarray:
        """All parameters after one pass over the places, in this order, from
        the network as it is, which stays. The same estimation in steps
        of ``STEP`` places, with ``COMMON`` noise words for all places of a step, drawn at even
        distances of the cumulated distribution."""
        context, target, bias, *matrix = params = [x.astype(np.float32) for x in self.params]
        sums = [x.astype(np.float32) for x in self.sums]
        cdf, expected = np.cumsum(self.p), np.log(COMMON * self.p).astype(np.float32)
        for k in range(0, len(true), STEP):
            at = [x[k:k + STEP] for x in (far, near)]
            own = true[k:k + STEP]
            noise = np.minimum(np.searchsorted(cdf, (np.arange(COMMON) + rng.random()) / COMMON), len(cdf) - 1)
            guess = (context @ matrix[0])[at[0]]
            guess += (context @ matrix[1])[at[1]]
            vectors = target[own]
            up = np.einsum("md,md->m", guess, vectors) + (bias - expected)[own]
            up = 1 / (1 + np.exp(-np.clip(up, -30, 30))) - 1
            other = guess @ target[noise].T
            other += (bias - expected)[noise]
            np.maximum(other, -30, out=other)  # the exponential stays finite
            np.negative(other, out=other)
            np.exp(other, out=other)
            other += 1
            np.reciprocal(other, out=other)
            back = other @ target[noise]
            vectors *= up[:, None]
            back += vectors
            guess_up = guess * up[:, None]
            to_target, to_bias = _sums(own, guess_up, len(bias)), np.bincount(own, up, len(bias)).astype(np.float32)
            np.add.at(to_target, noise, other.T @ guess)
            np.add.at(to_bias, noise, other.sum(axis=0))
            to_context, to_matrix = np.zeros_like(context), []
            for places, m in zip(at, matrix):
                each = _sums(places, back, len(context))
                to_context += each @ m.T
                to_matrix.append(context.T @ each)
            for x, g, s in zip(params, (to_context, to_target, to_bias, *to_matrix), sums):
                s += g * g
                g *= GO_RATE
                g /= np.sqrt(s)
                x -= g
        return np.concatenate([x.ravel() for x in params])

    def become(self, flat: np.ndarray) -> None:
        """Take all parameters from one array."""
        ends = np.cumsum([x.size for x in self.params])[:-1]
        self.context, self.target, self.bias, *self.matrix = (
            x.reshape(old.shape) for x, old in zip(np.split(flat, ends), self.params))
        self._ready()

    def log10(self, far: np.ndarray, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the targets."""
        n = len(self.scored_bias)
        if self.normaliser is None:  # filled as pairs of classes occur
            self.normaliser = np.full(n * n, np.nan, dtype=np.float32)
        pair = far * n + near
        new = np.unique(pair[np.isnan(self.normaliser[pair])])
        for k in range(0, len(new), 2048):
            some = new[k:k + 2048]
            z = self.logits[0][some // n]
            z += self.logits[1][some % n]
            z += self.scored_bias
            top = z.max(axis=1, keepdims=True)
            z -= top
            np.exp(z, out=z)
            self.normaliser[some] = np.log(z.sum(axis=1)) + top[:, 0]
        s = self.logits[0][far, target] + self.logits[1][near, target] + self.scored_bias[target]
        return (s - self.normaliser[pair]) / np.log(10)


def _scatter(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add ``rows`` to the rows ``at`` of ``out``."""
    order = np.argsort(at, kind="stable")
    keys = at[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    if len(first):
        out[keys[first]] += np.add.reduceat(rows[order], first, axis=0)


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` classes the sum of its ``rows``."""
    place = (at.astype(np.int64)[:, None] * DIM + np.arange(DIM)).ravel()
    return np.bincount(place, rows.ravel(), n * DIM).reshape(n, DIM).astype(np.float32)


def _before(c: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes two before and one before each of ``c``, the tokens of documents of
    ``sizes`` tokens; before a document there are ends."""
    first = np.cumsum(sizes) - sizes
    near, far = np.roll(c, 1), np.roll(c, 2)
    near[first], far[first] = END, END
    far[first[sizes > 1] + 1] = END
    return far, near


class Scorer:
    """What a task needs: hot words with counts, the network, its sums."""

    def __init__(self, hot: list[tuple[str, int]], end_count: int, net: LogBilinear | None = None):
        """hot: by falling count; the first are the word classes."""
        self.index = {w.encode(): i for i, (w, _) in enumerate(hot)}
        self.count = np.array([c for _, c in hot] + [0], np.float64)
        self.end_count, self.net = end_count, net

    def classes(self, indices: np.ndarray) -> np.ndarray:
        """Class of each token of a document, the end included."""
        return np.append(np.where((indices >= 0) & (indices < CLASSES), indices + 2, OTHER), END)

    def indices(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, tokens, repeat(-1)), np.int64, len(tokens))

    def places(self, text: str | None, rng) -> np.ndarray:
        c = self.classes(self.indices(words(text)))
        at = rng.choice(len(c), min(len(c), FIT_PLACES), replace=False)
        before = np.concatenate([[END, END], c])
        return np.stack([before[at], before[at + 1], c[at]], axis=1).astype(np.int32)

    def score(self, texts: list) -> list[tuple]:
        """Of each text: n_tokens, known hot tokens, sum of log10(c + 1) of hot
        tokens, the same of those in the class of others, tokens in that class,
        log10 probability of the classes, its other words."""
        out, classes, sizes = [], [], []
        for t in texts:
            tokens = words(t)
            i = self.indices(tokens)
            c = self.classes(i)
            logs = np.log10(self.count[i] + 1)
            hot = i >= 0
            other = c[:-1] == OTHER
            rare = [tokens[k].decode() for k in np.flatnonzero(~hot).tolist()]
            out.append([len(c), int(hot.sum()) + (self.end_count > 0), float(logs[hot].sum() + np.log10(self.end_count + 1)),
                        float(logs[hot & other].sum()), int(other.sum()), 0.0, rare])
            classes.append(c)
            sizes.append(len(c))
        if texts:
            first = np.cumsum([0, *sizes[:-1]])
            c = np.concatenate(classes)
            far, near = _before(c, np.array(sizes))
            for row, x in zip(out, np.add.reduceat(self.net.log10(far, near, c).astype(np.float64), first)):
                row[5] = float(x)
        return out


def _learn_all(net: LogBilinear, scorer: Scorer, narrow: DataFrame, total: int) -> None:
    """Go on over all ``total`` positions of ``narrow`` (k, text): each document
    is in one round, and there in the share that its hash ``k`` gives."""
    spark = narrow.sparkSession
    shares = -(-total // (SHARE * ROUNDS))
    words_of = spark.sparkContext.broadcast(scorer)

    def coded(batches):
        for b in batches:
            each = [words_of.value.classes(words_of.value.indices(words(t))).astype(np.int16).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(each, pa.binary())], names=["k", "classes"])

    def round_over(n, shared):
        def run(batches):
            rows = [c for b in batches for c in b.column("classes").to_pylist()]  # two bytes a position of one share
            if not rows:
                return
            share = TaskContext.get().partitionId()
            rng = np.random.default_rng([n, share])
            c = np.frombuffer(b"".join(rows), np.int16)
            far, near = _before(c, np.array([len(r) // 2 for r in rows]))
            order = rng.permutation(len(c))
            flat = shared.value.gone_on(far[order], near[order], c[order], rng)
            yield pa.RecordBatch.from_arrays(
                [pa.array([share], pa.int32()), pa.array([len(c)], pa.int64()), pa.array([flat.astype(np.float32).tobytes()], pa.binary())],
                names=["share", "n", "flat"])
        return run

    def mean(table):
        n = table["n"].to_numpy()
        flat = np.zeros(sum(x.size for x in net.params))
        for x, weight in zip(table["flat"], n / n.sum()):
            flat += np.frombuffer(x.as_py(), np.float32) * weight
        return int(n.sum()), flat

    def added(table):
        table = table.sort_by("share")
        n, flat = mean(table)
        return pa.table({"share": pa.array([table["share"][0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()),
                         "flat": pa.array([flat.astype(np.float32).tobytes()], pa.binary())})

    schema = "share int, n long, flat binary"
    for n in range(ROUNDS):
        shared = spark.sparkContext.broadcast(net)
        dealt = (narrow.where(F.pmod("k", F.lit(ROUNDS)) == n).mapInArrow(coded, "k long, classes binary")
                 .repartition(shares, "k").sortWithinPartitions("k", "classes"))
        nets, left = dealt.select("classes").mapInArrow(round_over(n, shared), schema), shares
        while left > 2 * ADDED:  # so few networks meet in one task, and at the driver
            left = -(-left // ADDED)
            nets = nets.groupBy(F.pmod("share", F.lit(left)).alias("to")).applyInArrow(added, schema)
        got = nets.toArrow()
        if got.num_rows:
            net.become(mean(got.sort_by("share"))[1])
        shared.unpersist()


def fit(docs: DataFrame, scorer: Scorer, unigram: np.ndarray, total: int, id_col: str, text_col: str) -> LogBilinear:
    """Train on all ``total`` positions of ``docs``: a network of places of the
    ``FIT_DOCS`` documents with the least hash, then passes over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.append(shared.value.places(t, np.random.default_rng(k & 0xFFFFFFFF)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["k", "places"])

    text = F.col(f"`{text_col}`").cast("string")
    narrow = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("k"), text.alias("text"))
    limit = narrow.select("k").orderBy("k").limit(FIT_DOCS).agg(F.max("k")).first()[0]
    got = narrow.where(F.col("k") <= limit).dropDuplicates(["k"]).mapInArrow(run, "k long, places binary").toArrow() if limit is not None else None
    rows = got.sort_by("k")["places"].to_pylist() if got is not None else []
    net = LogBilinear(unigram, np.frombuffer(b"".join(rows), np.int32).reshape(-1, 3).copy())
    if total:
        _learn_all(net, scorer, narrow, total)
    return net


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score ``docs`` by a model of ``train``: the id column, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` (add-one unigram log10
    probability) and ``score`` (the network's)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-counts")
    token_counts(train, text_col).write.option("compression", "zstd").parquet(path)
    counts = spark.read.parquet(path)
    total, distinct, end_count = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == END_WORD, F.col("c"))), F.lit(0))).first()
    plain = counts.where(F.col("word") != END_WORD)
    least = _hot(plain, HOT)
    hot = sorted(((r[0], r[1]) for r in plain.where(_band() >= least).collect()), key=lambda r: (-r[1], r[0]))  # at most HOT rows
    scorer = Scorer(hot, end_count)
    in_classes = sum(c for _, c in hot[:CLASSES])
    n_classes = len(hot[:CLASSES])
    other_total = total - end_count - in_classes
    other_words = distinct - (end_count > 0) - n_classes
    scorer.net = fit(train, scorer, np.array([other_total, end_count, *(c for _, c in hot[:CLASSES])], np.float64), total, id_col, text_col)
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches):
        s = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                cols = list(zip(*s.score(part.column(2).to_pylist())))
                info = pa.StructArray.from_arrays(
                    [pa.array(v, t) for v, t in zip(cols[:6], (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()))],
                    names=["n", "known", "hot", "hot_other", "others", "classes"])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), info, pa.array(cols[6], pa.list_(pa.string()))],
                                                 names=["id", "h", "info", "rare"])

    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    info = "struct<n:bigint,known:bigint,hot:double,hot_other:double,others:bigint,classes:double>"
    kind = source.schema["id"].dataType.simpleString()
    per_doc = source.mapInArrow(run, f"id {kind}, h long, info {info}, rare array<string>")
    # one row for each rare word, and one that carries the document's own sums;
    # its key holds a blank, so it is no word and spreads over all partitions
    own = F.concat(F.lit(" "), F.col("h").cast("string"))
    each = (per_doc.select("id", "h", "info", F.posexplode(F.concat(F.array(own), "rare")).alias("at", "word"))
            .select("id", "h", "word", F.when(F.col("at") == 0, F.col("info")).alias("info")))
    rare = plain.where(_band() < least)
    log = F.when(F.col("info").isNull(), F.log10(F.coalesce("c", F.lit(0)) + 1))
    sums = (each.join(rare, "word", "left").groupBy("id", "h").agg(
        F.count("info").alias("rows"), F.max("info").alias("info"), F.coalesce(F.sum(log), F.lit(0.0)).alias("logs"),
        F.count("c").alias("known")))
    i, rows = F.col("info"), F.col("rows")  # equal rows of one id were summed together
    logs = F.col("logs") / rows
    all_base = F.lit(float(np.log10(total + 1.0 * (distinct + 1))))
    all_other = F.lit(float(np.log10(other_total + other_words + 1.0)))
    return sums.select(
        F.explode(F.sequence(F.lit(1), rows)).alias("copy"), F.col("id").alias(id_col), i["n"].alias("n_tokens"),
        (i["known"] + F.col("known") / rows).cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (i["hot"] + logs - i["n"] * all_base).alias("base_score"),
        (i["classes"] + i["hot_other"] + logs - i["others"] * all_other).alias("score")).drop("copy")


def score_held_out(docs: DataFrame, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn outside fold ``held_out`` and score every document."""
    mine = fold(F.col(f"`{id_col}`"), folds) == held_out
    out = score(docs, docs.where(~mine), id_col, text_col)
    return out.select(F.col(f"`{id_col}`"), mine.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
