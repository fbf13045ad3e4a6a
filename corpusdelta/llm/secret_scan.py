"""Secret scan: fixed rules and a character network (operator 7).

Rules (kinds ``assign``, ``access``, ``hex``) give the base findings; each is
the span of a whole match, leftmost and non-overlapping within its kind. Every
run of ``CANDIDATE`` characters is a candidate. A convolutional network over the
characters of a candidate and its surroundings (numpy) adds candidates that no
rule covers as kind ``model``. A candidate longer than a window is read by
overlapping windows, whole; the highest score counts.

The network learns from labelled findings: the rules run over all documents, and
all windows of all candidates are findings; covered by a rule or not is the label.
The ``FIT_FINDINGS`` different ones of each label with the least hash make a first
network. If there are more, it goes on over all of them in ``ROUNDS`` passes: shares
of the findings train apart on the cluster and their parameters are averaged. Half
of the positive examples also come with blanked surroundings, so that it learns the
value itself too. Scores are calibrated by a logistic fit on all findings that were
not trained on (one in four; after passes over all, the secrets among them also
without surroundings), and the threshold is the highest probability, 0.5 at least, that keeps
``RECALL`` of the secrets among them.

Defined cases: a null text is empty; empty texts have no findings; without
findings of both labels in the table nothing is added; repeated rows and null
ids are kept row by row; an empty table gives an empty result; only the named
columns are read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import copy
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdelta.llm.shared import scratch_path

#: The rules, in the order of the kinds, with the group that has a least length.
RULES = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),  # a shorter run can't be part of a longer one
)
KINDS = ("assign", "access", "hex", "model")
#: No match of the first rule is without one of these, in any case.
KEYWORDS = ("passw", "secret", "token", "api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

FIT_FINDINGS, RECALL = 2_000, 0.95
#: Passes over all findings, findings that a task trains on at a time, distinct ones it holds while it reads.
ROUNDS, SHARE, HELD_FINDINGS = 3, 4_096, 20_000
BEFORE, INSIDE, AFTER, STEP = 24, 64, 16, 48
WINDOW = BEFORE + INSIDE + AFTER
EMBED, TAPS, FILTERS, EPOCHS, BATCH, RATE = 8, 5, 24, 12, 64, 0.01
_PAD, _OTHER, _FIRST = 0, 1, 2
_CODE = np.full(128, _OTHER, np.uint8)
_CODE[32:127] = np.arange(95) + _FIRST
SYMBOLS = 95 + _FIRST


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, in order."""
    out = []
    lower = text.lower()
    for kind, (name, pattern, group, least) in enumerate(RULES):
        if name == "assign" and not any(k in lower for k in KEYWORDS):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, covered by a rule) of every candidate."""
    out, k = [], 0
    spans = sorted((s, e) for s, _, e in base)
    furthest = np.maximum.accumulate([e for _, e in spans]) if spans else []
    for m in CANDIDATE.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            k += 1
        out.append((m.start(), m.end(), bool(k and furthest[k - 1] > m.start())))
    return out


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Character codes around one candidate, one row for each window; the high
    bit marks the candidate's own characters."""
    out = []
    for at in range(start, max(start + 1, end - (INSIDE - STEP)), STEP):
        row = np.zeros(WINDOW, np.uint8)
        lo = max(0, at - BEFORE)
        part = np.frombuffer(text[lo:at + INSIDE + AFTER].encode("utf-32-le"), np.uint32)
        codes = np.where(part < 128, _CODE[np.minimum(part, 127)], _OTHER).astype(np.uint8)
        place = np.arange(lo, lo + len(codes))
        codes[(place >= start) & (place < end)] |= 128
        row[BEFORE - (at - lo):][:len(codes)] = codes
        out.append(row)
    return out


class Network:
    """Embedding, one convolution, the highest and mean response of each filter
    in the candidate and around it, one logistic unit."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, seed: int = 5):
        self.threshold, self.scale, self.shift = np.inf, 1.0, 0.0
        ones = np.flatnonzero(labels == 1)
        zeros = np.flatnonzero(labels == 0)
        if len(ones) < 4 or len(zeros) < 4:
            return
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 0.3, (SYMBOLS, EMBED)), rng.normal(0, 0.15, (TAPS * (EMBED + 1), FILTERS)),
                  np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS), np.zeros(1)]
        test = np.concatenate([ones[::4], zeros[::4]])
        train = np.setdiff1d(np.arange(len(labels)), test)
        blank = rows[train[labels[train] == 1]].copy()
        blank[blank < 128] = _PAD
        x = np.concatenate([rows[train], blank[::2]])
        y = np.concatenate([labels[train], np.ones(len(blank[::2]))]).astype(float)
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
        self._train(x, y, weight, rng)
        self.calibrate(self.logits(rows[test]), labels[test], np.ones(len(test)))

    def calibrate(self, z: np.ndarray, t: np.ndarray, count: np.ndarray) -> None:
        """Scale, shift and threshold from logits, their labels and how often each occurs."""
        self.scale, self.shift, share = 1.0, 0.0, count / count.sum()
        for _ in range(200):  # logistic calibration
            q = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))
            self.scale = max(self.scale - 0.05 * float(((q - t) * z * share).sum()), 0.05)
            self.shift -= 0.05 * float(((q - t) * share).sum())
        order = np.argsort(z[t == 1])
        total = np.cumsum(count[t == 1][order])
        found = z[t == 1][order][np.searchsorted(total, int((1 - RECALL) * total[-1]), side="right")]
        self.threshold = max(0.5, float(1 / (1 + np.exp(-np.clip(self.scale * found + self.shift, -30, 30)))))

    def _forward(self, rows):
        own = rows >= 128
        code = (rows & 127).astype(np.int64)
        x = np.concatenate([self.p[0][code], own[:, :, None].astype(float)], axis=2)
        x[(code == _PAD)] = 0
        n = WINDOW - TAPS + 1
        cols = np.lib.stride_tricks.sliding_window_view(x, TAPS, axis=1).transpose(0, 1, 3, 2).reshape(len(rows), n, -1)
        h = np.maximum(cols @ self.p[1] + self.p[2], 0)
        inside = own[:, TAPS // 2:TAPS // 2 + n]
        masks = [np.where(m[:, :, None], h, -1.0) for m in (inside, ~inside)]
        tops = [m.argmax(axis=1) for m in masks]
        highs = [np.maximum(np.take_along_axis(m, a[:, None, :], 1)[:, 0], 0) for m, a in zip(masks, tops)]
        share = inside / np.maximum(inside.sum(axis=1, keepdims=True), 1)
        f = np.concatenate([*highs, np.einsum("bn,bnf->bf", share, h)], axis=1)
        return code, own, cols, h, tops, share, f, f @ self.p[3] + self.p[4][0]

    def _train(self, rows, y, weight, rng, epochs=EPOCHS, rate=RATE):
        m, v, step = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), BATCH):
                at = order[k:k + BATCH]
                code, _, cols, h, tops, share, f, z = self._forward(rows[at])
                dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at] / len(at)
                df = dz[:, None] * self.p[3]
                dh = share[:, :, None] * df[:, None, 2 * FILTERS:]
                each, filters = np.arange(len(at))[:, None], np.arange(FILTERS)[None]
                for part, top in enumerate(tops):
                    dh[each, top, filters] += df[:, part * FILTERS:(part + 1) * FILTERS]
                dh *= h > 0
                dcols = (dh @ self.p[1].T).reshape(len(at), -1, TAPS, EMBED + 1)
                dx = np.zeros((len(at), WINDOW, EMBED + 1))
                for tap in range(TAPS):
                    dx[:, tap:tap + dcols.shape[1]] += dcols[:, :, tap]
                de = np.zeros_like(self.p[0])
                np.add.at(de, code.ravel(), dx[:, :, :EMBED].reshape(-1, EMBED))
                de[_PAD] = 0
                grads = [de, np.einsum("bnc,bnf->cf", cols, dh), dh.sum(axis=(0, 1)), f.T @ dz, dz.sum(keepdims=True)]
                step += 1
                for x, g, a, b in zip(self.p, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    x -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(rows[k:k + 256])[-1] for k in range(0, len(rows), 256)]) if len(rows) else np.zeros(0)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(rows) + self.shift, -30, 30)))


def _spread(keys: list[int]) -> list[int]:
    """Spark's ``xxhash64`` of longs, so that tasks keep what Spark would keep."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, n):
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    x = np.array(keys, np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = turned(x * p2, 31) * p1 ^ (np.uint64(42 + 8) + p5)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64).tolist()


def fit(docs: DataFrame, id_col: str, text_col: str) -> Network:
    """Train on all labelled findings of the whole table: a network of the
    ``FIT_FINDINGS`` of each label with the least hash, then passes over all."""
    def run(batches):
        kept = [{}, {}]

        def flush():
            for label in (0, 1):
                rows, kept[label] = kept[label], {}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(rows.values()), pa.int64()), pa.array([label] * len(rows), pa.int32()),
                     pa.array(list(rows), pa.binary())], names=["k", "label", "row"])

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = t or ""
                own = candidates(t, base_findings(t))
                for (s, e, known), k in zip(own, _spread([key ^ s for s, _, _ in own])):
                    for w in windows(t, s, e):
                        row = w.tobytes()
                        kept[known][row] = min(k, kept[known].get(row, k))
                if len(kept[0]) + len(kept[1]) >= HELD_FINDINGS:
                    yield from flush()
        yield from flush()

    spark = docs.sparkSession
    path = scratch_path(spark, "findings")  # the documents are read once for both labels
    text = F.col(f"`{text_col}`").cast("string")
    (docs.select(F.xxhash64(F.col(f"`{id_col}`"), text), text).mapInArrow(run, "k long, label int, row binary")
     .write.parquet(path))
    found = spark.read.parquet(path).groupBy("label", "row").agg(F.min("k").alias("k"))
    parts = [found.where(F.col("label") == label).orderBy("k", "row").limit(FIT_FINDINGS).toArrow() for label in (0, 1)]
    got = pa.concat_tables(parts)
    rows, labels = got["row"].to_pylist(), got["label"].to_numpy()
    network = Network(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW), labels)
    if np.isfinite(network.threshold) and max(len(p) for p in parts) == FIT_FINDINGS:
        first = {row: i % 4 == 0 for part in parts for i, row in enumerate(part["row"].to_pylist())}
        _learn_all(network, found, first)
    return network


def _learn_all(network: Network, found: DataFrame, first: dict[bytes, bool]) -> None:
    """``ROUNDS`` passes over all findings: in each, every share of about
    ``SHARE`` findings goes on from the network as it is, and the means of the
    parameters, by findings, are the next. Then the calibration and the threshold,
    from the logits of all findings that no pass trained on (one in four;
    ``first`` tells which of the first network's it held out)."""
    spark = found.sparkSession
    path = scratch_path(spark, "all-findings")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    count = dict(found.groupBy("label").count().collect())
    shares = -(-sum(count.values()) // SHARE)
    both = 1.5 * count[1] + count[0]    # half of the positive ones also come without surroundings
    weights = np.array([both / (2 * count[0]), both / (3 * count[1])])
    spread = found.withColumn("share", F.pmod(F.shiftright("k", 2), F.lit(shares)))

    def held(pdf):
        return np.array([first.get(row, k & 3 == 0) for row, k in zip(pdf.row, pdf.k)], bool)

    def codes(rows):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW)

    def with_values(rows, y, step):
        """Every ``step``-th positive row also without its surroundings."""
        blank = rows[y == 1][::step].copy()
        blank[blank < 128] = _PAD
        return np.concatenate([rows, blank]), np.append(y, np.ones(len(blank), y.dtype))

    def pass_over(n):
        def go_on(pdf):
            pdf = pdf[~held(pdf)].sort_values(["label", "row"])
            share = int(pdf.share.iloc[0]) if len(pdf) else 0
            net = copy.deepcopy(network)
            if len(pdf):
                rows, y = with_values(codes(pdf.row), pdf.label.to_numpy(), 2)
                net._train(rows, y.astype(float), weights[y], np.random.default_rng([n, share]), epochs=1, rate=RATE / 10)
            flat = np.concatenate([x.ravel() for x in net.p] + [np.ones(1)]) * len(pdf)
            return pd.DataFrame({"place": np.arange(len(flat)), "val": flat})
        return go_on

    for n in range(ROUNDS):
        sums = spread.groupBy("share").applyInPandas(pass_over(n), "place int, val double").groupBy("place").agg(F.sum("val")).collect()
        flat = np.zeros(len(sums))
        for place, val in sums:     # one number for each parameter
            flat[place] = val
        ends = np.cumsum([x.size for x in network.p])
        network.p = [x.reshape(old.shape) for x, old in zip(np.split(flat[:-1] / flat[-1], ends[:-1]), network.p)]

    def logits(batches):
        for pdf in batches:
            pdf = pdf[held(pdf)]
            rows, y = with_values(codes(pdf.row), pdf.label.to_numpy(), 1)
            z = np.clip(network.logits(rows), -60, 60)
            yield pd.DataFrame({"label": y, "z": np.floor(z * 64).astype(int)})
    bins = found.mapInPandas(logits, "label int, z int").groupBy("label", "z").count().toPandas()  # at most 2 * 7681 rows
    network.calibrate(bins.z.to_numpy() / 64, bins.label.to_numpy(), bins["count"].to_numpy(float))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", network: Network | None = None) -> DataFrame:
    """One row per input row: the id column and ``findings``, an array of
    (kind, start, end) in order of start and kind."""
    network = fit(docs, id_col, text_col) if network is None else network
    shared = docs.sparkSession.sparkContext.broadcast(network)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        net = shared.value
        for b in batches:
            found, where, rows = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                t = t or ""
                base = base_findings(t)
                found.append(base)
                for s, e, known in candidates(t, base) if np.isfinite(net.threshold) else ():
                    if not known:
                        own = windows(t, s, e)
                        rows += own
                        where += [(i, s, e)] * len(own)
            if rows:
                hit = net.probability(np.stack(rows)) >= net.threshold
                for i, s, e in dict.fromkeys(w for w, h in zip(where, hit.tolist()) if h):
                    found[i].append((s, 3, e))
            out = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(item))], names=[id_col, "findings"])

    source = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, "
                                  "findings array<struct<kind:string,start:bigint,end:bigint>>")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the rules' findings, the digest of their places, all places."""
    def joined(a):
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(F.col(f"`{id_col}`"), count("assign"), count("access"), count("hex"), F.sha2(
        joined(F.filter("findings", lambda x: x["kind"] != "model")), 256).alias("base_sha256"), joined("findings").alias("spans"))
