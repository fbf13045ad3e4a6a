"""Per-document text features.

Plan: the token table (hash-partitioned by ``doc_id`` by the tokeniser's
spread) is aggregated twice, first by ``(doc_id, lemma)`` and then by
``doc_id``. Both groupings are satisfied by the existing partitioning, so the
whole feature family is one scan, two in-partition aggregations and no
exchange; no distinct aggregate (and no Expand) is needed because distinct
lemmas are the rows of the first aggregation.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from corpusdelta.functions import fixed
from corpusdelta.functions import text as T

SURFACE = ["t_word", "t_stopword", "t_punct", "t_uword", "t_sent", "t_char"]
POS_VAR = [f"{k}_{p}_var" for p in fixed.UPOS_FEATURE_TAGS for k in ("simp", "root", "corr")]
POS_COUNTS = [f"n_{p}" for p in fixed.UPOS_ALL]
READABILITY = ["avg_word_length", "gunning_fog"]
DIVERSITY = ["cttr", "simpsons_d", "entropy"]
FAMILIES = {"surface": SURFACE, "posvar": POS_VAR, "poscounts": POS_COUNTS,
            "readability": READABILITY, "diversity": DIVERSITY}
_TAGS = sorted(set(fixed.UPOS_FEATURE_TAGS) | set(fixed.UPOS_ALL))


def syllables(token) -> Column:
    """Vowel-group count, the usual syllable estimate."""
    return F.size(F.regexp_extract_all(F.col(token) if isinstance(token, str) else token,
                                       F.lit(fixed.VOWEL_GROUP), 0))


def _div0(a: Column, b: Column) -> Column:
    """a / b with a zero (or NULL) denominator giving 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def lemma_stats(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """First aggregation: one row per (document, lemma)."""
    word = F.col("token").rlike(r"\p{L}")
    aggs = [F.count(F.lit(1)).alias("c"),
            F.count_if(F.col("token").isin(*fixed.STOPWORDS)).alias("stop"),
            F.sum(F.length("token")).cast("long").alias("chars"),
            F.count_if(word).alias("words"),
            F.sum(F.when(word, F.length("token")).otherwise(0)).cast("long").alias("word_chars"),
            F.count_if(word & (syllables("token") >= fixed.COMPLEX_SYLLABLES)).alias("complex"),
            F.max("sent_id").alias("max_sent")]
    aggs += [F.count_if(F.col("upos") == t.upper()).alias(f"u_{t}") for t in _TAGS]
    return tokens.groupBy(doc, "lemma").agg(*aggs)


def doc_features(tokens: DataFrame, families: Sequence[str] = tuple(FAMILIES),
                 doc: str = "doc_id", round_to: int | None = 3) -> DataFrame:
    """L1, L2, L3, L12, L14 in one job: ``(doc_id, <features>)``.

    Zero denominators give 0; values are rounded to ``round_to`` decimals
    (the published per-document values carry three)."""
    ls = lemma_stats(tokens, doc)
    n = F.sum("c")
    aggs = [n.alias("t_word"), F.sum("stop").alias("t_stopword"),
            F.sum("u_punct").alias("t_punct"), F.count(F.lit(1)).alias("t_uword"),
            (F.max("max_sent") + 1).cast("long").alias("t_sent"),
            F.sum("chars").cast("long").alias("t_char"),
            F.sum("words").alias("_words"), F.sum("word_chars").alias("_word_chars"),
            F.sum("complex").alias("_complex"),
            F.sum(F.col("c") * (F.col("c") - 1)).alias("_cc1"),
            F.sum(F.col("c") * F.log2("c")).alias("_clogc")]
    for t in _TAGS:
        aggs += [F.sum(f"u_{t}").alias(f"n_{t}"), F.count_if(F.col(f"u_{t}") > 0).alias(f"_u_{t}")]
    d = ls.groupBy(doc).agg(*aggs)
    cols = {}
    for t in fixed.UPOS_FEATURE_TAGS:
        u, nn = F.col(f"_u_{t}"), F.col(f"n_{t}")
        cols[f"simp_{t}_var"] = _div0(u, nn)
        cols[f"root_{t}_var"] = _div0(u, F.sqrt(nn))
        cols[f"corr_{t}_var"] = _div0(u, F.sqrt(2 * nn))
    w, s = F.col("t_word"), F.col("t_sent")
    cols["avg_word_length"] = _div0(F.col("_word_chars"), F.col("_words"))
    cols["gunning_fog"] = 0.4 * (_div0(F.col("_words"), s)
                                 + 100 * _div0(F.col("_complex"), F.col("_words")))
    cols["cttr"] = _div0(F.col("t_uword"), F.sqrt(2 * w))
    cols["simpsons_d"] = _div0(F.col("_cc1"), w * (w - 1))
    cols["entropy"] = F.when(w > 0, F.log2(w) - F.col("_clogc") / w).otherwise(F.lit(0.0))
    wanted = [c for fam in families for c in FAMILIES[fam]]
    out = []
    for c in wanted:
        e = cols.get(c, F.col(c))
        if c in cols and round_to is not None:
            e = F.round(e, round_to)
        out.append(e.alias(c))
    return d.select(doc, *out)


# ------------------------------------------------------------------ L15 / L16
def mattr(tokens: DataFrame, window: int = fixed.MATTR_WINDOW, doc: str = "doc_id",
          value: str = "lemma", block: int = 4096) -> DataFrame:
    """Moving-average type-token ratio over windows of ``window``
    tokens; texts shorter than the window get the plain TTR.

    No window is held: a token is a new type of all windows that hold it and
    begin behind the lemma's last occurrence, so the types of all windows add up
    to one term per token. Tokens are cut into blocks of ``block`` positions, and
    the last ``window - 1`` tokens of a block are copied to the next one, so the
    last occurrence is found among ``block + window`` rows whatever the document
    length."""
    block = max(block, window)
    t = _token_positions(tokens, doc, value).withColumnRenamed("_value", value)
    pos, n = F.col("_pos"), F.col("_n")
    own = (pos / block).cast("long")
    copies = F.when(pos % block > block - window, F.array(own, own + 1)).otherwise(F.array(own))
    both = t.select(doc, value, "_pos", "_n", own.alias("_own"), F.explode(copies).alias("_blk"))
    last = F.lag("_pos").over(Window.partitionBy(doc, "_blk", value).orderBy("_pos"))
    mine = both.withColumn("_last", last).where(F.col("_own") == F.col("_blk"))
    first = F.greatest(F.coalesce(F.col("_last"), F.lit(-1)) + 1, pos - window + 1)     # windows of which it is a new type
    begins = F.greatest(F.least(pos, n - window) - first + 1, F.lit(0))
    agg = mine.groupBy(doc).agg(F.max("_n").alias("_n"), F.sum(begins).alias("_wd"), F.count_if(F.col("_last").isNull()).alias("_u"))
    return agg.select(doc, F.when(n >= window, F.col("_wd") / ((n - window + 1) * window)).otherwise(F.col("_u") / n).alias("mattr"))


def _token_positions(tokens: DataFrame, doc: str, value: str) -> DataFrame:
    """``(doc, value, _pos, _n)``: each token's position in its document, and the
    document's length. The windows hold one document's rows and are satisfied by
    the partitioning by document, so the tokens are made once and not exchanged."""
    rows = Window.partitionBy(doc)
    return tokens.select(doc, F.col(value).alias("_value"),
                         (F.row_number().over(rows.orderBy("sent_id", "pos_in_sent")) - 1).cast("long").alias("_pos"),
                         F.count(F.lit(1)).over(rows).alias("_n"))


#: Exits of a chunk's map beside positions: the text ended, or a factor is
#: longer than what the chunk sees.
ENDED, OPEN = -1, -2


def _close(seq: list, at: int, threshold: float) -> tuple[int, int, int]:
    """Scan a factor from ``at``: the position behind it (-1: still open at the
    end of ``seq``), its types and its length."""
    types: set = set()
    for i in range(at, len(seq)):
        types.add(seq[i])
        if len(types) / (i + 1 - at) <= threshold:
            return i + 1, len(types), i + 1 - at
    return -1, len(types), len(seq) - at


def _closes(seq: list, starts: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_close` from each of the first ``starts`` positions at once:
    positions behind the factors (-1: open) and the types so far. A token is a
    new type of all factors that began after its last occurrence."""
    behind, types = np.full(starts, -1), np.zeros(starts)
    last: dict = {}
    low = 0
    for i, token in enumerate(seq):
        high = min(i + 1, starts)
        new = max(last.get(token, -1) + 1, low)
        if new < high:
            types[new:high] += 1
        last[token] = i
        now = slice(low, high)
        closed = (behind[now] < 0) & (types[now] / (i + 1 - np.arange(low, high)) <= threshold)
        if closed.any():
            behind[now][closed] = i + 1
            while low < high and behind[low] >= 0:
                low += 1
            if low == starts:
                break
    return behind, types


def _chunk_map(seq: list, chunk: int, first: int, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """What a chunk makes of a factor that begins in it: for each beginning, the
    factors that end until the text or the first beginning beyond the chunk
    (the last one of a text counts by its share), and that beginning. ``seq``
    holds the chunk and what it sees behind it. The first chunk of a text is
    begun at its beginning only."""
    def rest(types: float, size: float) -> float:
        return (1 - types / size) / (1 - threshold) if threshold < 1 else 0.0

    whole = first + len(seq) == n
    own = min(chunk, len(seq))
    if first == 0:
        count, at = 0.0, 0
        while 0 <= at < own:
            behind, types, size = _close(seq, at, threshold)
            if behind < 0:
                count, at = (count + rest(types, size), ENDED) if whole else (count, OPEN)
            else:
                count, at = count + 1, ENDED if behind == n else behind
        return np.array([count]), np.array([at])
    behind, types = _closes(seq, own, threshold)
    counts, exits = np.zeros(own), np.zeros(own, np.int64)
    for at in range(own - 1, -1, -1):
        to = behind[at]
        if to < 0:
            counts[at], exits[at] = (rest(types[at], len(seq) - at), ENDED) if whole else (0.0, OPEN)
        elif first + to == n:
            counts[at], exits[at] = 1, ENDED
        elif to >= own:
            counts[at], exits[at] = 1, first + to
        else:
            counts[at], exits[at] = 1 + counts[to], exits[to]
    return counts, exits


def _factor_counts(seq: DataFrame, doc: str, threshold: float, chunk: int, fan: int) -> DataFrame:
    """``(doc, _way, _n, count, exit)`` of every sequence, by a parallel scan."""
    kind = seq.schema[doc].dataType.simpleString()
    schema = f"{doc} {kind}, _way int, _chunk long, _n long, counts array<double>, exits array<long>"

    def chunk_maps(batches):
        for pdf in batches:
            maps = [_chunk_map(list(v), chunk, c * chunk, n, threshold) for v, c, n in zip(pdf["seq"], pdf["_chunk"], pdf["_n"])]
            yield pdf.drop(columns="seq").assign(counts=[m[0] for m in maps], exits=[m[1] for m in maps])

    def joined(width):
        def run(batches):
            for pdf in batches:
                counts, exits = [], []
                for parts in pdf["parts"]:
                    count, at = np.array(parts[0]["counts"], float), np.array(parts[0]["exits"], np.int64)
                    for part in parts[1:]:
                        start = part["_chunk"] * width
                        inside = np.flatnonzero((at >= start) & (at < start + width))
                        to = at[inside] - start
                        count[inside] += np.asarray(part["counts"])[to]
                        at[inside] = np.asarray(part["exits"])[to]
                    counts.append(count)
                    exits.append(at)
                yield pdf.drop(columns="parts").assign(counts=counts, exits=exits)
        return run

    own = F.floor(F.col("_pos") / chunk)
    # a token is in its own chunk, and in the one before but for the chunk's last place
    copies = F.when((own > 0) & (F.col("_pos") % chunk < chunk - 1), F.array(own - 1, own)).otherwise(F.array(own))
    chunks = (seq.select(doc, "_way", "_n", "_pos", "_value", F.explode(copies).alias("_chunk"))
              .groupBy(doc, "_way", "_chunk", "_n").agg(F.array_sort(F.collect_list(F.struct("_pos", "_value")))["_value"].alias("seq")))
    maps = chunks.mapInPandas(chunk_maps, schema)
    most, width = seq.agg(F.max("_n")).first()[0] or 0, chunk
    while width < most:
        part = F.array_sort(F.collect_list(F.struct("_chunk", "counts", "exits"))).alias("parts")
        maps = (maps.groupBy(doc, "_way", F.floor(F.col("_chunk") / fan).alias("_next"), "_n").agg(part)
                .withColumnRenamed("_next", "_chunk").mapInPandas(joined(width), schema))
        width *= fan
    return maps.select(doc, "_way", "_n", F.col("counts")[0].alias("count"), F.col("exits")[0].alias("exit"))


def mtld(tokens: DataFrame, threshold: float = fixed.MTLD_THRESHOLD, doc: str = "doc_id",
         value: str = "lemma", chunk: int = 1024, fan: int = 16) -> DataFrame:
    """Measure of textual lexical diversity (forward/backward mean
    factor length).

    The partitioning by document brings a document's tokens to one task in their
    order. There, documents of at most ``chunk * fan * fan`` tokens are read in
    both directions as they pass, one at a time; nothing of them is kept.

    Longer ones take a parallel scan: their tokens, in either direction, are cut
    into chunks, and each chunk is summarised as the map from the place where a
    factor begins to the factors that end and the place where the next chunk
    is entered. Maps of ``fan`` neighbouring chunks are composed level by
    level, so no group holds a document. A chunk sees the one behind it; the
    documents that have a factor beyond that are done again with chunks four
    times as long, so a group holds at most about eight times the longest
    factor (or a first chunk)."""
    from corpusdelta.session import cut
    pos = _token_positions(tokens, doc, value)
    passed = cut(_lengths(pos, doc, threshold, chunk * fan * fan))
    length = F.when(F.col("count") > 0, F.col("_n") / F.col("count")).otherwise(F.col("_n").cast("double"))
    done = passed.where(F.col("count").isNotNull()).select(doc, "_n", "count")
    kept = passed.where(F.col("count").isNull()).select(doc, "_value", "_pos", "_n")
    seq = kept.withColumn("_way", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_pos", F.when(F.col("_way") == 1, F.col("_n") - 1 - F.col("_pos")).otherwise(F.col("_pos")))
    long = not kept.isEmpty()
    while long:
        counts = cut(_factor_counts(seq, doc, threshold, chunk, fan))
        done = done.unionByName(counts.where(F.col("exit") == ENDED).select(doc, "_n", "count"))
        again = counts.where(F.col("exit") != ENDED).select(doc, "_way")
        if again.isEmpty():
            break
        seq, chunk = seq.join(again, [doc, "_way"], "left_semi"), chunk * 4
    return done.groupBy(doc).agg(F.avg(length).alias("mtld"))


def _lengths(pos: DataFrame, doc: str, threshold: float, most: int) -> DataFrame:
    """``(doc, _value, _pos, _n, count)``: two rows for each document of at most
    ``most`` tokens, with its factors in either direction; the tokens of the
    others as they are. ``pos`` comes from :func:`_token_positions`, whose window
    leaves each document's tokens together and in their order."""
    kind = pos.schema[doc].dataType.simpleString()

    def run(batches):
        held: list = []
        for b in batches:
            at, sizes = b.column("_pos").to_numpy(), b.column("_n").to_numpy()
            long = sizes > most
            if long.any():
                rows = b.filter(pa.array(long)).select([doc, "_value", "_pos", "_n"])
                yield rows.append_column("count", pa.nulls(rows.num_rows, pa.float64()))
            out, ends = [], np.flatnonzero(~long & (at == sizes - 1))
            values, start = b.column("_value"), 0
            for stop in [*(ends + 1).tolist(), b.num_rows]:
                part = slice(start, stop)
                short = np.flatnonzero(~long[part]) + start
                if len(short):
                    if at[short[0]] != len(held) or (np.diff(at[short]) != 1).any():
                        raise RuntimeError("tokens of a document do not come in their order")
                    held += values.take(pa.array(short)).to_pylist() if len(short) < stop - start else values.slice(start, stop - start).to_pylist()
                    if at[short[-1]] == sizes[short[-1]] - 1:
                        out += [(int(short[-1]), _chunk_map(s, len(s), 0, len(s), threshold)[0][0]) for s in (held, held[::-1])]
                        held = []
                start = stop
            if out:
                rows = b.take(pa.array([i for i, _ in out])).select([doc, "_value", "_pos", "_n"])
                yield rows.append_column("count", pa.array([c for _, c in out], pa.float64()))
        if held:
            raise RuntimeError("a document ends before its last token")

    return pos.select(doc, "_value", "_pos", "_n").mapInArrow(run, f"`{doc}` {kind}, _value string, _pos long, _n long, count double")


# ------------------------------------------------------------------ L17
def global_hapax(tokens: DataFrame, doc: str = "doc_id", value: str = "lemma",
                 times: int = 2) -> DataFrame:
    """Per document, the number of lemmas that occur exactly ``times``
    (2: dis legomena) in the whole corpus.

    Corpus-wide counts come from a partially aggregated ``groupBy(lemma)``
    (hot lemmas collapse map-side). Only (document, lemma) rows that could
    belong to such a lemma are joined with the lemmas found."""
    from corpusdelta.session import cut
    # (document, lemma) counts are read twice (corpus totals, document list):
    # materialise them once instead of tokenising twice
    per = cut(tokens.groupBy(doc, value).agg(F.count(F.lit(1)).alias("c")))
    g = per.groupBy(value).agg(F.sum("c").alias("total")).filter(F.col("total") == times).select(value)
    hits = per.filter(F.col("c") <= times).join(g, value, "left_semi")
    counts = hits.groupBy(doc).agg(F.count(F.lit(1)).alias("n_global_lemma_hapax_dislegomena"))
    docs = per.select(doc).distinct()
    return (docs.join(counts, doc, "left")
            .select(doc, F.coalesce("n_global_lemma_hapax_dislegomena", F.lit(0))
                    .cast("long").alias("n_global_lemma_hapax_dislegomena")))


# ------------------------------------------------------------------ J16, L7-L10
def lexicon_lookup(tokens: DataFrame, lexicon: DataFrame, on: str = "lemma",
                   lex_key: str = "word") -> DataFrame:
    """Left join of tokens with a word-norm lexicon; the planner picks the
    strategy from the lexicon's size."""
    return tokens.join(lexicon, tokens[on] == lexicon[lex_key], "left").drop(lex_key)


def lexicon_features(tokens: DataFrame, lexicon: DataFrame, specs: Sequence[tuple],
                     doc: str = "doc_id", on: str = "lemma") -> DataFrame:
    """Per-document aggregates of lexicon scores.

    ``lexicon(word, norm, score)`` is long; ``specs`` are
    ``(feature, norm, kind, threshold)`` with kind ``avg``, ``above`` or
    ``below``. One lookup join, one aggregation for all features."""
    norms = sorted({s[1] for s in specs})
    wide = (lexicon.filter(F.col("norm").isin(*norms)).groupBy("word")
            .pivot("norm", norms).agg(F.first("score")))
    j = lexicon_lookup(tokens.select(doc, on), wide, on=on)
    aggs = []
    for feat, norm, kind, thr in specs:
        v = F.col(norm)
        if kind == "avg":
            aggs.append(F.avg(v).alias(feat))
        elif kind == "above":
            aggs.append(F.count_if(v > thr).alias(feat))
        elif kind == "below":
            aggs.append(F.count_if(v < thr).alias(feat))
        else:
            raise ValueError(kind)
    return j.groupBy(doc).agg(*aggs)


def hedges(sent_tokens: DataFrame, phrases: DataFrame, doc: str = "doc_id",
           array_col: str = "tokens") -> DataFrame:
    """Occurrences of single- and multi-word hedges per document.

    The phrase list itself gives the n-gram lengths. Each document's n-grams of
    these lengths are counted first, then joined with the phrases, so a hot
    phrase is one row per document; documents without hits get 0."""
    ph = phrases.select("phrase").where(F.col("phrase").isNotNull()).distinct()
    # one row for each phrase length
    lengths = sorted(r[0] for r in ph.select(F.size(F.split("phrase", " "))).distinct().collect())
    grams = F.concat(*[T.ngrams(array_col, n, " ") for n in lengths]) if lengths else F.array().cast("array<string>")
    g = (sent_tokens.select(doc, F.explode_outer(grams).alias("phrase"))
         .groupBy(doc, "phrase").agg(F.count(F.lit(1)).alias("_c")))
    hit = g.join(ph.withColumn("_hit", F.lit(1)), "phrase", "left")
    return hit.groupBy(doc).agg(F.coalesce(F.sum(F.col("_c") * F.col("_hit")), F.lit(0)).cast("long").alias("n_hedges"))


# ------------------------------------------------------------------ L11
def entity_counts(docs: DataFrame, tokens: DataFrame | None = None, doc: str = "doc_id",
                  text: str = "text", classes: Sequence[str] = fixed.ENTITY_CLASSES) -> DataFrame:
    """``n_<class>`` per document. Date, percent, money and cardinal
    come from built-in patterns on the text; the other classes are counted
    from an optional token ``ent`` column (an external recogniser's output)."""
    pats = fixed.ENTITY_PATTERNS
    d = docs.select(doc, *[F.size(F.regexp_extract_all(F.col(text), F.lit(p), 0)).cast("long")
                           .alias(f"n_{c}") for c, p in pats.items()])
    other = [c for c in classes if c not in pats]
    if tokens is not None and other:
        e = tokens.groupBy(doc).agg(*[F.count_if(F.col("ent") == c).alias(f"n_{c}") for c in other])
        d = d.join(e, doc, "left")
    for c in other:
        if f"n_{c}" not in d.columns:
            d = d.withColumn(f"n_{c}", F.lit(0).cast("long"))
    return d.select(doc, *[F.coalesce(F.col(f"n_{c}"), F.lit(0)).cast("long").alias(f"n_{c}")
                           for c in classes])


# ------------------------------------------------------------------ L4-L6
def morph_counts(tokens: DataFrame, features: Sequence[str] = fixed.MORPH_FEATURES,
                 doc: str = "doc_id", weight: str | None = None) -> DataFrame:
    """L4: ``n_<POS>_<Attr>_<Val>`` from the token ``morph`` map; a row counts
    as many tokens as ``weight`` says (default: one).

    The attributes are taken out of the map and the analyses of a document are
    counted first: a map that is made by the plan is then not made at all, and
    the features are sums over a few rows of a document."""
    parts = {f: f.split("_", 3)[1:] for f in features}
    attrs = {attr: f"_m{i}" for i, attr in enumerate(dict.fromkeys(attr for _, attr, _ in parts.values()))}
    times = F.lit(1).cast("long") if weight is None else F.col(weight)
    kinds = (tokens.select(doc, "upos", times.alias("_w"), *[F.col("morph")[attr].alias(c) for attr, c in attrs.items()])
             .groupBy(doc, "upos", *attrs.values()).agg(F.sum("_w").alias("_c")))
    return kinds.groupBy(doc).agg(*[
        F.coalesce(F.sum(F.when((F.col("upos") == pos) & (F.col(attrs[attr]) == val), F.col("_c"))), F.lit(0)).alias(f)
        for f, (pos, attr, val) in parts.items()])


def dependency_counts(tokens: DataFrame, labels: Sequence[str] = fixed.DEPENDENCY_LABELS,
                      doc: str = "doc_id") -> DataFrame:
    """``n_dependency_<label>`` (a pivot with explicit values)."""
    p = tokens.groupBy(doc).pivot("dep", list(labels)).count()
    return p.select(doc, *[F.coalesce(F.col(l), F.lit(0)).cast("long").alias(f"n_dependency_{l}")
                           for l in labels])


def _depths(heads: "F.Column") -> "F.Column":
    """Depth of each token of a sentence. Parents are followed by doubling:
    after k steps every token points 2^k levels up and knows the distance."""
    parent = F.transform(heads, lambda h, i: F.coalesce(h.cast("int"), i))
    one = F.transform(parent, lambda h, i: F.when(h == i, 0).otherwise(1))
    steps = F.ceil(F.log2(F.greatest(F.size(heads), F.lit(1)))).cast("int") + 1
    done = F.aggregate(
        F.sequence(F.lit(1), steps), F.struct(parent.alias("p"), one.alias("d")),
        lambda s, _: F.struct(F.transform(s["p"], lambda x: F.get(s["p"], x)).alias("p"),
                              F.zip_with(s["d"], s["p"], lambda d, x: d + F.get(s["d"], x)).alias("d")))
    return done["d"]


def tree_shape(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per sentence the width (largest level), depth and mean branching
    of the dependency tree given by ``head`` (index in the sentence, self
    or NULL for the root), averaged per document. Sentences are bounded
    groups; their trees are array expressions."""
    sent = (tokens.groupBy(doc, "sent_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos_in_sent", "head"))).alias("_h"))
            .select(doc, F.col("_h.head").alias("_heads")))
    d = sent.withColumn("_d", _depths(F.col("_heads")))
    kids = F.filter(F.col("_heads"), lambda h, i: h.isNotNull() & (h != i))
    width = F.array_max(F.transform(F.array_distinct("_d"), lambda x: F.size(F.filter("_d", lambda y: y == x))))
    shape = d.select(doc, width.cast("double").alias("w"), F.array_max("_d").cast("double").alias("d"),
                     F.coalesce(F.try_divide(F.size(kids), F.size(F.array_distinct(kids))), F.lit(0.0)).alias("b"))
    return shape.groupBy(doc).agg(F.avg("w").alias("tree_width"), F.avg("d").alias("tree_depth"),
                                  F.avg("b").alias("tree_branching"))


# ------------------------------------------------------------------ L13
@F.pandas_udf(T_.DoubleType())
def _compress_ratio(s: pd.Series) -> pd.Series:
    out = []
    for t in s:
        if t is None or len(t) == 0:
            out.append(None)
            continue
        raw = t.encode("utf-8")
        out.append(len(zlib.compress(raw)) / len(raw))
    return pd.Series(out, dtype="float64")


def compressibility(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Zlib-compressed size / raw UTF-8 size (Arrow-batched UDF)."""
    return docs.select(doc, _compress_ratio(F.col(text)).alias("compressibility"))


# ------------------------------------------------------------------ J13
def attach_features(meta: DataFrame, features: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Features beside the metadata by document id (never by position)."""
    return meta.join(features, doc, "left")
