"""Documents -> sentences -> tokens.

The token table is the workhorse of every later step; it is produced with
``posexplode`` over built-in array expressions, so no Python runs per row and
no shuffle happens apart from the optional spread of a narrow scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusdelta.functions import text as T
from corpusdelta.session import spread


def _keep(keep: Sequence[str]) -> list:
    return [F.col(k) for k in keep]


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              keep: Sequence[str] = (), dealt: bool = False) -> DataFrame:
    """one row per sentence ``(keep..., doc_id, sent_id, sentence)``;
    ``sent_id`` counts from 0 inside the document. With ``dealt`` the documents
    stay in the partitions that they were dealt to by ``id_col``."""
    d = docs if dealt else spread(docs, id_col)
    return d.select(*_keep(keep), F.col(id_col),
                    F.posexplode(T.sentence_array(text_col)).alias("sent_id", "sentence"))


def sentence_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    keep: Sequence[str] = ()) -> DataFrame:
    """Sentences with their token array ``tokens`` (D6 without lemmas)."""
    s = sentences(docs, id_col, text_col, keep)
    return s.select(*_keep(keep), id_col, "sent_id", T.token_array("sentence").alias("tokens"))


def sentence_targets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     keep: Sequence[str] = (), dealt: bool = False) -> DataFrame:
    """Per sentence the token array and the ``lemma:UPOS`` array.

    Tokens are exploded and annotated with code-generated expressions, then
    put back together per sentence; the grouping key contains the document
    id, so the doc-id partitioning satisfies it without an exchange."""
    t = annotate_tokens(tokenize(docs, id_col, text_col, keep, dealt))
    g = (t.groupBy(*keep, id_col, "sent_id")
         .agg(F.array_sort(F.collect_list(F.struct("pos_in_sent", "token", "target"))).alias("_s")))
    return g.select(*_keep(keep), id_col, "sent_id", F.col("_s.token").alias("tokens"),
                    F.col("_s.target").alias("targets"))


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             keep: Sequence[str] = (), dealt: bool = False) -> DataFrame:
    """one row per token ``(keep..., doc_id, sent_id, pos_in_sent, token)``."""
    s = sentences(docs, id_col, text_col, keep, dealt)
    return s.select(*_keep(keep), id_col, "sent_id",
                    F.posexplode(T.token_array("sentence")).alias("pos_in_sent", "token"))


def annotate_tokens(tokens: DataFrame, token_col: str = "token", pos: bool = True,
                    lowercase: bool = True, annotator=None) -> DataFrame:
    """add ``upos``, ``lemma`` and ``target`` (``lemma:UPOS``, or the
    lemma alone with ``pos=False``).

    ``annotator`` is the plug point for an external tagger: a function
    ``pandas.DataFrame -> pandas.DataFrame`` run through ``mapInPandas`` that
    must return the input columns plus ``lemma`` and ``upos`` (D5 schema).
    """
    if annotator is not None:
        schema = tokens.schema.add("lemma", "string").add("upos", "string")
        out = tokens.mapInPandas(lambda it: (annotator(b) for b in it), schema)
    else:
        tok = F.col(token_col)
        out = (tokens.withColumn("upos", T.upos(tok))
               .withColumn("lemma", T.lemma(tok, F.col("upos"))))
    if lowercase and annotator is not None:
        # built-in tokens are lowercase already; external lemmas may not be
        out = out.withColumn("lemma", F.lower("lemma"))
    target = T.tagged("lemma", "upos") if pos else F.col("lemma")
    return out.withColumn("target", target)


def rebuild_lines(tokens: DataFrame, by: Sequence[str] = ("doc_id", "sent_id"),
                  order_col: str = "pos_in_sent", value_col: str = "target") -> DataFrame:
    """tokens -> one space-joined line per sentence (order by position).

    Groups are single sentences, so ``collect_list`` is bounded by sentence
    length."""
    return (tokens.groupBy(*by)
            .agg(F.array_sort(F.collect_list(F.struct(order_col, value_col))).alias("_s"))
            .select(*by, F.array_join(F.col("_s." + value_col), " ").alias("line")))


def sentence_windows(docs: DataFrame, size: int = 5, id_col: str = "doc_id",
                     text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Tumbling runs of ``size`` sentences per document (last partial run
    kept), metadata copied, sentences joined by a space.

    Array-native: no shuffle, no window function. ``win_no`` restarts per
    document, so ``(doc_id, win_no)`` is the stable key (W4)."""
    d = spread(docs, id_col)
    sents = T.sentence_array(text_col)
    starts = F.when(F.size(sents) > 0, F.sequence(F.lit(0), F.size(sents) - 1, F.lit(size))
                    ).otherwise(F.array().cast("array<int>"))
    wins = F.transform(starts, lambda i: F.array_join(F.slice(sents, i + 1, size), " "))
    return d.select(*_keep(keep), F.col(id_col),
                    F.posexplode(wins).alias("win_no", "text"))


def dense_ids(df: DataFrame, order_cols: Sequence[str], id_name: str = "ID") -> DataFrame:
    """Consecutive 0-based ids in ``order_cols`` order without a global
    window over the rows: range-partition, count rows per partition, join the
    counts' running sum (one row per partition) and add the local row number."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    # cut lineage so the counting pass and the numbering pass see the same rows
    ranged = ranged.checkpoint(eager=True).withColumn("_part", F.spark_partition_id())
    # monotonically_increasing_id restarts at partition_id << 33 per partition
    local = F.monotonically_increasing_id() - (F.col("_part").cast("long") * F.lit(1 << 33))
    numbered = ranged.withColumn("_local", local)
    before = partition_offsets(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_part", "_n")
    return (numbered.join(F.broadcast(before), "_part")
            .withColumn(id_name, (F.col("_before") + F.col("_local")).cast("long"))
            .drop("_part", "_local", "_before"))


def partition_offsets(counts: DataFrame, part: str, n: str) -> DataFrame:
    """``(part, _before)``: rows in all partitions before each. ``counts`` has
    one row per partition of a job, so one window over it is bounded."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long").alias("_before"))


def _with_offsets(r: DataFrame, by: Sequence[str], total: "F.Column") -> DataFrame:
    """Add ``_offset_p``: the total of a row's group in the range partitions before
    its own. A group inside one partition needs none, and at most (partitions
    - 1) groups cross a boundary, so the joined table has at most twice as many
    rows as there are partitions, whatever the number of groups. Group values
    are compared null-safe in their own type."""
    tots = r.groupBy("_p", *by).agg(total.alias("_s"))
    w = Window.partitionBy(*by)
    before = w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    off = (tots.withColumn("_np", F.count(F.lit(1)).over(w)).withColumn("_offset_p", F.sum("_s").over(before))
           .where("_np > 1 AND _offset_p IS NOT NULL"))
    off = off.select(F.col("_p").alias("_op"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(by)], "_offset_p")
    on = F.col("_p") == F.col("_op")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    out = r.join(F.broadcast(off), on, "left").withColumn("_offset_p", F.coalesce("_offset_p", F.lit(0)))
    return out.drop("_op", *[f"_o{i}" for i in range(len(by))])


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """1-based ``row_number`` inside each ``by`` group in ``order`` without
    sorting a whole group in one task: range-partition on (by, order), rank
    inside each partition, and add per-partition offsets for the few groups
    that span several partitions. Groups of any size (a class holding half
    the rows) spread over many tasks."""
    from corpusdelta.session import cut
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(c) for c in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    r = df.withColumn("_ok", F.struct(*keys)).repartitionByRange(n, "_ok").sortWithinPartitions("_ok")
    r = cut(r.withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p", *by).orderBy("_ok")      # bounded by one range partition
    return (_with_offsets(r, by, F.count(F.lit(1)))
            .withColumn(name, (F.col("_offset_p") + F.row_number().over(w)).cast("long"))
            .drop("_ok", "_p", "_offset_p"))


def cumsum_within(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str,
                  name: str = "cum") -> DataFrame:
    """Exclusive running sum of ``value`` inside each ``by`` group in
    ``order`` (sum over the rows before), computed like :func:`rank_within`.
    Works for many groups (e.g. one per document): only groups crossing a
    partition boundary get an offset."""
    from corpusdelta.session import cut
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    r = df.withColumn("_ok", F.struct(*[F.col(c) for c in list(by) + list(order)]))
    r = cut(r.repartitionByRange(n, "_ok").withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p", *by).orderBy("_ok").rowsBetween(Window.unboundedPreceding, -1)
    return (_with_offsets(r, by, F.sum(value))
            .withColumn(name, (F.col("_offset_p") + F.coalesce(F.sum(value).over(w), F.lit(0))).cast("long"))
            .drop("_ok", "_p", "_offset_p"))
