"""Readers (S1-S13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: prefix stripped from model inputs
INPUT_PREFIX = r"^\s*coref:\s*wb\s*\|\s*_\s*"


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Open by suffix: ``.parquet``, ``.csv`` (header), ``.tsv`` (tab,
    header); anything else is an error (pickles are not supported)."""
    p = path.rstrip("/")
    if p.endswith(".parquet"):
        return spark.read.options(**options).parquet(path)
    if p.endswith(".csv"):
        return spark.read.options(header=True, **options).csv(path)
    if p.endswith(".tsv"):
        return spark.read.options(header=True, sep="\t", **options).csv(path)
    raise ValueError(f"unsupported table format: {path}")


def nonempty_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop NULL and empty texts (pushed into the Parquet scan)."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != ""))


def split_line(line) -> "F.Column":
    """``str.split()``: whitespace-separated pieces, [] for a blank line."""
    c = F.col(line) if isinstance(line, str) else line
    return F.regexp_extract_all(c, F.lit(r"\S+"), 0)


def read_sentence_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """S3: one sentence per line, space-separated tokens; compressed files
    are decoded by suffix. Returns ``(tokens array<string>)``."""
    return spark.read.text(path).select(split_line("value").alias("tokens"))


def line_numbers(df: DataFrame, name: str = "line_no") -> DataFrame:
    """Consecutive 0-based line numbers in file order for a text-source
    DataFrame: files sorted by path, splits by start offset, rows in split
    order.

    A count and the first row id of each file split (one row per split) give
    the offsets inside a file, and one row per file those of the files, so no
    window spans all splits. The offsets, one row per split, are broadcast, so
    the lines are not exchanged."""
    split = ["_f", "_b"]
    part = (df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
            .withColumn("_m", F.monotonically_increasing_id()))
    counts = part.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy("_f").agg(F.sum("_n").alias("_lines"))
    earlier = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_f", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_start"))
    adj = counts.join(files, "_f").select(*split, (F.col("_start") + F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_m0")).alias("_adj"))
    return (part.join(F.broadcast(adj), split)
            .withColumn(name, (F.col("_m") + F.col("_adj")).cast("long"))
            .drop(*split, "_m", "_adj"))


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Keep the paths that exist (Hadoop file system check on the driver)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            out.append(p)
    return out


def zip_lemma_token_lines(spark: SparkSession, lemma_path: str, token_path: str,
                          time: str) -> DataFrame:
    """Pair two parallel line files by line number, tag with ``time``;
    unequal line counts raise. Returns ``(time, sent_id, lemmas, tokens)``."""
    lem = line_numbers(spark.read.text(lemma_path)).select("line_no", F.col("value").alias("lemmas"))
    tok = line_numbers(spark.read.text(token_path)).select("line_no", F.col("value").alias("tokens"))
    nl, nt = spark.read.text(lemma_path).count(), spark.read.text(token_path).count()
    if nl != nt:
        raise ValueError(f"line counts differ: {nl} vs {nt}")
    # lines are split after they met: arrays of short words are some times as large
    return (lem.join(tok, "line_no").select(F.lit(time).alias("time"), F.col("line_no").alias("sent_id"),
                                            split_line("lemmas").alias("lemmas"), split_line("tokens").alias("tokens")))


def read_freq_tsv(spark: SparkSession, path: str, n: int = 1) -> DataFrame:
    """Headerless TSV without quoting: n n-gram columns then the count.
    Returns ``(target, freq)`` with the n-gram space-joined."""
    schema = T.StructType([T.StructField(f"w{i}", T.StringType()) for i in range(n)]
                          + [T.StructField("freq", T.LongType())])
    df = spark.read.options(sep="\t", quote="", header=False).schema(schema).csv(path)
    return df.select(F.concat_ws(" ", *[F.col(f"w{i}") for i in range(n)]).alias("target"), "freq")


SENTENCES_SCHEMA = T.StructType([T.StructField("doc_key", T.StringType()),
                                 T.StructField("sentences", T.ArrayType(T.ArrayType(T.StringType())))])


def jsonl_sentences_to_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """JSONL with ``sentences`` (array of token arrays) -> one text per
    record; empty texts skipped; missing ``doc_key`` -> ''."""
    df = spark.read.schema(SENTENCES_SCHEMA).json(path)
    return sentences_to_text(df)


def sentences_to_text(df: DataFrame) -> DataFrame:
    out = df.select(F.coalesce("doc_key", F.lit("")).alias("doc_key"),
                    F.array_join(F.flatten("sentences"), " ").alias("text"))
    return out.filter(F.col("text").isNotNull() & (F.col("text") != ""))


def jsonl_strip_prefix(spark: SparkSession, paths: Sequence[str], tag_pattern: str = r"_([^_/]+)\.jsonl$"
                       ) -> DataFrame:
    """JSONL ``input`` with the coreference prefix stripped, tagged with
    ``size`` from the file name; missing files are skipped."""
    df = (spark.read.option("ignoreMissingFiles", "true")
          .schema(T.StructType([T.StructField("input", T.StringType())]))
          .json(existing_paths(spark, paths)))
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), tag_pattern, 1).alias("size"),
                     strip_prefix("input").alias("text"))


def strip_prefix(col) -> "F.Column":
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, INPUT_PREFIX, "")


VENUE_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("volume", T.ArrayType(T.StructType([
        T.StructField("_id", T.StringType()),
        T.StructField("venue", T.ArrayType(T.StringType()))])))])


def xml_volume_venues(xml_col: DataFrame, col: str = "xml") -> DataFrame:
    """Catalogue XML (one ``<collection id>`` per record with volumes and
    venues) -> ``(acl_volume, venues, venue1, venue2, venue3)``; workshop
    (``W``) volume ids are zero-padded to two digits."""
    parsed = xml_col.select(F.from_xml(F.col(col), VENUE_SCHEMA).alias("c"))
    v = parsed.select(F.col("c._id").alias("cid"), F.explode("c.volume").alias("v"))
    vid = F.col("v._id")
    vid = F.when(F.col("cid").startswith("W") & (F.length(vid) < 2), F.lpad(vid, 2, "0")).otherwise(vid)
    return v.select(F.concat(F.col("cid"), F.lit("-"), vid).alias("acl_volume"),
                    F.col("v.venue").alias("venues")) \
        .select("acl_volume", "venues",
                *[F.try_element_at("venues", F.lit(i + 1)).alias(f"venue{i + 1}") for i in range(3)])


def read_xml_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """S8 file form: Spark's XML source with one row per ``collection``."""
    return spark.read.format("xml").option("rowTag", "collection").schema(VENUE_SCHEMA).load(path)


# fixed values: markup clean-up chain for HTML
HTML_DROP = [r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>"]


def html_to_text(col) -> "F.Column":
    """S9, HTML path: drop comments, scripts and styles, then tags; decode
    the common entities; collapse blanks."""
    c = F.col(col) if isinstance(col, str) else col
    for p in HTML_DROP:
        c = F.regexp_replace(c, p, " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def markup_to_document(df: DataFrame, id_col: str, markup: str = "html") -> DataFrame:
    """Page -> ``id, title, abstract, full_text``; the text is the cleaned
    content of the ``<body>`` element, an absent element gives ''."""
    m = F.col(markup)

    def part(tag):
        greedy = ".*" if tag == "body" else ".*?"
        return html_to_text(F.regexp_extract(m, rf"(?is)<{tag}\b[^>]*>({greedy})</{tag}>", 1))
    return df.select(F.col(id_col).alias("id"), part("title").alias("title"), part("abstract").alias("abstract"),
                     part("body").alias("full_text"))


def _xml_text(col, path: str) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.array_join(F.xpath(c, F.lit(path)), " "), r"\s+", " "))


def xml_body_text(col) -> "F.Column":
    """S9, well-formed XML path: text nodes of the body's ``div`` elements
    without a ``type`` attribute, each node once, joined by a space, blanks
    collapsed. Header and back matter are outside the body."""
    return _xml_text(col, "//body//div[not(@type)]//text()")


def tei_to_document(df: DataFrame, id_col: str, xml: str = "xml") -> DataFrame:
    """S9, well-formed XML path: ``id, title, abstract, full_text``; the title
    is the document's first one."""
    return df.select(F.col(id_col).alias("id"), _xml_text(xml, "(//title)[1]//text()").alias("title"),
                     _xml_text(xml, "//abstract//text()").alias("abstract"), xml_body_text(xml).alias("full_text"))


def bibtex_records(spark: SparkSession, path: str) -> DataFrame:
    """S10 file form: records split at ``\\n}\\n`` by the text source."""
    return spark.read.option("lineSep", "\n}\n").text(path).withColumnRenamed("value", "record")


def _braced(depth: int) -> str:
    """A pattern of balanced braces, nested up to ``depth`` times."""
    inner = r"\{[^{}]*+\}"
    for _ in range(depth):
        inner = r"\{(?:[^{}]++|" + inner + r")*+\}"
    return inner


#: Braces inside braces that a BibTeX value may hold.
BIBTEX_DEPTH = 6
_BIB_VALUE = (_braced(BIBTEX_DEPTH) + r'|"(?:[^"{}]++|' + _braced(BIBTEX_DEPTH) + r')*+"|[^\s,{}"]++')


def bibtex_to_table(df: DataFrame, record: str = "record",
                    fields: Sequence[str] = ("title", "author", "year", "url")) -> DataFrame:
    """One row per entry: type, key, ``fields`` (a map of every field of
    the entry, names in lower case), the requested fields as columns ('' if
    absent) and the id taken from the URL. Values stand in braces (nested ones
    are kept), in quotes, or bare."""
    r = F.col(record)
    head = r"^\s*@\w+\s*\{[^,]*,"
    found = F.regexp_extract_all(F.regexp_replace(r, head, ""), F.lit(r"(?s)([A-Za-z][\w-]*)\s*=\s*(?:" + _BIB_VALUE + ")"), 0)
    pairs = F.transform(found, lambda x: F.struct(
        F.lower(F.regexp_extract(x, r"^([A-Za-z][\w-]*)", 1)).alias("k"),
        F.regexp_replace(F.regexp_extract(x, r"(?s)^[A-Za-z][\w-]*\s*=\s*(.*)$", 1), r'(?s)^(?:\{(.*)\}|"(.*)")$', "$1$2").alias("v")))
    # a repeated field keeps its first value
    first = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["k"]), x["k"]) == i + 1)
    out = df.select(F.regexp_extract(r, r"@(\w+)\s*\{", 1).alias("entry_type"),
                    F.regexp_extract(r, r"@\w+\s*\{\s*([^,\s]+)\s*,", 1).alias("key"),
                    F.map_from_entries(first).alias("fields"))
    out = out.filter(F.col("entry_type") != "")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit("")))
    from corpusdelta.functions.text import id_from_url
    return out.withColumn("acl_id", id_from_url(F.try_element_at("fields", F.lit("url"))))


def union_tag_by_file(spark: SparkSession, paths: Sequence[str], pattern: str,
                      tag: str = "name", exclude: str | None = None) -> DataFrame:
    """One multi-path read; each row tagged with a name taken from its
    file name by ``pattern`` (first group); optional exclude pattern."""
    df = spark.read.parquet(*paths)
    fn = F.col("_metadata.file_path")
    df = df.withColumn(tag, F.regexp_extract(fn, pattern, 1))
    if exclude:
        df = df.filter(~fn.rlike(exclude))
    return df


def union_common_columns(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union on the intersection of columns, in the first table's order
    (a schema decision on the driver; no data is read for it)."""
    cols = list(dfs[0].columns)
    for d in dfs[1:]:
        cols = [c for c in cols if c in d.columns]
    out = dfs[0].select(*cols)
    for d in dfs[1:]:
        out = out.unionByName(d.select(*cols))
    return out


def read_run_reports(spark: SparkSession, json_path: str, features_path: str | None = None):
    """One JSON result per fold; optional per-fold feature lists (one
    feature per line, fold from the file name)."""
    res = spark.read.json(json_path)
    if features_path is None:
        return res
    feats = (spark.read.text(features_path)
             .select(F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]+)", 1).cast("int").alias("fold"),
                     F.trim("value").alias("feature")).filter(F.col("feature") != ""))
    return res, feats
