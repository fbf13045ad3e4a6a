"""KWIC, markup, catalogue XML, BibTeX and JSONL readers on small inputs."""

from pyspark.sql import functions as F

from corpusdelta.operators import senses as SN
from corpusdelta.sources import readers as R


def _kwic_py(tokens, target, win=8):
    out, tmp = [], []
    for tok in tokens:
        if tok.lower() == target:
            out.append(" ".join(tmp[-win:]))
            out.append(tok)
            tmp = []
        else:
            tmp.append(tok)
    out.append(" ".join(tmp[:win]))
    return " & ".join(out)


def test_kwic_matches_sequential_definition(spark):
    sents = [["a", "b", "Model", "c", "d"], ["model"], [], ["x"] * 12 + ["model"] + ["y"] * 3 + ["MODEL"] + ["z"] * 10,
             ["no", "hit", "here"]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sents)], "id long, tokens array<string>")
    got = {r.id: r.kwic for r in SN.kwic(df, "model").collect()}
    for i, s in enumerate(sents):
        assert got[i] == _kwic_py(s, "model"), (i, got[i])


def test_markup_and_xml_body(spark):
    html = ("<html><head><title>T &amp; A</title><style>p{}</style></head><body><!-- c --><script>x()</script>"
            "<p>Hello <b>world</b></p></body></html>")
    df = spark.createDataFrame([(1, html)], "id long, html string")
    r = R.markup_to_document(df, "id").first()
    assert r.title == "T & A" and r.full_text == "Hello world"
    xml = ("<TEI><teiHeader><title>T <hi>1</hi></title><title>no</title><abstract><div>Abs <p>tract</p></div></abstract></teiHeader><text><body>"
           "<div>One <hi>two</hi></div><div type='ack'>skip</div><div><div>three</div></div></body><back><div>four</div></back></text></TEI>")
    x = R.tei_to_document(spark.createDataFrame([(1, xml)], "id long, xml string"), "id").first()
    assert tuple(x) == (1, "T 1", "Abs tract", "One two three")


def test_catalogue_xml_padding(spark):
    xml = ('<collection id="W05"><volume id="3"><venue>ws</venue></volume>'
           '<volume id="12"><venue>a</venue><venue>b</venue></volume></collection>')
    new = '<collection id="2024.acl"><volume id="long"><venue>acl</venue></volume></collection>'
    df = spark.createDataFrame([(xml,), (new,)], "xml string")
    got = {r.acl_volume: (r.venue1, r.venue2, r.venue3) for r in R.xml_volume_venues(df).collect()}
    assert got == {"W05-03": ("ws", None, None), "W05-12": ("a", "b", None), "2024.acl-long": ("acl", None, None)}


def test_bibtex_records(spark):
    rec = ["@inproceedings{key1,\n  title={A title},\n  url={https://host.org/2024.acl-long.1/}",
           "@article{key2,\n  title={B},\n  url={https://host.org/P00-1001}"]
    df = spark.createDataFrame([(r,) for r in rec], "record string")
    got = {r.key: (r.entry_type, r.title, r.acl_id) for r in R.bibtex_to_table(df).collect()}
    assert got == {"key1": ("inproceedings", "A title", "2024.acl-long.1"), "key2": ("article", "B", "P00-1001")}


def test_bibtex_values_of_every_form(spark):
    rec = """@article{k:1,
 title = {{BERT}: Pre-training {of {Deep}} = x},
 year=2024,
 url="https://host.org/N19-1423/",
 Month = jun, abstract = "a {q"}uote, year = 1",
 year = 1999"""
    df = spark.createDataFrame([(rec,), ("no entry",), ("@misc{k2,\n note={}",)], "record string")
    got = {r.key: r for r in R.bibtex_to_table(df).collect()}
    assert set(got) == {"k:1", "k2"}
    assert got["k:1"].fields == {"title": "{BERT}: Pre-training {of {Deep}} = x", "year": "2024", "url": "https://host.org/N19-1423/",
                                 "month": "jun", "abstract": 'a {q"}uote, year = 1'}
    assert (got["k:1"].acl_id, got["k:1"].year, got["k2"].title) == ("N19-1423", "2024", "")


def test_sentences_to_text_and_prefix(spark):
    df = spark.createDataFrame([("d1", [["a", "b"], ["c"]]), (None, [["x"]]), ("d3", [])],
                               "doc_key string, sentences array<array<string>>")
    got = {r.doc_key: r.text for r in R.sentences_to_text(df).collect()}
    assert got == {"d1": "a b c", "": "x"}
    p = spark.createDataFrame([("  coref: wb | _ Hello there",)], "input string").select(R.strip_prefix("input"))
    assert p.first()[0] == "Hello there"


def test_line_files_are_in_order_without_exchanging_tokens(spark, tmp_path):
    from corpusdelta.plans import corpus_plans as CP
    from tests.conftest import SF_SMALL
    for lines in CP._line_files(spark, SF_SMALL):
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Exchange rangepartitioning(doc_id" in plan      # the texts
        places = [(r.doc_id, r.sent_id) for r in lines.select("doc_id", "sent_id").collect()]
        assert places == sorted(places) and len(places) > 500
    CP._write_lines(spark, SF_SMALL, str(tmp_path))
    z = R.zip_lemma_token_lines(spark, f"{tmp_path}/lemmas.txt.gz", f"{tmp_path}/tokens.txt.gz", "t1")
    rows = z.orderBy("sent_id").collect()
    assert len(rows) == len(places) and all(len(r.lemmas) == len(r.tokens) for r in rows)
    assert "regexp_extract_all" not in z._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]


def test_line_numbers_do_not_exchange_the_lines(spark, tmp_path):
    spark.range(0, 500, 1, 5).selectExpr("concat('line ', id) AS value").write.text(f"{tmp_path}/lines")
    numbered = R.line_numbers(spark.read.text(f"{tmp_path}/lines"))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("FileScan", 1)[0] and "SortMergeJoin" not in plan.split("FileScan", 1)[0]
    assert [(r.line_no, r.value) for r in numbered.orderBy("line_no").collect()] == [(i, f"line {i}") for i in range(500)]
