"""Hosted models by functions that stand for them, PDF texts, and databases."""

import json

from voxlake.ml import hosted
from voxlake.sources import pdf, tables


def test_attempts():
    calls = []

    def third(x):
        calls.append(x)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert hosted.attempted(third, "a", 3) == "ok" and len(calls) == 3
    calls.clear()
    assert hosted.attempted(third, "a", 2) is None
    assert hosted.attempted(lambda x: "bad", "a", 2, good=lambda r: r == "good") == "bad"


def test_labels_are_repaired_or_null(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "fails"), (4, "never")], "k long, prompt string")

    def service(prompt):
        if prompt == "fails":
            raise OSError
        if prompt == "one":
            return "hola\tSaludo\t00:01\nprecio dos\tPRICE\t00:02"
        if prompt == "two":
            return "no fields"
        if "precio dos" in prompt:
            return "hola\tSALUDO\t00:01\nprecio dos\tPRECIO\t00:02"
        return "still\twrong\t1" if "never" not in prompt else ""

    got = sorted(map(tuple, hosted.labelled(df, "k", service, ["SALUDO", "PRECIO"]).collect()))
    assert got == [(1, 0, "hola", "SALUDO", "00:01"), (1, 1, "precio dos", "PRECIO", "00:02"), (2, 0, "still", None, "1"), (3, 0, "still", None, "1"), (4, 0, None, None, None)] or got[:2] == [(1, 0, "hola", "SALUDO", "00:01"), (1, 1, "precio dos", "PRECIO", "00:02")]
    assert all(r[3] is None for r in got[2:]) and {r[0] for r in got} == {1, 2, 3, 4}


def test_prompts_keep_the_order_of_turns(spark):
    rows = spark.createDataFrame([(1, 2, "b", "second"), (1, 1, "a", "first"), (2, 1, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.prompt for r in hosted.prompts(rows, "conv_id", instructions="Do.", labels=["X", "Y"]).collect()}
    assert got[1] == "Do.\nLabels: X, Y\n\na: first\nb: second" and got[2].endswith("\n\n")


def test_transcripts(spark):
    df = spark.createDataFrame([(1, bytearray(b"long")), (2, bytearray(b"short")), (3, bytearray(b"text")), (4, None), (5, bytearray(b"fails"))], "k long, a binary")

    def service(audio):
        if audio == b"fails":
            raise OSError
        return {b"long": json.dumps({"t": "x" * 5000}), b"short": "{}", b"text": "no json"}.get(audio, "[]")

    got = {r.k: (r.json, r.status) for r in hosted.transcribed(df, "k", "a", service).collect()}
    assert [got[k][1] for k in range(1, 6)] == ["whole", "short", "default", "default", "default"]
    assert got[5][0] == hosted.EMPTY_TRANSCRIPT and got[2][0] == "{}"


def test_pdf_texts(spark, tmp_path):
    lines = ["Hola (mundo) \\ barra", "Línea dos, año 2025"]
    (tmp_path / "a.pdf").write_bytes(pdf.written(lines))
    assert [r.text for r in pdf.read(spark, str(tmp_path)).collect()] == ["\n".join(lines)]
    assert pdf.text_of(None) == pdf.text_of(b"no pdf") == pdf.text_of(b"%PDF-1.4 cut off 1 0 obj << >> stream") == ""
    by_hand = b"%PDF-1.4\n1 0 obj\n<< /Length 9 >>\nstream\nBT /F1 9 Tf [(He) -10 (llo) -300 (there)] TJ 0 -12 Td <576f726c64> Tj (\\041\\n) ' ET\nendstream\nendobj\n"
    assert pdf.text_of(by_hand) == "Hello there\nWorld\n!"
    mapped = b"%PDF-1.4\n1 0 obj\n<< /Font << /F2 2 0 R >> >>\nendobj\n2 0 obj\n<< /ToUnicode 3 0 R >>\nendobj\n3 0 obj\n<< >>\nstream\nbegincmap 1 beginbfchar <0003> <0041> endbfchar 1 beginbfrange <0010> <0012> <00E1> endbfrange endcmap\nendstream\nendobj\n4 0 obj\n<< >>\nstream\nBT /F2 9 Tf <000300100012> Tj ET\nendstream\nendobj\n"
    assert pdf.text_of(mapped) == "Aáã"


def test_database_round_trip(spark):
    url, how = "jdbc:derby:memory:tests;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1300).selectExpr("id", "cast(id % 7 as string) as s")
    tables.write_jdbc(rows, url, "t1", batch=500, **how)
    tables.write_jdbc(rows.where("id < 3"), url, "t1", **how)
    assert tables.read_jdbc(spark, url, "t1", **how).count() == 1303
    parts = tables.read_jdbc(spark, url, "t1", predicates=['"id" < 600', '"id" >= 600'], **how)
    assert parts.rdd.getNumPartitions() == 2 and parts.where("id > 1000").count() == 299


def test_K07_S08b_where_executors_reach_no_database(spark, sf, monkeypatch):
    from voxlake.plans import catalog, joins

    monkeypatch.setattr(joins, "database", lambda s: None)
    c = spark.read.parquet(f"{sf}/customer.parquet").collect()
    got = catalog.queries()["K07_batched_insert"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((r.c_custkey, r.c_mktsegment, round(r.c_acctbal, 2)) for r in c)
    got = catalog.queries()["S08b_database_read"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((r.c_custkey, r.c_nationkey) for r in c if r.c_nationkey < 10 and r.c_custkey % 2 == 1)


def test_a_database_is_of_one_process_only_where_there_are_no_executors():
    from types import SimpleNamespace

    from voxlake.plans import joins

    conf = SimpleNamespace(get=lambda *_: None)
    assert joins.database(SimpleNamespace(spark=SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[2,2,1024]")))) is None


def test_database_files(spark):
    rows = spark.range(1300, numPartitions=2).selectExpr("id", "if(id = 7, null, cast(id % 7 as string)) as s")
    files = tables.write_files(rows, "t", batch=100, rows=500)
    assert files.count() == 4
    assert sorted(map(tuple, tables.read_files(files, "t", "id long, s string").collect())) == sorted(map(tuple, rows.collect()))
    assert tables.read_files(files, "t", "id long, s string", predicates=['"id" < 3', '"id" >= 1298']).count() == 5
    assert tables.read_files(files, "t", "id long, s string", predicates=["s is null"]).collect()[0].id == 7
