import zipfile

import pytest

from mergewright.sources import mapping, readers, sinks
from mergewright.streaming.incremental import watch


@pytest.mark.parametrize("name, field", [("Ad Soyad", "name"), ("EMAIL_ADDRESS", "email"), ("AÇIK-ADRES", "address"), ("Cep_Telefonu", "phone"), ("Şehir", "city"), ("TCKN", "tc"), ("Müşteri Kodu", "muhatap_no"), ("other", "ignored")])
def test_headers(name, field):
    assert mapping.field_of(name) == field


def test_mapping(spark):
    df = spark.createDataFrame([("Ali", "Veli", "5", "x")], "Ad string, Soyad string, Tel string, Notes string")
    row = mapping.apply(df).head()
    assert row["Ad Soyad"] == "Ali Veli" and row["Telefon"] == "5" and row["E-mail"] == ""
    assert mapping.apply(df, {"Notes": "name"}).head()["Ad Soyad"] == "x"
    with pytest.raises(ValueError):
        mapping.apply(df.select("Tel"))
    assert mapping.suggest(spark, df.columns).where("mapping_type = 'ignored'").count() == 1


def test_csv(spark, tmp_path):
    for code in ("utf-8", "latin-1"):
        (tmp_path / f"{code}.csv").write_bytes("Ad Soyad,Telefon\nçağ,0532\n".replace("ğ", "g").encode(code))
        r = readers.file(spark, str(tmp_path / f"{code}.csv")).head()
        assert (r[0], r[1]) == ("çag", "0532")
    (tmp_path / "x.doc").write_text("x")
    with pytest.raises(ValueError):
        readers.file(spark, str(tmp_path / "x.doc"))


def test_csv_encoding_is_decided_on_all_bytes(spark, tmp_path):
    rows = "Ad Soyad,Telefon\n" + "".join(f"Ali {i},{i}\n" for i in range(400))
    for name, text, code in (("late", "Çigdem", "latin-1"), ("late8", "Çiğdem", "utf-8"), ("sign", "Çiğdem \ufffd", "utf-8")):
        lines = rows + text + ",0532\n" if name != "sign" else "Ad Soyad,Telefon\n" + text + ",0532\n"
        (tmp_path / f"{name}.csv").write_bytes(lines.encode(code))
        got = readers.file(spark, str(tmp_path / f"{name}.csv")).where("Telefon = '0532'").collect()
        assert [r[0] for r in got] == [text]


def test_excel(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Telefon</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>532</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Ad Soyad</t></si><si><t>Ali</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    df = readers.file(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["Ad Soyad", "column_2", "Telefon"] and tuple(df.head()) == ("Ali", "", "532")


def test_sql_guard(spark):
    assert readers.sql(spark, "select 1 as a;").head().a == 1
    for bad in ("drop table x", "select 1; select 2", "insert into x values (1)"):
        with pytest.raises(ValueError):
            readers.read_only(bad)
    with pytest.raises(ValueError):
        readers.identifier("a;b")
    assert readers.healthy(spark) and readers.masked({"url": "u", "password": "p"})["password"] == "***"


def test_records(spark):
    df = readers.records(spark, [{"adSoyad": "A", "x": 1}, {"email": None}])
    assert df.count() == 2 and df.where("email = ''").count() == 2
    other = spark.createDataFrame([("", "B")], "adSoyad string, name string")
    assert readers.pick_records(other).head().adSoyad == "B"
    assert readers.payload_rows({"data": [{"a": 1}]}) == [{"a": 1}]


def test_sinks(spark, tmp_path):
    raw = sinks.raw_rows(spark.createDataFrame([("b",), ("a",), ("c",)], "n string"), 3, ["n"])
    assert [(r.row_index, r.raw_payload["n"]) for r in raw.orderBy("row_index").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    df = spark.createDataFrame([(1, None, {"a": "b"})], "x int, y string, z map<string,string>")
    assert tuple(sinks.csv_view(df, ["z", "y", "w"]).head()) == ('{"a":"b"}', "", "")
    sinks.export_csv(df.limit(0), str(tmp_path / "o"), single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).columns == ["x", "y", "z"]
    new = sinks.insert_new(df.select("x"), spark.createDataFrame([(1,), (2,), (2,)], "x int"), ["x"])
    assert [r.x for r in new.collect()] == [2]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    ddl = "record_id long, name string, tc string, phone string, email string, city string, address string, muhatap_no string"
    for i in range(2):
        spark.createDataFrame([(i, f"Ali {i}", "12345678901", "", "", "", "", "")], ddl).coalesce(1).write.mode("append").parquet(str(src))
        watch(spark, str(src), spark.read.parquet(str(src)).schema, str(tmp_path / "r"), str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination()
    assert [(r.left_id, r.right_id) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [(0, 1)]
