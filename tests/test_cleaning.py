import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from stationflow import schema as S
from stationflow.functions import numbers as N, text as X, times as D
from stationflow.operators import cleaning as C
from stationflow.sources import raw, records, sinks

HEADER = "Data;Hora UTC;TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);PRECIPITAÇÃO TOTAL, HORÁRIO (mm);X"


def station_file(path, rows, header=HEADER, top=8, newline="\r\n"):
    lines = [f"META{i};á" for i in range(top)] + [header] + rows
    path.write_bytes((newline.join(lines) + newline).encode("latin-1"))
    return str(path)


@pytest.fixture
def two_files(tmp_path):
    a = station_file(
        tmp_path / "INMET_S_RS_A881_DOM PEDRITO_01-01-2026_A_31-03-2026.CSV",
        ["2024/01/01;0000 UTC;25,5;0,0;", "2024/01/02;0100 UTC;26,3;2,5;", "2024/01/03;0200 UTC;25,8;;"],
    )
    b = station_file(
        tmp_path / "INMET_CO_DF_A001_BRASÍLIA_01-01-2026_A_31-03-2026.CSV",
        ["2024/01/01;0000 UTC;20,0;", "2024/01/02;01UTC;abc;"],
        header="Data;Hora UTC;TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);X", newline="\n",
    )
    return a, b


def test_station_file_is_read_and_cleaned(spark, two_files):
    df = raw.read_station_csv(spark, two_files[0])
    assert df.columns[2:] == HEADER.split(";")[:-1]
    out = C.clean(df.drop("path")).orderBy("data_hora").collect()
    assert {r["municipio"] for r in out} == {"dom_pedrito"}
    assert [r["temp_ar_c"] for r in out] == [25.5, 26.3, 25.8]
    assert [r["precipitacao_total_mm"] for r in out] == [0.0, 2.5, None]
    assert out[1]["data_hora"] == dt.datetime(2024, 1, 2, 1)


def test_many_files_are_united_by_name(spark, two_files):
    df = C.clean(raw.read_station_csv(spark, list(two_files)).drop("path"))
    rows = df.orderBy("data_hora", "temp_ar_c").collect()
    assert len(rows) == 5
    by_temp = {r["temp_ar_c"]: r["precipitacao_total_mm"] for r in rows}
    assert by_temp[20.0] is None and by_temp[25.5] == 0.0
    assert None in by_temp  # 'abc' is not a number


def test_large_file_is_split(spark, tmp_path):
    rows = [f"2024/01/{1 + i // 24:02d};{i % 24:02d}00 UTC;{i},5;1,0;" for i in range(30 * 24)]
    path = station_file(tmp_path / "x.csv", rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = raw.read_station_csv(spark, path)
        assert raw.raw_lines(spark, path).rdd.getNumPartitions() > 3
        assert df.count() == 720
        assert C.clean(df.drop("path")).agg(F.sum("temp_ar_c")).first()[0] == sum(i + 0.5 for i in range(720))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_broken_files_fail(spark, tmp_path):
    headless = station_file(tmp_path / "a.csv", ["2024/01/01;0000 UTC;1;2;"], header="x;y")
    with pytest.raises(Exception, match="no header"):
        raw.read_station_csv(spark, headless, ["Data"]).collect()
    odd = station_file(tmp_path / "b.csv", ["01.01.2024;0000 UTC;1;2;"])
    with pytest.raises(Exception, match="unreadable lines"):
        raw.read_station_csv(spark, odd, ["Data"]).count() or raw.read_station_csv(spark, odd).collect()
    bad = station_file(tmp_path / "c.csv", ["2024/99/01;0000 UTC;1;2;"])
    with pytest.raises(Exception):
        C.clean(raw.read_station_csv(spark, bad).drop("path")).collect()


def test_bad_hour_fails(spark):
    df = spark.createDataFrame([("2024/01/01", "99xx UTC")], ["Data", "Hora UTC"])
    with pytest.raises(Exception):
        C.combine_date_hour(df).collect()


def test_station_discovery(spark, two_files, tmp_path):
    (tmp_path / "foo.csv").write_text("x")
    rows = raw.discover_station_files(spark, str(tmp_path)).collect()
    found = {(r["municipio"], r["original"]) for r in rows}
    assert found == {("dom_pedrito", "DOM PEDRITO"), ("brasilia", "BRASÍLIA")}


def test_slugs(spark):
    cases = {
        "São José dos Pinhais": "sao_jose_dos_pinhais", "  A--B  ": "a_b", "Æ ½ straße": "12_strae",
        "Ñandú": "nandu", "___": "", "Ｆｕｌｌ": "full",
    }
    df = spark.createDataFrame([(k,) for k in cases], ["n"]).select("n", X.slugify("n").alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == cases


def test_file_names(spark):
    names = ["INMET_S_RS_A881_DOM PEDRITO_01-01-2026_A_31-03-2026.CSV", "inmet_s_rs_a1_x_01-01-2026_a_31-03-2026.csv",
             "foo.csv", "INMET_S_RS_A881_---_01-01-2026_A_31-03-2026.CSV"]
    df = spark.createDataFrame([(n,) for n in names], ["n"]).select("n", X.parse_station_filename("n").alias("p"))
    got = {r["n"]: (r["p"] and tuple(r["p"])) for r in df.collect()}
    assert got[names[0]] == ("DOM PEDRITO", "dom_pedrito")
    assert got[names[1]] == ("x", "x")
    assert got[names[2]] is None and got[names[3]] is None


def test_station_filter(spark):
    df = spark.createDataFrame([("brasilia", 1), ("df_brasilia", 2), ("salvador", 3)], [S.KEY, "v"])
    out = C.filter_stations(df, ["df_brasilia"], [], {"brasilia": "df_brasilia"})
    assert {(r[0], r[1]) for r in out.collect()} == {("df_brasilia", 1), ("df_brasilia", 2)}
    assert C.filter_stations(df, [], ["salvador"]).count() == 2


def test_terms(spark):
    df = spark.createDataFrame([("Porto_Alegre.CSV", "p1"), ("alegre.csv", "p2")], ["name", "path"])
    out = {(r["term"], r["path"]) for r in C.match_terms(df, ["ALEGRE", "porto", "none"]).collect()}
    assert out == {("ALEGRE", "p1"), ("ALEGRE", "p2"), ("porto", "p1"), ("none", None)}
    assert C.match_terms(df, []).count() == 0


def test_numbers(spark):
    cases = {"1,5": 1.5, "-3": -3.0, ",5": 0.5, "1.": 1.0, "1d": None, "NaN": None, "": None, "1,2,3": None, " 7 ": 7.0, "1e3": 1000.0}
    df = spark.createDataFrame([(k,) for k in cases], ["t"]).select("t", N.parse_decimal("t").alias("v"))
    assert {r["t"]: r["v"] for r in df.collect()} == cases


def test_rounding_like_the_printed_binary_value(spark):
    values = [2.675, 0.125, 0.375, 1.005, -2.5, 25.40225, 1234567.125]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", N.round_even("v", 2).alias("r"))
    assert [(r["v"], r["r"]) for r in df.collect()] == [(v, round(v, 2)) for v in values]


def test_staging_files(spark, tmp_path):
    files = spark.createDataFrame([("/s/a/a.csv",), ("/s/a/b.csv",), ("/s/b/b.csv",)], ["path"])
    assert {tuple(r) for r in raw.staging_files(files).collect()} == {("a", "/s/a/a.csv"), ("b", "/s/b/b.csv")}
    assert raw.discover_staging_files(spark, str(tmp_path / "absent")).count() == 0


def make_zip(path, members):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    path.write_bytes(blob.getvalue())


def test_archives(spark, tmp_path):
    make_zip(tmp_path / "one.zip", [("a/data.csv", "1"), ("b/data.csv", "22"), ("c/DATA.CSV", "3"), ("readme.txt", "x")])
    rows = raw.expand_archives(spark, str(tmp_path)).collect()
    assert {(r["name"], bytes(r["content"])) for r in rows} == {("data.csv", b"1"), ("data_1.csv", b"22"), ("DATA.CSV", b"3")}


def test_archives_come_in_parts(spark, tmp_path):
    data = bytes(range(256)) * 40
    make_zip(tmp_path / "one.zip", [("big.csv", data), ("none.csv", b"")])
    rows = raw.expand_archives(spark, str(tmp_path), chunk=1000).orderBy("name", "part").collect()
    assert b"".join(bytes(r.content) for r in rows if r.name == "big.csv") == data
    assert [(r.name, r.part, len(r.content)) for r in rows[-2:]] == [("big.csv", 10, 240), ("none.csv", 0, 0)]
    out = tmp_path / "out"
    out.mkdir()
    (out / "old.csv").write_text("old")
    assert sorted(tuple(r) for r in raw.extract_archives(spark, str(tmp_path), str(out)).collect()) == [("big.csv", 10240), ("none.csv", 0)]
    assert sorted(p.name for p in out.iterdir()) == ["big.csv", "none.csv"] and (out / "big.csv").read_bytes() == data


def test_an_archive_over_two_gigabytes(tmp_path):
    """A sparse file, the archive at its end; the reader opens ranges of it and stays small."""
    import tracemalloc

    from stationflow.sources import streams

    path = tmp_path / "large.zip"
    with open(path, "wb") as f:
        f.truncate((2 << 30) + 12345)
    with zipfile.ZipFile(path, "a", zipfile.ZIP_DEFLATED) as z, z.open("a/data.csv", "w") as member:
        for _ in range(64):
            member.write(b"1,2\n" * (1 << 18))
    assert path.stat().st_size > 2 << 30
    reader = streams.MembersReader(str(tmp_path), 1 << 20)
    tracemalloc.start()
    (partition,) = reader.partitions()
    size = sum(len(b.column("content")[0].as_py()) for b in reader.read(partition))
    assert size == 64 << 20 and tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()


def test_digests_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    files = {"a.txt": b"", "d/b.txt": b"x" * 100_000, "d/_SUCCESS": b"", ".c.txt": b"hidden", "e.csv": b"1"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    from stationflow.sources import features, streams

    got = {r.path.removeprefix(str(tmp_path) + "/"): (r.length, r.sha256) for r in features.file_fingerprint(spark, str(tmp_path), [".txt"]).collect()}
    assert got == {n: (len(files[n]), hashlib.sha256(files[n]).hexdigest()) for n in ("a.txt", "d/b.txt")}
    assert len(streams.DigestReader(str(tmp_path), [], 1000, 50_000).partitions()) == 2
    assert features.file_fingerprint(spark, str(tmp_path / "d"), [".none"]).count() == 0


def test_archive_without_tables_fails(spark, tmp_path):
    make_zip(tmp_path / "two.zip", [("readme.txt", "x")])
    with pytest.raises(Exception, match="no CSV"):
        raw.expand_archives(spark, str(tmp_path)).collect()


PAGE = """<html><a href="/files/inmet_2025.zip">2025</a> <A HREF='files/inmet_2026.zip'>ANO <b>2026</b></A>
<a href="http://x.org/other.zip">2026</a><a href="/about">2026</a><a>none</a></html>"""


def test_archive_links(spark):
    pages = spark.createDataFrame([(1, "https://portal.example.org/dados/historicos", PAGE)], ["page_id", "url", "html"])
    rows = raw.pick_archive_links(pages, [2025, 2026]).collect()
    got = {r["year"]: (r["score"], r["url"]) for r in rows}
    assert got[2026] == (10, "https://portal.example.org/dados/files/inmet_2026.zip")
    assert got[2025][1] == "https://portal.example.org/files/inmet_2025.zip"
    # any archive beats none, also for another year
    assert raw.pick_archive_links(pages, [1999]).first()["score"] == 2
    empty = pages.withColumn("html", F.lit("<a href='/about'>2026</a>"))
    with pytest.raises(Exception, match="no archive link"):
        raw.pick_archive_links(empty, [2026]).collect()
    assert raw.pick_archive_links(empty, [2026], required=False).first()["url"] is None


def test_year_range(spark):
    assert [r[0] for r in raw.year_range(spark, 2020, 2022).collect()] == [2020, 2021, 2022]
    for bad in ((2022, 2020), ("a", 2020), (2020, 2020.5)):
        with pytest.raises(ValueError):
            raw.year_range(spark, *bad)


def test_instants(spark):
    cases = {
        "2024-06-01": dt.datetime(2024, 6, 1), "2024-06-01T14:30:00": dt.datetime(2024, 6, 1, 14, 30),
        "2024-06-01T14:30:00Z": dt.datetime(2024, 6, 1, 14, 30), "2024-06-01 14": dt.datetime(2024, 6, 1, 14),
        "2024-06-01T14:30:00+02:00": dt.datetime(2024, 6, 1, 12, 30), "2024-13-01": None, "2024": None, "x": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], ["t"]).select("t", D.parse_instant("t").alias("v"))
    assert {r["t"]: r["v"] for r in df.collect()} == cases
    with pytest.raises(Exception, match="invalid instant"):
        spark.createDataFrame([("x",)], ["t"]).select(D.parse_instant("t", strict=True)).collect()


def test_time_column(spark):
    known = spark.createDataFrame([("a", "2024-01-01")], ["x", "timestamp"])
    assert C.resolve_time_column(known) == "timestamp"
    guessed = spark.createDataFrame([("a", "2024-01-01 10:00:00")], ["x", "y"])
    assert C.resolve_time_column(guessed) == "y"
    with pytest.raises(ValueError):
        C.resolve_time_column(spark.createDataFrame([("a",)], ["x"]))
    late = spark.range(1500).selectExpr("if(id = 1499, 'no time', '2024-01-01') AS a", "'2024-01-01' AS b")
    assert C.resolve_time_column(late) == "b"


def test_raw_lines_are_not_dropped(spark, tmp_path):
    name = "INMET_S_RS_A881_DOM PEDRITO_01-01-{}_A_31-12-2023.CSV"
    few = tmp_path / "few" / name.format("2023")
    few.parent.mkdir()
    few.write_text("META\n" + HEADER + "\n2023/01/01;0000 UTC;1,0;0,0;\nbroken;0100 UTC;2,0;0,0;\n", "latin-1")
    with pytest.raises(Exception, match="unreadable lines"):
        raw.read_station_csv(spark, str(few.parent)).collect()
    quoted = tmp_path / "quoted" / name.format("2022")
    quoted.parent.mkdir()
    quoted.write_text('META\nData;Hora UTC;V;V;W;\n2023/01/01;0000 UTC;"a;b ""c""";2;3;\n', "latin-1")
    row = raw.read_station_csv(spark, str(quoted.parent)).first()
    assert (row["V"], row["V.1"], row["W"]) == ('a;b "c"', "2", "3")


def test_names_with_signs(spark):
    names = {"Pico \ufb01no": "pico_fino", "\u21167": "no7", "\U0001d400b": "ab", "São José": "sao_jose", "漢": ""}
    df = spark.createDataFrame([(k,) for k in names], ["n"]).select("n", X.slugify("n").alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == names


def test_links_that_need_care(spark):
    html = (
        '<a data-href="bad.zip" href="ok2024.zip" title="2 > 1">x</a><a href=\'a&#38;b.zip\'>caf&eacute;&nbsp;<b>y</b></a><a name="n">no</a><a href="">e</a>'
    )
    links = raw.page_links(spark.createDataFrame([(1, html)], ["page_id", "html"])).orderBy("position").collect()
    assert [(r["href"], r["text"]) for r in links] == [("ok2024.zip", "x"), ("a&b.zip", "café y")]
    cases = {
        ("http://h/a/b/page.html", "../z/2024.zip"): "http://h/a/z/2024.zip", ("http://h/a/b", "./c"): "http://h/a/c",
        ("http://h", "c"): "http://h/c", ("http://h/a/", "../../../c?q=..#x"): "http://h/c?q=..#x", ("http://h/a/b", ".."): "http://h/",
        ("http://h/a/b/c", ".."): "http://h/a/", ("http://h/a/b", "?q"): "http://h/a/b?q", ("https://h/a", "//g/x"): "https://g/x",
    }
    df = spark.createDataFrame(list(cases), ["base", "href"])
    got = df.select("base", "href", raw.resolve_url(F.col("base"), F.col("href")).alias("url")).collect()
    assert {(r["base"], r["href"]): r["url"] for r in got} == cases


def test_staging_replaces_only_its_stations(spark, tmp_path, hourly):
    root = str(tmp_path / "staging")
    sinks.write_staging(hourly(5, station="a"), root)
    sinks.write_staging(hourly(7, station="b"), root)
    sinks.write_staging(hourly(3, station="a"), root)
    counts = {r[0]: r[1] for r in raw.read_staging(spark, root).groupBy(S.KEY).count().collect()}
    assert counts == {"a": 3, "b": 7}


def test_text_and_eval_files(spark, tmp_path):
    lines = tmp_path / "q.txt"
    lines.write_text("  um \n\n dois\n   \n")
    assert [r[0] for r in records.read_text_lines(spark, str(lines)).collect()] == ["um", "dois"]
    data = tmp_path / "e.jsonl"
    data.write_text('{"user_input": "a", "retrieved_contexts": ["x"]}\n\n{"response": "b", "retrieved_contexts": null}\n')
    rows = records.read_eval_set(spark, str(data)).collect()
    assert [tuple(r) for r in rows] == [("a", "", "", ["x"]), ("", "b", "", [])]
    assert records.read_eval_set(spark, str(data), 1).count() == 1


def test_experiment_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"experiment_name": "e",\n "data": {"sequence_length": 168, "horizon": 72}}')
    row = records.read_experiments(spark, str(tmp_path)).first()
    assert (row["experiment_name"], row["epochs"], row["data"]["sequence_length"]) == ("e", 50, 168)
    assert row["data"]["feature_columns"] == S.FEATURE_COLUMNS and row["model"]["model_type"] == "lstm"
    assert row["governance"]["owner"] is None and row["run_name"] is None


def seconds(df, col):
    """Shortest of three runs over all rows."""
    import time

    took = []
    for _ in range(3):
        began = time.perf_counter()
        df.select(F.sum(F.xxhash64(col) % 7)).collect()
        took.append(time.perf_counter() - began)
    return min(took)


def test_long_texts_are_folded_in_time(spark):
    """Texts with a few signs cost a few times what a plain pattern costs (before: about fifty times)."""
    text = F.concat(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" o céu está nublado e chove muito, ")), 100), F.lit("ﬁno №7 漢"))
    df = spark.range(0, 800, 1, 2).select(text.alias("n")).cache()
    df.count()
    assert seconds(df, X.slugify("n")) < 12 * seconds(df, F.regexp_replace("n", "[^a-z0-9]+", "_"))
    assert df.select(X.slugify("n").alias("s")).where("s LIKE '0_o_ceu_esta_nublado%_muito_fino_no7'").count() == 1


def test_every_sign_is_spelt_out(spark):
    names = [f"a{ch}b" for ch in X._FOLD] + ["ﬁﬁ漢№é", "漢", "", None]
    want = ["a" + X._FOLD[n[1:-1]] + "b" for n in names[:-4]] + ["fifiNoe", "", "", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert [r[0] for r in df.orderBy("i").select(X.fold_ascii("n")).collect()] == want


def test_file_names_are_read_once(spark):
    """A name's parts cost a few times what its pattern costs (before: the slug was made again for each use)."""
    name = F.concat(F.lit("INMET_S_RS_A1_Sao "), F.col("id").cast("string"), F.lit(" do Sul_01-01-2026_A_31-03-2026.CSV"))
    df = spark.range(0, 40_000, 1, 2).select(name.alias("n")).cache()
    df.count()
    p = X.parse_station_filename("n")
    pattern = F.regexp_extract("n", S.STATION_FILE_PATTERN, 1)
    assert seconds(df, F.concat(p["original"], p["slug"])) < 15 * seconds(df, pattern)
    assert df.select(p["slug"].alias("s")).where("s = 'sao_7_do_sul'").count() == 1


def test_many_small_files_are_written_by_tasks(spark, tmp_path):
    """A file for each key, nothing moved afterwards; readers deal files by number as well as by bytes."""
    import hashlib

    from stationflow.sources import features, streams

    rows = [(s, b, i, f"{i} é") for s in ("a b", "x/y", "100%+", None) for b in range(300) for i in (2, 1)]
    df = spark.createDataFrame(rows, "source string, block int, id int, value string")
    assert streams.write_lines(df, str(tmp_path / "out"), ["source", "block"], ["id"]) == 1200
    names = [p for p, _ in streams.files_under(str(tmp_path / "out"))]
    assert len(names) == 1200 and all(p.endswith("/lines.txt") for p in names)
    got = features.file_fingerprint(spark, str(tmp_path / "out"), [".txt"]).collect()
    assert {(r.length, r.sha256) for r in got} == {(10, hashlib.sha256("1 é\n2 é\n".encode()).hexdigest())}
    assert len(got) == 1200 and len(streams.DigestReader(str(tmp_path / "out"), [], 1000, 1 << 30).partitions()) == 3
    assert streams.write_lines(df.limit(0), str(tmp_path / "none"), ["source"], ["id"]) == 0
    assert features.file_fingerprint(spark, str(tmp_path / "none")).count() == 0
