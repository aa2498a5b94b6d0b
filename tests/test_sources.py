from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.sources.csv_source import seed_demo, with_row_numbers
from granary.sources.files import Files
from granary.streaming.ingest import watch


def test_ingest_creates_a_table(session, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,nombre,valor\n" + "".join(f"{i},item_{i},{1.1 * i}\n" for i in range(1, 51)))
    seen = []
    assert session.ingest(str(path), "items", lambda done, total: seen.append((done, total))) == 50
    assert seen[-1] == (50, 50)
    assert [(f.name, f.type) for f in session.catalog.table("items").fields] == [("id", "INTEGER"), ("nombre", "STRING"), ("valor", "FLOAT")]
    assert session.ingest(str(path), "items") == 50 and session.table("items").count() == 100


def test_ingest_without_rows_creates_nothing(session, tmp_path):
    for text in ("", "a,b\n"):
        (tmp_path / "e.csv").write_text(text)
        assert session.ingest(str(tmp_path / "e.csv"), "t") == 0
    assert "t" not in session.catalog.tables


def test_ingest_long_and_blank_headers(session, tmp_path):
    long = "a_header_that_is_longer_than_thirty_characters"
    (tmp_path / "h.csv").write_text(f" id ,{long},,x\n1,7,9,2.5\n2,,9,\n")
    session.ingest(str(tmp_path / "h.csv"), "h", spatial_columns=("id", "x"))
    rows = session.table("h").orderBy("id").collect()
    assert rows[0].asDict() == {"id": 1, long[:30]: 7, "x": 2.5} and rows[1][long[:30]] == 0
    assert session.catalog.table("h").spatial == ("id", "x")


def test_create_from_file(session, tmp_path):
    (tmp_path / "c.csv").write_text("b,a\n2.5,1\nno,4\n")
    found = session.execute(f"CREATE TABLE c (a INT, b FLOAT, z STRING(3)) INDEX (BTREE a) FROM FILE '{tmp_path}/c.csv'")
    assert found.message == f"Table 'c' created and loaded 2 rows from '{tmp_path}/c.csv'"
    assert sorted(map(tuple, session.table("c").collect())) == [(1, 2.5, ""), (4, 0.0, "")]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_out_of_range_loads_nothing(session, spark, tmp_path, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        session.execute("CREATE TABLE r (a INT, b BIGINT)")
        (tmp_path / "ok.csv").write_text("a,b\n2147483647,9223372036854775807\n-2147483648.7,1e3\n1e2,x\n")
        assert session.ingest(str(tmp_path / "ok.csv"), "r") == 3
        assert sorted(map(tuple, session.table("r").collect())) == [(-2147483648, 1000), (100, 0), (2147483647, 9223372036854775807)]
        for bad in ("2147483648,1", "1e10,1", "1,1e30", "1,9223372036854775808"):
            (tmp_path / "bad.csv").write_text(f"a,b\n1,1\n{bad}\n")
            with pytest.raises(Exception, match="out of range"):
                session.ingest(str(tmp_path / "bad.csv"), "r")
        assert session.table("r").count() == 3
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_row_numbers(spark):
    df = spark.range(100).repartition(7)
    got = [r.ID for r in with_row_numbers(df).select("ID").collect()]
    assert sorted(got) == list(range(1, 101))
    assert with_row_numbers(spark.range(0)).count() == 0


def test_row_numbers_of_a_sort(spark):
    """A sort draws its ranges from a sample, another one each time it runs."""
    settings = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "3", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("id"))
        got = with_row_numbers(df.orderBy("id"), "n")
        assert got.columns == ["n", "id"]
        assert got.count() == 20_000 and got.where("n <> id + 1").isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_seed(session, tmp_path):
    texts = {
        "Paises": "country,region\nPeru,America\nChad,Africa\n",
        "Ciudades": 'City,Latitude,Longitude\nLima,-12,-77\n"A\nB",,\n',
        "Contests": "year,host,date,semi_countries\n2001,Oslo,12/05/2001,\n",
    }
    files = {"Canciones": str(tmp_path / "none.csv")}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
        files[name] = str(tmp_path / f"{name}.csv")
    assert seed_demo(session.catalog, files) == ["Ciudades", "Contests", "Paises"]
    assert seed_demo(session.catalog, files) == []
    assert [tuple(r) for r in session.table("Paises").orderBy("ID").collect()] == [(1, "Peru", "America"), (2, "Chad", "Africa")]
    assert tuple(session.table("Contests").first())[:5] == (1, 2001, "Oslo", "12/05/2001", 0)
    hit = session.execute("SELECT Ciudad FROM Ciudades WHERE Lat IN (POINT(-12, -77), K 1)")
    assert hit.rows == [{"Ciudad": "Lima"}]


def test_stream_loads_each_file_once(session, spark, tmp_path):
    session.execute("CREATE TABLE s (id INT, v FLOAT)")
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.csv").write_text(f"id,v\n{i},1.5\n")
        watch(session.catalog, str(folder), "s", f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r.id for r in session.table("s").collect()) == [0, 1]
    marks = session.catalog.table("s").marks
    (stream, last), *_ = marks.items()
    assert session.catalog.append("s", session.table("s"), (stream, last)) == 0  # a batch that runs again


def test_files(spark, tmp_path):
    f = Files(spark)
    path = f"file://{tmp_path}/x/y.txt"
    f.write(path, "é1")
    f.write(path, "é2")
    assert f.read(path) == "é2" and f.exists(path)
    assert [c[0] for c in f.children(f"file://{tmp_path}/x") if not c[0].startswith(".")] == ["y.txt"]
    f.remove(f"file://{tmp_path}/x")
    assert not f.exists(path) and f.children(f"file://{tmp_path}/x") == []


def test_external_nulls(spark):
    from granary.session import Session

    s = Session(spark)
    s.register("t", spark.createDataFrame([(1, None), (None, "a"), (3, "b")], "id int, v string"))
    assert s.sql_df("SELECT COUNT(id), SUM(id), MIN(v) FROM t").first()[:] == (3, 4, "a")
    assert [r.id for r in s.sql_df("SELECT id FROM t ORDER BY id").collect()] == [1, 3, None]
    assert s.sql_df("SELECT id FROM t WHERE v != 'a'").count() == 1
    assert s.sql_df("SELECT * FROM t").select(F.count("*")).first()[0] == 3


def test_hash_of_keys_is_that_of_the_layout(session, spark):
    """What lookups compute on the driver is where the layout puts a key."""
    from granary.sources import layout

    for kind, spark_type, keys in (("INTEGER", "int", [0, -1, 7, 2**31 - 1]), ("BIGINT", "bigint", [0, -(2**63), 12345678901]), ("STRING", "string", ["", "a", "é😀", "x" * 100])):
        expected = [r.b for r in spark.createDataFrame([(k,) for k in keys], f"k {spark_type}").select(layout.bucket_of(F.col("k"), 64).alias("b")).collect()]
        assert [session.catalog._hash(k, kind) % 64 for k in keys] == expected


def test_cut_bytes_keeps_whole_characters(spark):
    from granary.functions.types import cut_bytes, stripped

    texts = ["abc", "abcdé", "abcé", "ab😀", "ab�", "a�bc�", "😀😀", "", "é" * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size in (1, 2, 4, 5, 6):
        got = [r[0] for r in df.select(cut_bytes(F.col("t"), size)).collect()]
        assert got == [t.encode()[:size].decode(errors="ignore") for t in texts]
    spaced = [" a ", "\t\na b ", " x　", "\x1c", "  ", "", "a\x85", "\x0ba\x0c", "a  b" + " " * 1000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in spaced], "t string").select(stripped(F.col("t"))).collect()]
    assert got == [t.strip() for t in spaced]


def test_inferred_types_by_brute_force(spark, tmp_path):
    """Columns of random values against one value after the other, as Python reads them."""
    import random

    from granary.sources.csv_source import infer_fields

    rng = random.Random(3)
    pool = ["1", "-5", " 7 ", "+3", "2147483648", "-2147483649", "1_000", "1.5", ".5", "2.", "1e5", "-inf", "nan", "x", "1.2.3", "", " ", "é" * 30, "y" * 200, "0x1", "٣"[:0] + "12a"]

    def expected(values):
        kind = "INTEGER"
        for v in (v.strip() for v in values[:20]):
            if not v:
                continue
            try:
                if not -(1 << 31) <= int(v) < 1 << 31:
                    kind = "BIGINT" if kind == "INTEGER" else kind
            except ValueError:
                try:
                    float(v)
                    kind = "FLOAT"
                except ValueError:
                    return "STRING", min(max(max(map(len, values[:100])) + 4, 20), 120)
        return kind, None

    columns = []
    for _ in range(40):
        some = rng.sample(pool, rng.randint(1, 5))
        columns.append([rng.choice(some) for _ in range(130)])
    rows = list(zip(*columns, strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(40))).coalesce(1)
    got = [(f.type, f.size) for _, f in infer_fields(df)]
    assert got == [expected(c) for c in columns]


@pytest.mark.parametrize("kind", ["HASH", "BTREE"])
def test_layouts_grow_and_split_hot_keys(session, spark, monkeypatch, kind):
    """Parts of different sizes have different numbers of folders, and a key with most of the rows many files."""
    from granary.sources import catalog, layout

    monkeypatch.setattr(layout, "ROWS_PER_FILE", 10)
    monkeypatch.setattr(layout, "BUCKETS", 2)
    session.execute(f"CREATE TABLE t (id INT, v INT) INDEX ({kind} id)")
    for n in (5, 40, 300):
        session.catalog.append("t", spark.range(n).selectExpr("CAST(IF(id % 3 = 0, 7, id) AS INT) AS id", "CAST(id AS INT) AS v"))
    if kind == "HASH":
        assert [p.buckets for p in session.catalog.table("t").parts] == [2, 4, 32]
    expected = [(7 if i % 3 == 0 else i, i) for n in (5, 40, 300) for i in range(n)]
    for k, key in enumerate((1, 7, 8, 299, 1000)):
        monkeypatch.setattr(catalog, "KNOWN_FOLDERS", 4096 * (k % 2))  # a large table's way and a small one's
        rows = session.sql_df(f"SELECT id, v FROM t WHERE id = {key}").collect()
        assert sorted(map(tuple, rows)) == sorted(r for r in expected if r[0] == key)
        assert session.lookup("t", key).count() == any(r[0] == key for r in expected)
    assert session.execute("DELETE FROM t WHERE id = 7").message == f"{sum(r[0] == 7 for r in expected)} row(s) deleted from 't'"
    session.catalog.compact("t")
    assert sorted(map(tuple, session.table("t").collect())) == sorted(r for r in expected if r[0] != 7)
    if kind == "BTREE":
        session.catalog.append("t", spark.range(400).selectExpr("5 AS id", "CAST(id AS INT) AS v"))
        last = session.catalog.table("t").parts[-1]
        assert len(session.catalog._files(last)) > 3


def test_page_files(spark, tmp_path):
    """Records against Python's struct, over several pages, and back."""
    import struct

    from granary.errors import AnalysisError
    from granary.functions.types import Field
    from granary.sources import pages

    fields = [Field("a", "INTEGER"), Field("b", "BIGINT"), Field("c", "FLOAT"), Field("s", "STRING", 7)]
    rows = [(i - 500, -i << 40, i / 3, f"é{i}😀xyz") for i in range(1000)] + [(0, 0, 0.0, "")]
    df = spark.createDataFrame(rows, "a int, b bigint, c double, s string").repartition(3).orderBy("a", "b")
    path = f"file://{tmp_path}/p.bin"
    assert pages.write_pages(df, fields, path) == 1001
    raw = (tmp_path / "p.bin").read_bytes()
    expected = sorted((a, b, struct.unpack("f", struct.pack("f", c))[0], s.encode()[:7].decode(errors="ignore")) for a, b, c, s in rows)
    per_page = 4096 // 23
    assert len(raw) == 4096 * -(-1001 // per_page)
    at = [4096 * (i // per_page) + 23 * (i % per_page) for i in range(1001)]
    unpacked = [struct.unpack("!iqf7s", raw[x : x + 23]) for x in at]
    assert [(a, b, c, s.rstrip(b"\0").decode()) for a, b, c, s in unpacked] == expected
    assert [tuple(r) for r in pages.read_pages(spark, path, fields, 1001).collect()] == expected
    assert pages.read_pages(spark, path, fields).count() == 1000  # the record of zeros looks like an empty slot
    empty = f"file://{tmp_path}/e.bin"
    assert pages.write_pages(df.limit(0), fields, empty) == 0 and pages.read_pages(spark, empty, fields).count() == 0
    with pytest.raises(AnalysisError):
        pages.record_type([Field("s", "STRING", 5000)])
