"""Stored tables, ranks, files and their registry, and serving, on small fixtures; every query against its oracle at the smallest size."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lanewise import catalog, storage
from lanewise.functions import scalars as X
from lanewise.operators import identity, oracles, ranking, serving
from lanewise.plans import portable
from lanewise.sources import files, ingest
from lanewise.streaming import state

SF = "/root/testdata/sf0.001"
#: The queries that a run of all would repeat in other words stay out: one of each kind, and all that are written apart from their oracle.
NAMES = sorted({*oracles.ORACLES, *serving.QUERIES, *serving.PLANS, *ranking.QUERIES, *ingest.QUERIES, *state.QUERIES, *[n for n in X.QUERIES if n in X.ORACLES]} - {"v05_recomputed", "v06_shares"})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(dict(zip(names, r))[c] for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == want


@pytest.mark.parametrize("descending", [False, True])
def test_ranks(spark, descending):
    values = [None, 5.0, 5.0, -1.0, 0.0, 7.5, 7.5, 7.5, *map(float, range(100, 160)), None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {r["i"]: r["rank"] for r in ranking.ranked(df, "v", descending, parts=7).collect()}
    ahead = lambda a, b: b > a if descending else b < a
    assert got == {i: None if v is None else 1 + sum(w is not None and ahead(v, w) for w in values) for i, v in enumerate(values)}
    assert ranking.ranked(df.limit(0), "v").count() == 0


def test_tables_are_built_once_and_refreshed(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(portable.VIEWS, "ledger", "SELECT * FROM {small}")
    columns = "transaction_id string, direction string, reporting_country string, origin_country string, destination_country string, hs_code_6 string, year long, month long, shipment_date date, qty_kg decimal(18,4), value_usd decimal(18,2), price_per_kg double"
    row = lambda k: (f"t{k}", "IMPORT", "KENYA", "INDIA", "KENYA", "PROMO", 2000, 1, None, 1, 10, float(k))
    write = lambda n: spark.createDataFrame([row(k) for k in range(1, n + 1)], columns.replace("decimal(18,4)", "int").replace("decimal(18,2)", "int")).write.mode("overwrite").parquet(str(tmp_path / "small.parquet"))
    count = lambda: portable.run(spark, str(tmp_path), "SELECT sum(n) AS n FROM corridor").first()["n"]
    write(3)
    assert count() == 3 and portable.stored(spark, str(tmp_path), "ledger").inputFiles()[0].count("direction=IMPORT/year=2000") == 1
    write(5)
    assert count() == 3
    assert portable.refresh(spark, str(tmp_path), ["ledger"]) == ["ledger", "corridor"]
    assert count() == 5


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        storage.base_folder(Session)


def test_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('title\n\nName,"HS, code",Name\n"Acme, Ltd",0806,second\n,NaN,\nShort\n')
    (tmp_path / "c.csv").write_text("x\ny\nHS CODE\n12\n")
    rows = {(r["path"].rsplit("/", 1)[1], r["row_number"]): r["raw_data"] for r in files.raw_lines(spark, [str(tmp_path)], header_row=3).collect()}
    assert rows == {("a b.csv", 1): {"NAME": "Acme, Ltd", "HS,_CODE": "0806"}, ("a b.csv", 2): {}, ("a b.csv", 3): {"NAME": "Short"}, ("c.csv", 1): {"HS_CODE": "12"}}
    with pytest.raises(ValueError, match="different headers"):
        files.read_csv(spark, [str(tmp_path)], header_row=3)
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "c.csv"), header_row=3).collect()] == [("12",)]


def test_a_failed_file_is_taken_again(spark, tmp_path, monkeypatch):
    folder = tmp_path / "raw" / "kenya" / "import" / "2023" / "01"
    folder.mkdir(parents=True)
    (folder / "Kenya Import F.csv").write_text("HS_CODE,IMPORTER\n0806,ACME\n0807,\n")
    log, raw = str(tmp_path / "log"), str(tmp_path / "table")
    run = lambda: [(r["status"], r["rows_ingested"]) for r in ingest.ingest(spark, str(tmp_path / "raw"), log, raw).collect()]
    with monkeypatch.context() as m:
        m.setattr(ingest, "append", lambda *_: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            run()
    state_of = lambda: [(r["status"], r["row_count"], r["error"]) for r in ingest.registry(spark, log).collect()]
    assert state_of() == [("FAILED", None, "disk")] and ingest.pending(ingest.registry(spark, log)).count() == 1
    assert run() == [("INGESTED", 2)] and state_of() == [("INGESTED", 2, None)]
    assert run() == [("DUPLICATE", 0)] and ingest.pending(ingest.registry(spark, log)).count() == 0
    assert sorted((r["row_number"], r["hs_code_raw"]) for r in ingest.with_aliases(spark.read.parquet(raw)).collect()) == [(1, "0806"), (2, "0807")]


def test_similar_names_meet_by_rare_trigrams(spark):
    """Against every pair: names with the same common words, and equal scores."""
    words = ["TRADING", "KENYA", "TILES", "BLUE", "SKY", "ACME", "NAIROBI", "EXPORTS", "EXPORT", "TILE"]
    names = sorted({f"{a} {b} {c}" for i, a in enumerate(words) for b in words[i % 4 :: 3] for c in words[::4]})
    stored = spark.createDataFrame([(f"id{i}", n, "KENYA", "SUPPLIER") for i, n in enumerate(names[::2])], "org_id string, name string, country string, type string")
    found = spark.createDataFrame([(n, "KENYA", "BUYER", n) for n in names], "name string, country string, role string, raw string")
    got = {r["name"]: (r["match"], r["org_id"]) for r in identity.resolve(found, stored, 0.6).collect()}
    grams = lambda n: {p[i : i + 3] for w in n.lower().split() for p in ["  " + w + " "] for i in range(len(p) - 2)}
    for n in names[1::2]:
        scores = [(-len(grams(n) & grams(m)) / len(grams(n) | grams(m)), f"id{i}") for i, m in enumerate(names[::2])]
        best = min(s for s in scores)
        assert got[n] == ("FUZZY", best[1]) if -best[0] >= 0.6 else got[n][0] == "NEW"


def test_filters_and_levels(spark):
    df = spark.createDataFrame([(1, "Acme", "LOW", 5.0), (2, "Blue", "UNSCORED", 7.0), (3, None, "HIGH", None)], "i int, name string, level string, v double")
    ids = lambda d: [r["i"] for r in d.orderBy("i").collect()]
    assert ids(serving.filtered(df, name__like="AC", v__from=None)) == [1] and ids(serving.filtered(df, i=[1, 3])) == [1, 3] and ids(serving.filtered(df, v__from=6, level="UNSCORED")) == [2] and ids(serving.filtered(df)) == [1, 2, 3]
    assert [ids(df.filter(serving.up_to(F.col("level"), m))) for m in ("low", "MEDIUM", "HIGH", "ALL", "odd")] == [[1], [1, 2], [1, 2, 3], [1, 2, 3], [1, 2]]
    mails = spark.createDataFrame([(["x", "a@b@GMAIL.com", "c@firm.ke"], 5e5), (["c@firm.ke", "a@gmail.com"], 9e9), ([None, "q@aol.com"], 1.0), (None, 1.0)], "variants array<string>, value_usd double")
    assert sorted((r["email_domain"], r["score"], r["risk_level"]) for r in serving.free_email(mails).collect()) == [("aol.com", 30, "LOW"), ("gmail.com", 40, "MEDIUM")]


def test_top_arrays_have_whole_shares(spark, tmp_path, monkeypatch):
    """Against the oracle: a share just under a whole basis point, a negative one, missing values and codes, equal values, a total beyond a long."""
    rows = [(1, "A", "581164.71"), (1, "B", "1700597.01"), (2, "A", "3"), (2, "B", "-0.07"), (3, "A", None), (3, None, "5"), (3, "C", "5"), (3, "B", "5"), *[(4, f"p{k:02}", "9" * 16 + ".99") for k in range(12)], (None, "A", "1")]
    spark.createDataFrame(rows, "buyer_id long, hs_code_6 string, v string").selectExpr("buyer_id", "hs_code_6", "CAST(v AS DECIMAL(18,2)) AS value_usd").write.parquet(str(tmp_path / "micro.parquet"))
    monkeypatch.setitem(portable.VIEWS, "ledger", "SELECT * FROM {micro}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW micro AS SELECT * FROM '{tmp_path}/micro.parquet/*.parquet'")
    got = {r["buyer_id"]: r["top_codes"] for r in serving.a15_top_arrays(spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(serving.oracles()["a15_top_arrays"]).fetchall())
    assert '"cents":58116471,"share_bp":2546}' in got[1] and '"cents":-7,"share_bp":-238}' in got[2] and got[4].count('"share_bp":833}') == 5


def test_lines_are_joined_in_slices_and_stored_once(spark, monkeypatch):
    """The ledger isn't written: plans read its lines, one row for both directions, whose slices make up the whole."""
    fresh = lambda: portable.refresh(spark, SF)
    plan = "SELECT sum(xxhash64(transaction_id, reporting_country, buyer_id, shipment_date, qty_kg, value_usd, container_id) % 1000003) AS h, count(*) AS n FROM ledger"
    fresh()
    whole = portable.run(spark, SF, plan).first()
    assert portable._key(spark, SF, "ledger") not in portable._TABLES and fresh() == ["base"]
    monkeypatch.setattr(portable, "SLICE", 1)
    assert portable.run(spark, SF, plan).first() == whole
    lines = portable.stored(spark, SF, "base")
    assert 2 * lines.count() == whole["n"] and len({f.rsplit("-", 1)[0].rsplit("/", 1)[1].split("-", 2)[2] for f in lines.inputFiles()}) == portable.SLICES
    portable.stored(spark, SF, "ledger")
    assert portable.run(spark, SF, plan).first() == whole and "direction=IMPORT" in " ".join(portable.ledger(spark, SF).inputFiles())
    assert fresh() == ["base", "ledger"]


def test_mirror_candidates_are_counted_before_they_travel(spark, monkeypatch):
    """No window or sort sees a row for each pair, and slices by export make up the oracle's matches."""
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = "export_id, import_id, imported_buyer, score, lag_days"
    want = sorted(con.execute(portable.oracle_sql(f"SELECT {columns} FROM mirror_match")).fetchall())
    portable.refresh(spark, SF, ["mirror_match"])
    monkeypatch.setattr(portable, "SLICE", 1 << 12)
    assert sorted(tuple(r) for r in portable.stored(spark, SF, "mirror_match").select(*columns.split(", ")).collect()) == want and want
    whole = portable.BUILT["mirror_match"](spark, SF)
    assert sorted(tuple(r) for r in whole.select(*columns.split(", ")).collect()) == want
    plan = whole._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan[plan.index("Window") :]


def test_tables_in_slices_equal_those_built_at_once(spark, monkeypatch):
    names = [n for n in portable.STORED if n in portable.APART]
    of = lambda: {n: (sorted(repr(tuple(r)) for r in portable.stored(spark, SF, n).collect()), portable.stored(spark, SF, n).schema) for n in names}
    portable.refresh(spark, SF)
    whole = of()
    assert len(names) == 5 and all(rows for rows, _ in whole.values())
    portable.refresh(spark, SF)
    monkeypatch.setattr(portable, "SLICE", 1 << 15)
    assert 1 < portable.slices_for(portable.ledger(spark, SF)) < portable.SLICES
    assert of() == whole
