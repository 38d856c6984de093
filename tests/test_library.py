"""Golden tables of the scalar functions, state operators, files, identity, and a few plans against DuckDB."""

import datetime
import re
import zipfile
from decimal import Decimal as D

import duckdb
import pytest
from pyspark.sql import functions as F

from lanewise import catalog
from lanewise.functions import scalars as X
from lanewise.operators import identity
from lanewise.plans import portable
from lanewise.sources import discovery, excel, files
from lanewise.streaming import runs, state

SF = "/root/testdata/sf0.001"
NAMES = [
    ("Anatolia Tiles Ltd.", "ANATOLIA TILES"), ("R.A.K. CERAMICS (P.J.S.C)", "R A K CERAMICS P J S C"), ("  ABC Trading Co., Ltd.  ", "ABC TRADING"), ("PYRAMID BUILDERS PRIVATE LIMITED", "PYRAMID BUILDERS"),
    ("M/S. SHARMA & SONS", "SHARMA SONS"), ("AGRICO INTERNATIONAL FZE", "AGRICO INTERNATIONAL"), ("ABC-XYZ CORP.", "ABC XYZ"), ("ACME (INDIA) PVT. LTD.", "ACME INDIA"), ("Test Company LLC", "TEST COMPANY"),
    ("Société Générale SA", "SOCIETE GENERALE"), ("  ", None), ("", None), (None, None), ("LTD", None), ("PRIVATE LIMITED", None),
]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_names(spark):
    assert column(spark, [n for n, _ in NAMES], X.organisation) == [x for _, x in NAMES]
    # Forms of equal length go in the order of the list: LTD before LLC and INC.
    assert column(spark, ["ACME LLC LTD", "ACME INC LTD", "ACME LTD LLC", "ACME LTD INC"], X.organisation) == ["ACME", "ACME", "ACME LTD", "ACME LTD"]


def test_fields(spark):
    assert column(spark, ["0806.10", "08", "8", None, "6907210000", "x"], X.hs_code_6) == ["080610", "080000", None, None, "690721", None]
    assert column(spark, [" u.s.a. ", "Kenya", "", None], X.country) == ["USA", "KENYA", None, None]
    assert [str(d) for d in column(spark, ["2023-04-17", "45000", "17/04/2023", "Oct 2025", "N/A", "junk", None], X.any_date)] == ["2023-04-17", "2023-03-15", "2023-04-17", "2025-10-01", "None", "None", "None"]
    assert column(spark, ["1,234.5", "$7", "NaN", "x", None], X.number) == [1234.5, 7.0, None, None, None]
    assert column(spark, ["a@GMAIL.com", "a@firm.ke", "none", None], X.is_free_mail) == [True, False, False, False]
    assert round(column(spark, ["word"], lambda c: X.similarity(c, F.lit("two words")), "string")[0], 4) == 0.3636
    assert column(spark, [2.0, 0.0, None], lambda c: X.weight_kg(c, F.lit("mt")), "double") == [2000.0, None, None]
    assert column(spark, [3.0], lambda c: X.weight_kg(c, F.lit("pcs"), {"PCS": {"is_weight": False, "estimate_kg_per_unit": 2}}), "double") == [6.0]


def test_path(spark):
    df = spark.createDataFrame([("/d/raw/kenya/import/2023/01/Kenya Import F.xlsx",), ("/d/raw/kenya/export/2023/13/kenya_export_202301.csv",)], "p string")
    rows = df.select(*[c.alias(n) for n, c in X.path_metadata(F.col("p")).items()]).collect()
    assert [tuple(r) for r in rows] == [("KENYA", "IMPORT", 2023, 1, "FULL"), ("KENYA", "EXPORT", 2023, None, "TEST")]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    once, history = state.upsert(old, new, ["k"])
    twice, _ = state.upsert(once, new, ["k"])
    want = {(1, "a"), (2, "B"), (3, "c"), (None, "n")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}
    assert [tuple(r) for r in history.collect()] == [(2, "b")]


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "raw" / "kenya" / "import" / "2023" / "01"
    folder.mkdir(parents=True)
    (folder / "Kenya Import F.csv").write_text("note\nIMPORTER_NAME,HS_CODE,QUANTITY,UNIT,TOTAL_VALUE_USD,ORIGIN_COUNTRY,IMP_DATE\nTEST COMPANY LTD,690721,1000,KGS,50000,U.S.A.,2023-01-05\n")
    (folder / "copy.csv").write_text((folder / "Kenya Import F.csv").read_text())
    found = files.discover(spark, str(tmp_path))
    registry = spark.createDataFrame([], "checksum string, status string")
    assert found.count() == 2 and files.not_ingested(found, registry).count() == 1
    df = files.read_csv(spark, str(folder / "Kenya Import F.csv"), header_row=2)
    mapping = {"buyer_name_raw": "IMPORTER_NAME", "hs_code_raw": "HS_CODE", "qty_raw": "QUANTITY", "unit_raw": "UNIT", "value_raw": "TOTAL_VALUE_USD", "origin_country_raw": "ORIGIN_COUNTRY", "import_date_raw": "IMP_DATE", "destination_country_raw": "TODO_DEST"}
    assert files.missing_columns(df, mapping, ["hs_code_raw", "supplier_name_raw"]) == ["supplier_name_raw"]
    row = files.standardize(files.raw_rows(df), {"reporting_country": "KENYA", "direction": "IMPORT", "column_mapping": mapping}).first()
    assert (row["buyer_name"], row["hs_code_6"], row["origin_country"], row["qty_kg"], row["value_usd"], row["price_per_kg"], str(row["shipment_date"])) == ("TEST COMPANY", "690721", "USA", 1000.0, 50000.0, 50.0, "2023-01-05")
    spark.range(3).write.parquet(str(tmp_path / "in" / "a"))
    seen = []
    for _ in range(2):
        state.stream_files(spark, str(tmp_path / "in"), "id long", str(tmp_path / "ck"), lambda b, _: seen.append(b.count()))
    assert sum(seen) == 3


def workbook(path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="a" sheetId="1" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Importer Name</t></si><si><r><t>HS </t></r><r><t>CODE</t></r><rPh><t>no</t></rPh></si><si><t>ACME &amp; CO</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        rows = [
            '<row r="1"><c r="A1" t="inlineStr"><is><t>a note</t></is></c></row>',
            '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="str"><v>Imp_Date</v></c><c r="E3" t="str"><v>Days</v></c></row>',
            '<row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4"><v>6.90721E9</v></c><c r="C4" t="b"><v>1</v></c><c r="D4" s="1"><v>45000</v></c><c r="E4" s="2"><v>1.5</v></c></row>',
            '<row r="5"><c r="A5" t="inlineStr"><is><t> </t></is></c></row>',
            '<row r="6"><c r="AA6"><v>7</v></c></row>',
        ]
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "Sri Lanka Import F (2).xlsx")
    path = str(tmp_path / "Sri Lanka Import F (2).xlsx")
    first = discovery.first_rows(spark, path)
    assert discovery.header_row(first) == 3 and discovery.header_row([]) == 1
    df = excel.read_xlsx(spark, path, header_row=3)
    assert df.columns == ["IMPORTER_NAME", "HS_CODE", "IMP_DATE", "DAYS"]
    assert [tuple(r) for r in df.collect()] == [("ACME & CO", "6907210000", "2023-03-15", "1.5"), (None, None, None, None)]
    mapping = discovery.draft_mapping("SRILANKA", "IMPORT", "FULL", df.columns, 3)
    assert mapping["column_mapping"]["import_date_raw"] == "IMPORTER_NAME"  # a draft, as its first pattern says
    assert mapping["column_mapping"]["value_raw"] == "TODO_VALUE" and mapping["defaults"]["destination_country_raw"] == "SRILANKA"
    row = files.standardize(files.raw_rows(df), mapping).first()
    assert (row["buyer_name"], row["hs_code_6"], row["value_usd"]) == ("ACME", "690721", None)  # CO is a legal form
    assert discovery.column_roles(["TOTAL_VALUE_USD", "UNIT", "x"])["other"] == ["x"]


def test_file_names(spark):
    names = ["Sri Lanka Import F (2).xlsx", "Kenya export Short.xlsx", "Chad BL Import S.xlsx", "output_excel.xlsx", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select(*[c.alias(k) for k, c in discovery.file_name(F.col("n")).items()]).collect()
    assert [tuple(r) for r in rows] == [("SRILANKA", "IMPORT", "FULL"), ("KENYA", "EXPORT", "SHORT"), ("CHAD_BL", "IMPORT", "SHORT"), (None,) * 3, (None,) * 3]


def test_runs(spark, tmp_path):
    log = str(tmp_path / "log")
    with runs.tracked(spark, log, "load") as run:
        run.add(rows=2)
        run.checkpoint()
        assert [r["status"] for r in runs.running(spark.read.parquet(log)).collect()] == ["RUNNING"]
        run.add(rows=3)
    with pytest.raises(ValueError), runs.tracked(spark, log, "load"):
        raise ValueError("x" * 5000)
    with runs.tracked(spark, log, "other") as run:
        run.partial("one file is missing")
    table = spark.read.schema(runs.SCHEMA).parquet(log)
    assert {(r["pipeline"], r["status"], r["counts"].get("rows"), r["note"]) for r in runs.runs(table).collect()} == {("load", "SUCCESS", 5, None), ("load", "FAILED", None, None), ("other", "PARTIAL", None, "one file is missing")}
    last = {r["pipeline"]: r for r in runs.latest(table).collect()}
    assert last["load"]["status"] == "FAILED" and len(last["load"]["error"]) == runs.ERROR_LENGTH and last["load"]["completed_at"] >= last["load"]["started_at"]
    assert runs.running(table).count() == 0


def test_mappings_fall_back(tmp_path):
    (tmp_path / "kenya_import_full.yml").write_text(discovery.draft_text({"header_row": 6}))
    (tmp_path / "kenya_import.yml").write_text(discovery.draft_text({"header_row": 1}))
    assert discovery.load_mapping(str(tmp_path), "KENYA", "IMPORT")["header_row"] == 6
    assert discovery.load_mapping(str(tmp_path), "KENYA", "IMPORT", "SHORT")["header_row"] == 1
    with pytest.raises(FileNotFoundError):
        discovery.load_mapping(str(tmp_path), "KENYA", "EXPORT")
    assert state.joint_watermark("2024-02-01", "2024-01-05") == "2024-01-05" and state.joint_watermark("2024-02-01", None) == "2024-02-01" and state.joint_watermark(None, None) is None


def test_role_flags_agree(spark):
    flags = {r["name"]: r for r in discovery.s21_column_roles(spark, SF).collect()}
    roles = discovery.column_roles(list(flags))
    assert all(flags[n][role] == (n in roles[role]) for n in flags for role in discovery.ROLES)


def test_identity(spark):
    found = identity.candidates(spark.createDataFrame([("Acme Ltd", "Blue Sky Traders", "India", "Kenya"), ("Blue Sky Traders", "Acme", "Kenya", "Kenya")], "buyer_raw string, supplier_raw string, origin string, destination string"))
    stored = spark.createDataFrame([("id1", "BLUE SKY TRADERSS", "KENYA", "SUPPLIER")], "org_id string, name string, country string, type string")
    rows = {(r["name"], r["country"]): (r["type"], r["match"]) for r in identity.resolve(found, stored).collect()}
    assert rows == {("ACME", "KENYA"): ("MIXED", "NEW"), ("BLUE SKY TRADERS", "INDIA"): ("SUPPLIER", "NEW"), ("BLUE SKY TRADERS", "KENYA"): ("MIXED", "FUZZY")}


@pytest.mark.parametrize("name", ["c19_opportunity_score", "c23_country_hs_dashboard", "c24_buyer_hs_activity", "a04_distinct_tuples", "j04_corridor_join", "s07_raw_rows"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(dict(zip(names, r))[c] for c in columns)) for r in cursor.fetchall())
    assert rows == want


def micro(spark, tmp_path, monkeypatch, rows, columns):
    """A ledger made by hand in place of the view: plans read it from tmp_path."""
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "micro.parquet"))
    monkeypatch.setitem(portable.VIEWS, "ledger", "SELECT * FROM {micro}")
    return lambda name: portable.run(spark, str(tmp_path), catalog.PLANS[name]).collect()


def test_mirror_meets_every_supplier(spark, tmp_path, monkeypatch):
    day = datetime.date(1999, 12, 20)
    rows, want = [], {}
    for k in range(40):  # each export has a product of its own, and another place among the buckets of days
        qty = [10, 10, None, 0][k % 4]
        rows.append((f"e{k}", "EXPORT", "INDIA", "INDIA", "KENYA", f"p{k}", 1, None, True, day + datetime.timedelta(k), None if qty is None else D(qty), None, "v"))
        for lag in (14, 15, 30, 45, 46):
            for supplier, kg in ((1, "10.4"), (2, "9.6"), (3, "20")):
                rows.append((f"i{k}-{lag}-{supplier}", "IMPORT", "KENYA", "INDIA", "KENYA", f"p{k}", supplier, 7, False, day + datetime.timedelta(k + lag), D(kg), None, None))
                if 15 <= lag <= 45 and (not qty or supplier < 3):
                    want[f"e{k}", f"i{k}-{lag}-{supplier}"] = 85 if qty else 60
    # One export with a rival of another supplier, and one with none.
    for name, suppliers in (("tied", (1, 2)), ("sole", (2,))):
        rows.append((name, "EXPORT", "INDIA", "INDIA", "KENYA", name, 1, None, True, day, D(10), None, "v"))
        rows += [(f"{name}-{s}", "IMPORT", "KENYA", "INDIA", "KENYA", name, s, s, False, day + datetime.timedelta(20), D(10), None, None) for s in suppliers]
        want |= {(name, f"{name}-{s}"): 85 for s in suppliers}
    # A quantity off by 5 % exactly is inside the band and scores like any other there.
    rows += [("edge", "EXPORT", "INDIA", "INDIA", "KENYA", "edge", 1, None, True, day, D(34), None, "v")]
    rows += [(f"edge-{kg}", "IMPORT", "KENYA", "INDIA", "KENYA", "edge", 1, 5, False, day + datetime.timedelta(20), D(kg), None, None) for kg in ("34", "35.7", "35.71")]
    want |= {("edge", "edge-34"): 85, ("edge", "edge-35.7"): 85}
    plan = micro(spark, tmp_path, monkeypatch, rows, "transaction_id string, direction string, reporting_country string, origin_country string, destination_country string, hs_code_6 string, supplier_id long, buyer_id long, hidden_buyer boolean, shipment_date date, qty_kg decimal(18,4), container_id string, vessel_name string")
    found = plan("j12_mirror_candidates")
    assert {(r["export_id"], r["import_id"]): r["score"] for r in found} == want and len(found) == len(want)
    assert {r["export_id"]: r["imported_buyer"] for r in plan("c14_mirror_match")} == {"sole": 2}


def test_identity_against_brute_force(spark):
    """Every open customer of sf0.01 beside every stored one of its country: the counts at the threshold of the reference."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    orgs = con.execute(f"SELECT c_custkey, c_name, c_nationkey, c_custkey IN (SELECT o_custkey FROM '{sf}/orders.parquet' WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM '{sf}/orders.parquet')) FROM '{sf}/customer.parquet'").fetchall()
    grams = lambda name: {p[i : i + 3] for w in re.findall("[a-z0-9]+", name.lower()) for p in ["  " + w + " "] for i in range(len(p) - 2)}
    stored = [(n, grams(name)) for _, name, n, early in orgs if early]
    like = lambda a, b: len(a & b) / len(a | b)
    fuzzy = sum(any(n == m and like(g, h) >= 0.8 for m, h in stored) for n, g in [(n, grams(name)) for _, name, n, early in orgs if not early])
    got = {(r["type"], r["match"]): r["n"] for r in identity.c16_identity(spark, sf).collect()}
    suppliers = con.execute(f"SELECT count(*) FROM '{sf}/supplier.parquet'").fetchone()[0]
    assert fuzzy > 0 and got == {("MIXED", "EXACT"): len(stored), ("MIXED", "FUZZY"): fuzzy, ("BUYER", "NEW"): len(orgs) - len(stored) - fuzzy, ("SUPPLIER", "NEW"): suppliers}


TRADES = "transaction_id string, direction string, reporting_country string, origin_country string, destination_country string, hs_code_6 string, supplier_id long, buyer_id long, shipment_date date, qty_kg decimal(18,4), value_usd decimal(18,2), year long, month long"


def trades(months):
    """Imports of PROMO: one row per (buyer, year, month, value)."""
    return [(f"t{k:03}", "IMPORT", "KENYA", "INDIA", "KENYA", "PROMO", 1, b, datetime.date(y, m, 5), D(10), D(v), y, m) for k, (b, y, m, v) in enumerate(months)]


#: Four buyers: values of 40,000, 10,000, 15,000 and 20,000 over 4, 1, 3 and 2 months of 2, 1, 1 and 2 years.
FOUR = [(31, 2000, 11, 10000), (31, 2000, 12, 10000), (31, 2001, 1, 10000), (31, 2001, 2, 10000), (32, 2001, 1, 10000), (33, 2001, 1, 5000), (33, 2001, 2, 5000), (33, 2001, 3, 5000), (34, 2000, 12, 10000), (34, 2001, 1, 10000)]


def test_plans_cover_the_whole_ledger(spark, tmp_path, monkeypatch):
    rows = trades([*FOUR, (None, 1996, 3, 70000)])
    plan = micro(spark, tmp_path, monkeypatch, rows, TRADES)
    assert [len(plan(n)) for n in ("p04_date_precedence", "p05_ledger_projection", "p08_casts")] == [len(rows)] * 3
    assert [(r["buyer_id"], r["transaction_id"]) for r in plan("o02_nulls_last")] == sorted([(r[7], r[0]) for r in rows], key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert {r["buyer_id"] for r in plan("a13_distinct_rows")} == {31, 32, 33, 34, None}
    assert sorted((r["buyer_id"], r["year"], r["month"]) for r in plan("w07_top_origin_per_month")) == sorted((b, y, m) for b, y, m, _ in FOUR)
    # A cohort of under five is scaled to its largest buyer; rows without a buyer are no member.
    assert {r["buyer_id"]: (r["scaled"], r["cohort"]) for r in plan("w09_cohort_max")} == {31: (1.0, 4), 32: (0.25, 4), 33: (0.375, 4), 34: (0.5, 4)}


@pytest.mark.parametrize(("more", "want"), [([], {31: 79.0, 32: 53.0, 33: 60.5, 34: 64.0}), ([(35, 2001, 1, 4000)], {31: 71.0, 32: 36.0, 33: 49.0, 34: 58.0, 35: 28.0})])
def test_opportunity_score(spark, tmp_path, monkeypatch, more, want):
    """Volume (20 and a share of 20 in a small cohort, else a share of 40), months, years twice, focus 15, unscored 6, quality 4 + 3 + 3."""
    plan = micro(spark, tmp_path, monkeypatch, trades([*FOUR, *more]), TRADES)
    assert {r["buyer_id"]: r["score"] for r in plan("c19_opportunity_score")} == want
    assert [r["buyer_id"] for r in plan("c20_top_targets")] == sorted(want, key=lambda b: -want[b])
