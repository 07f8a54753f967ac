"""Search through trigram postings, deep pages, collated text order, toFixed."""

import random
import struct
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from millbook.functions import paging
from millbook.functions.filters import any_contains
from millbook.functions.money import to_fixed
from millbook.functions.ordering import asc
from millbook.operators import listings as L
from millbook.operators import search as X
from tests.helpers import make_tables
from tests.test_plans import plan_of

NAMES = ["Árbol Ñandú", "arbol nandu", "GEAR wheel 10%", "gear_box", "gear\\box", "İstanbul", "ΑΣ ΟΔΟΣ", "straße", "日本語テスト", "ab", "", None,
         "aaaa", "aaa", "bolt \U0001f600\U0001f601\U0001f602 nut", "x%y_z", "\\\\", "Gear Wheel 1000"]


def index_of(spark, path, rows, *columns):
    index = X.TrigramIndex(spark, str(path), columns)
    index.add(rows)
    return index


# --- §2.3 trigram search -------------------------------------------------------------------
def test_trigrams_are_runs_of_code_points(spark):
    got = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", X.trigrams(F.col("n")).alias("g"), F.lower("n").alias("l")).collect()
    for r in got:
        want = {r.l[i:i + 3] for i in range(len(r.l) - 2)} if r.n else set()
        assert set(r.g) == want and len(r.g) == len(want)


def test_trigrams_split_a_text_outside_the_lambdas(spark):
    """A lambda that names the split letters splits the text again for each of its runs."""
    plan = spark.range(3).select(X.trigrams(F.col("id").cast("string")).alias("g"))._jdf.queryExecution().analyzed().toString()
    assert "lambdafunction(" in plan
    for body in plan.split("lambdafunction(")[1:]:
        assert "split(" not in body.split("lambda ")[0], body


def test_postings_over_several_files_find_every_row(spark, tmp_path, monkeypatch):
    """Rows of one input partition, some keys repeated or null, dealt over several files of a folder."""
    monkeypatch.setattr(X, "FILE_ROWS", 100)
    rows = [(None if i % 97 == 0 else i // 2 * 2, f"item {i:04d}") for i in range(700)]
    df = spark.createDataFrame(rows, "id long, name string").coalesce(1)
    index = index_of(spark, tmp_path, df, "name")
    got = index._read(f"{tmp_path}/postings").groupBy("gram").agg(F.count("*").alias("n")).collect()
    assert {r.gram: r.n for r in got} == Counter(g for _, n in rows for g in {n[a:a + 3] for a in range(len(n) - 2)})
    assert {r.key for r in index.candidates("m 0123").collect()} == {122}
    assert index._read(f"{tmp_path}/postings").filter("gram = 'ite'").select(F.input_file_name()).distinct().count() > 1


def test_literal_runs():
    assert X.literal_runs("abc%def_g") == ["abc", "def", "g"]
    assert X.literal_runs(r"10\% of_a\\b\_c") == ["10% of", "a\\b_c"]
    assert X.literal_runs("%%") == [] and X.literal_runs("a\\") is None and X.literal_runs("a\\b") is None


def test_indexed_search_equals_ilike(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice(NAMES), "".join(rng.choice("abcAB %_é") for _ in range(rng.randrange(12)))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, name string, code string").repartition(4)
    index = index_of(spark, tmp_path, df, "name", "code")
    monkeypatch.setattr(X, "SCAN_SHARE", 2.0)  # no pattern is scanned for being frequent
    looked_up = 0
    words = [n for n in NAMES if n] + [r[2] for r in rows]
    for k in range(16):  # of the first ten patterns none has a run of three letters
        word = rng.choice(words)
        a = rng.randrange(max(len(word) - 3, 1))
        text = word[a:a + rng.randrange(1, 12)].replace("\\", "\\\\")
        text = rng.choice([text, text.upper(), text.swapcase(), text[:2] + "%" + text[2:], text + "_" + text, text + "zz"]) or "a"
        looked_up += index.candidates(text) is not None
        got = X.indexed_search(df, ["name", "code"], text, [("id", index)])
        want = df.filter(any_contains(["name", "code"], text))
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()), text
    assert looked_up >= 2


def test_short_and_frequent_patterns_are_scanned(spark, tmp_path):
    df = spark.createDataFrame([(i, f"client {i:04d}") for i in range(300)], "id long, name string")
    index = index_of(spark, tmp_path, df, "name")
    assert index.candidates("cl") is None and index.candidates("c%l_i") is None and index.candidates("client") is None
    assert {r.key for r in index.candidates("T 0123").collect()} == {123}
    assert index.candidates("xyz").isEmpty()


def test_changed_rows_are_found_after_add(spark, tmp_path):
    old = spark.createDataFrame([(1, "steel rod"), (2, "copper rod"), (3, "iron bar"), *[(i, f"n{i}") for i in range(10, 60)]], "id long, name string")
    index = index_of(spark, tmp_path, old, "name")
    now = old.withColumn("name", F.when(F.col("id") == 1, "steel tube").otherwise(F.col("name")))
    index.add(now.filter("id = 1"))
    assert [r.id for r in X.indexed_search(now, ["name"], "tube", [("id", index)]).collect()] == [1]
    assert [r.id for r in X.indexed_search(now, ["name"], " ROD", [("id", index)]).collect()] == [2]  # the old posting is verified away


def test_search_reads_few_postings_and_few_rows(spark, tmp_path, monkeypatch):
    rows = spark.range(20_000).select("id", F.concat(F.lit("Order "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"))
    table = f"{tmp_path}/table"
    rows.repartitionByRange(8, "id").write.parquet(table)
    stored = spark.read.parquet(table)
    index = index_of(spark, f"{tmp_path}/index", stored, "name")
    found = index.candidates("r 001234")
    scan = plan_of(found)
    assert "PartitionFilters: [slot#" in scan or "slot#" in scan[scan.index("PartitionFilters"):]
    assert "PushedFilters: [" in scan and "In(gram" in scan.replace(" ", "")
    result = X.indexed_search(stored, ["name"], "r 001234", [("id", index)])
    assert [r.id for r in result.collect()] == [1234]
    assert "EqualTo(id,1234)" in plan_of(result).replace(" ", "") or "In(id" in plan_of(result).replace(" ", "")
    monkeypatch.setattr(X, "PUSHED_KEYS", 3)  # more candidates go through a join
    many = X.indexed_search(stored, ["name"], "r 00123", [("id", index)])
    assert sorted(r.id for r in many.collect()) == list(range(1230, 1240)) and "Join" in plan_of(many)


def test_two_tables_search(spark, tmp_path):
    t = make_tables(spark, clients=[{"id": 1, "name": "Acme Steel"}, {"id": 2, "name": "Other"}],
                    sales_orders=[{"id": i, "client_id": 1 + i % 2, "order_number": f"SO-{i:05d}"} for i in range(40)])
    indexes = (index_of(spark, f"{tmp_path}/o", t.sales_orders, "order_number"), index_of(spark, f"{tmp_path}/c", t.clients, "name"))
    for text in ("steel", "00017", "o-0000", "zzz"):
        got = L.list_sales_orders(t, search_text=text, indexes=indexes).collect()
        assert got == L.list_sales_orders(t, search_text=text).collect()


# --- Q20 deep pages --------------------------------------------------------------------------
@pytest.mark.parametrize("limit,page", [(7, 300), (500, 3), (900, 2), (1500, 1), (10, 249), (10, 251), (10, 9999), (2600, 1)])
def test_deep_pages_are_slices_of_the_sorted_rows(spark, limit, page):
    rng = random.Random(limit)
    rows = [(i, rng.choice([None, 1, 2, 2, 2, 3]), "x") for i in range(2500)]
    df = spark.createDataFrame(rows, "id long, day int, _page_part string").repartition(6)
    keys = [F.col("day").desc_nulls_first(), F.col("id").desc_nulls_first()]
    got = paging.page_with_totals(df, keys, page, limit).collect()
    ordered = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), -r[0]))
    assert [(r.id, r.day, r._page_part) for r in got] == ordered[(page - 1) * limit:page * limit]
    assert all((r.total_items, r.total_pages, r.current_page) == (2500, -(-2500 // limit), page) for r in got)


def test_a_deep_page_reads_the_parts_it_lies_in(spark):
    df = spark.range(20_000)
    page, total = paging.deep_rows(df, [F.col("id").asc()], 15_000, 10)
    assert total == 20_000 and [r.id for r in page.collect()] == list(range(15_000, 15_010))
    scan = plan_of(page)
    assert "PartitionFilters" in scan and "_page_part" in scan[scan.index("PartitionFilters"):]
    first, _ = paging.deep_rows(df, [F.col("id").asc()], 0, 10)
    rows_read = [f.inputFiles() for f in (page, first)]
    assert all(rows_read)
    assert paging.deep_rows(df.limit(0), [F.col("id").asc()], 5_000, 10)[0].isEmpty()


# --- §2.4 text order --------------------------------------------------------------------------
def test_names_sort_by_the_collation(spark):
    names = ["Árbol", "zeta", "arbusto", "Nube", "ñandú", "Álamo", "nzz", None, "Zeta"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    spanish = [r.name for r in df.orderBy(asc("name", "es"), asc("id")).collect()]
    assert spanish == ["Álamo", "Árbol", "arbusto", "Nube", "nzz", "ñandú", "zeta", "Zeta", None]
    assert [r.name for r in df.orderBy(asc("name"), asc("id")).collect()] == ["Nube", "Zeta", "arbusto", "nzz", "zeta", "Álamo", "Árbol", "ñandú", None]
    t = make_tables(spark, clients=[{"id": i, "code": "c", "name": n, "is_active": True} for i, n in enumerate(names)])
    assert [r.name for r in L.list_clients(t, collation="es").collect()] == spanish
    paged = L.list_clients(t, page=2, limit=3, collation="es").collect()
    assert [r.name for r in paged] == spanish[3:6] and L.list_clients(t, collation="es").schema["name"].dataType.simpleString() == "string"


# --- §2.10 toFixed ------------------------------------------------------------------------------
def fixed(x, places=2):
    """What JavaScript answers: the exact binary value, halves away from zero."""
    if x != x or abs(x) == float("inf"):
        return {True: "NaN"}.get(x != x) or ("Infinity" if x > 0 else "-Infinity")
    with localcontext() as c:
        c.prec = 400
        text = str(abs(Decimal(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return ("-" if x < 0 else "") + text


def test_to_fixed_rounds_the_binary_value(spark):
    listed = {1.005: "1.00", 0.125: "0.13", 2.675: "2.67", 1.255: "1.25", 10.235: "10.23", -1.5: "-1.50", -0.001: "-0.00", 0.0: "0.00",
              1e20: "100000000000000000000.00", 123456789012345680000.0: "123456789012345683968.00", 0.995: "0.99", 9.995: "9.99",
              1.45: "1.45", 8.345: "8.35", 0.005: "0.01", 5e-324: "0.00"}
    rng = random.Random(5)
    doubles = list(listed) + [0.375, 0.625, -0.125, 4503599627370497.5, 9007199254740993.0, 2.0 ** 60 + 2 ** 9, 0.9999999, 0.99499999999999999]
    doubles += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(2000)]
    doubles += [rng.randrange(10 ** 7) / 1000 for _ in range(2000)] + [rng.randrange(-10 ** 6, 10 ** 6) / 8 for _ in range(300)]
    doubles += [rng.random() * 10 ** rng.randrange(20) for _ in range(1000)]
    doubles = [x for x in doubles if x == x and abs(x) < 1e21] + [float("nan"), float("inf"), float("-inf")]
    for places in (0, 2, 5):
        got = spark.createDataFrame([(x,) for x in doubles], "x double").select("x", to_fixed("x", places).alias("t")).collect()
        assert [(r.x, r.t) for r in got if r.t != fixed(r.x, places)] == []
    assert [fixed(x) for x in listed] == list(listed.values())
    odd = spark.createDataFrame([(None,), (1e21,), (-1.5e300,)], "x double").select(to_fixed("x")).collect()
    assert [r[0] for r in odd] == [None, "1e+21", "-1.5e+300"]
