"""Trigram search against the scan: same rows for any term."""

from __future__ import annotations

import random
import tempfile
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import name_index
from shelfmark.plans import reports


@pytest.fixture(scope="module")
def shop(spark, seed):
    """Many names over few letters, odd ones among them, one name on a third of the products."""
    random.seed(6)
    names = ["".join(random.choices("abAB ", k=random.randint(0, 12))) for _ in range(300)]
    names += ["Straße", "ÉCLAIR", "éclair", "100% Wool", "a_b", "C:\\temp", "İstanbul", "日本茶碗", "aaa", "AAAA", None, "ab", ""] + ["Wireless Keyboard"] * 150
    products = [(k, n, 1 + k % 5, 1 + k % 5, D(k % 700), 5, 5) for k, n in enumerate(names)]
    product = spark.createDataFrame(products, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.PRODUCT.fields))
    return seed.replace(product=product)


@pytest.fixture(scope="module")
def index(spark, shop):
    return name_index.load_index(spark, name_index.save_index(shop.product, tempfile.mkdtemp(prefix="shelfmark-index-")))


def test_same_rows_as_the_scan_for_any_term(spark, shop, index):
    random.seed(8)
    terms = ["".join(random.choices("abAB %_", k=random.randint(0, 7))) for _ in range(25)]
    terms += ["straße", "éclair", "ÉCL", "100%", "a_b", "C:\\", "temp", "istanbul", "i̇stanbul", "本茶碗", "key", "KEYBOARD", "", "%", "aaaa", "zzz"]
    for term in terms:
        for escape in (False, True):
            if term.endswith("\\") and not escape:
                continue  # an invalid pattern for the scan as well
            got = rows(name_index.product_search(shop, index, term, 10, 600, escape, sort=False))
            want = rows(reports.product_search(shop, term, 10, 600, escape, sort=False))
            assert sorted(got, key=str) == sorted(want, key=str), (term, escape)
    got, want = (rows(f) for f in (name_index.product_catalogue(shop, index, "Board", None, 400), reports.product_catalogue(shop, "Board", None, 400)))
    assert got == want and got


def test_grams_and_candidates(spark, shop, index):
    assert name_index.grams_of(spark, "ab") == [] and name_index.grams_of(spark, "a%b_c") == []
    assert name_index.grams_of(spark, "Keys") == ["eys", "key"] and name_index.grams_of(spark, "ab%board") == ["ard", "boa", "oar"]
    assert name_index.grams_of(spark, "a%b", escape=True) == ["a%b"]
    found = name_index.candidates(index, ["eys", "key"]).count()
    assert found == 0 and name_index.candidates(index, ["eyb", "key"]).count() == 150
    assert index.count() == index.distinct().count()


def test_search_reads_the_postings_of_its_grams_only(shop, index):
    plan = name_index.product_search(shop, index, "keyboard", sort=False)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "In(gram" in plan
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_many_terms_at_once(spark, shop, index):
    terms = ["key", "KEYBOARD", "aba", "bab a", "zzz", "ab", "éclair", "straße", "key"]
    got = {r.term: r for r in name_index.search_report(shop, index, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert set(got) == {t for t in terms if len(t) >= 3}
    for term, r in got.items():
        assert r.ProductsFound == reports.product_search(shop, term, sort=False).count() <= r.Candidates
        assert r.Candidates <= shop.product.where(F.length("ProductName") >= 3).count()
