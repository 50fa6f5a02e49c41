from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from listingspark.functions import digests, numbers, reasons, text


def test_squash_and_label(one):
    values = ["  a \t b\n", " x  y ", "", None, "\x1fz"]
    assert one(text.squash, values) == ["a b", "x y", "", None, "z"]
    assert one(text.label, [" N/A", "unknown", "-", "Not   Available", "Base", None, ""]) == [None, None, None, None, "Base", None, None]


def test_title_case_starts_every_letter_run(one):
    values = ["d.i. khan-east x", "LAHORE", "o'town", "3-low", "été noir", ""]
    assert one(text.title_case, values) == [v.title() for v in values]
    assert one(text.category, ["cng", "Suv", "pick-up", None]) == ["CNG", "SUV", "Pick-Up", None]


def test_presence(one):
    assert one(text.is_present, [None, " ", "NaN", "<NA>", "0", "x"]) == [False, False, False, False, True, True]


def test_url_key_ignores_query_and_slash(one):
    assert one(text.url_key, ["https://www.example.com/a/b/?x=1#y", "http://WWW.EXAMPLE.com/a/b", "nonsense"]) == [
        "www.example.com/a/b", "www.example.com/a/b", "nonsense"]


def test_whole_number(one):
    values = ["1,300.0", "12.5", "abc", "", None, "NaN", "0", " 7 ", "2e3", "1.0000000001", "-4"]
    assert one(numbers.whole_number, values) == [1300, None, None, None, None, None, 0, 7, 2000, None, -4]


def test_first_number(one):
    assert one(numbers.first_number, ["about 66,000 km", "1300.5cc", "none", None]) == [66000, None, None, None]


def test_prices(one):
    values = ["PKR 4,300,000", "PKR 58.5 lacs", "now PKR 1.2 Crore only", "PKR 3 mn", "Call for price", "PKR 2.5 lakh"]
    assert one(numbers.displayed_price, values) == [4_300_000, 5_850_000, 12_000_000, 3_000_000, None, 250_000]


def test_price_band_is_half_open(one):
    assert one(numbers.price_band, [1_999_999.0, 2_000_000.0, 4_000_000.0, 6_000_000.0], "double") == [
        "under_2m", "2m_to_under_4m", "4m_to_under_6m", "6m_and_above"]


def test_numeric_verdicts(one):
    assert one(lambda c: numbers.numeric_verdict(c, "year"), ["x", "NaN", "-inf", "12.5", "0", "1850", "2020", "2020.0"]) == [
        numbers.NOT_A_NUMBER, numbers.NOT_FINITE, numbers.NOT_FINITE, numbers.NOT_WHOLE, numbers.NOT_POSITIVE, numbers.YEAR_RANGE, None, None]
    assert one(lambda c: numbers.numeric_verdict(c, "mileage_km"), ["0", "-1"]) == [None, numbers.NEGATIVE]


def test_reason_sets(one):
    assert one(lambda c: reasons.add(c, "m"), ["z;a", "", None, "m"]) == ["a;m;z", "m", "m", "m"]
    assert one(lambda c: reasons.remove(c, "a"), ["z;a;a", "a", ""]) == ["z", "", ""]


def test_digest_remainder_matches_big_integers(one):
    digests_ = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(200)]
    assert one(digests.digest_mod_10, digests_) == [int(d, 16) % 10 for d in digests_]


def test_fingerprint_ignores_order_but_not_content(spark):
    rows = [(i, f"v{i % 7}", None if i % 3 else float(i)) for i in range(100)]
    shuffled = random.Random(1).sample(rows, len(rows))
    one_ = digests.table_fingerprint(spark.createDataFrame(rows, "a int, b string, c double")).first()
    two = digests.table_fingerprint(spark.createDataFrame(shuffled, "a int, b string, c double").repartition(5)).first()
    other = digests.table_fingerprint(spark.createDataFrame(rows[1:] + rows[1:2], "a int, b string, c double")).first()
    assert one_ == two and one_ != other
    empty = digests.table_fingerprint(spark.createDataFrame([], "a int")).first()
    assert (empty["rows"], empty["fingerprint"]) == (0, "0-0-0-0")
    assert F is not None
