"""Pseudonyms: a plain Python Feistel network, validity, linking, bijection."""

import hashlib
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from corpusdelta.llm import pii


def slow_feistel(values, radices, key, kind):
    half = -(-len(values) // 2)
    left, right = list(values[:half]), list(values[half:])
    for step in range(1, pii.ROUNDS + 1):
        own, other, limit = (left, right, radices[:half]) if step % 2 else (right, left, radices[half:])
        seed = ",".join(map(str, other))
        for i, m in enumerate(limit):
            h = hashlib.sha256("|".join([key, kind, str(step), seed, str(i)]).encode()).hexdigest()
            own[i] = (own[i] + int(h[:13], 16)) % m
    return left + right


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def run(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_feistel_equals_the_plain_one_and_permutes(spark):
    radices = [3, 5, 4]
    df = spark.range(60).select("id", F.array(F.col("id") % 3, F.floor(F.col("id") / 3) % 5, F.floor(F.col("id") / 15)).alias("v"))
    got = df.select("v", pii.feistel(F.col("v"), F.array(*[F.lit(r).cast("bigint") for r in radices]), "key", "t").alias("n")).collect()
    assert all(r.n == slow_feistel(r.v, radices, "key", "t") for r in got)
    assert len({tuple(r.n) for r in got}) == 60


def test_each_kind_keeps_its_format_and_validity(spark):
    texts = ["write gmeg.95@mail9.example.com!", "+1 (632) 555-4827", "632.555.4827", "17.252.227.210", "4337166598464399", "4337-1665-9846-4399",
             "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "2001-09-11", "24.12.1999", "123-45-6789", "+49 30 1234567"]
    out = run(spark, texts)
    for a, b in zip(texts, out):
        assert a != b and len(a) == len(b)
        shape = lambda s: re.sub("[0-9]", "9", s)
        assert shape(re.sub("[a-z]", "a", re.sub("[A-Z]", "A", a))) == shape(re.sub("[a-z]", "a", re.sub("[A-Z]", "A", b))) or "." in a and a.count(".") == 3
    assert out[0].endswith("@mail9.example.com!") and out[1].replace("+1 (", "").replace(") ", "-") == out[2].replace(".", "-")
    assert all(int(o) < 256 for o in out[3].split("."))
    assert luhn(out[4]) % 10 == 0 and out[4] == out[5].replace("-", "") and out[4][0] == "4"
    assert iban_ok(out[6]) and iban_ok(out[7])
    date.fromisoformat(out[8])
    area, group, serial = map(int, out[10].split("-"))
    assert 0 < area < 900 and area != 666 and group and serial


def test_dates_and_numbers_are_permuted(spark):
    days = [str(date(1901, 1, 1) + timedelta(days=61 * i)) for i in range(1170)]
    out = run(spark, days)
    assert len(set(out)) == len(days) and all("1901-01-01" <= d <= "2096-12-31" for d in out)
    day = (date.fromisoformat(days[7]) - date(1901, 1, 1)).days
    a, b = slow_feistel([day // 487, day % 487], [147, 487], "k", "date")
    assert out[7] == str(date(1901, 1, 1) + timedelta(days=a * 487 + b))


@pytest.mark.parametrize("text", [None, "", "Version 2.0 of 1999, room 12-34", "4337166598464398", "300.1.2.3", "2001-02-30", "666-12-3456", "GB83 WEST 1234 5698 7654 32",
                                  "a@b", "é" * 5000])
def test_what_is_not_valid_stays(spark, text):
    assert run(spark, [text]) == [text]


def test_values_are_linked_and_rows_kept(spark):
    t = "17.252.227.210"
    long = "word " * 50_000 + t + " " + t
    df = spark.createDataFrame([(1, t, "x"), (1, t, "x"), (None, f"a {t}, b", "y"), (3, long, None), (4, None, "z")], "doc_id long, text string, _pieces string")
    out = pii.pseudonymise(df, "k", count_col="n").collect()
    new = out[0].text
    assert [r.text for r in out] == [new, new, f"a {new}, b", long.replace(t, new), None]
    assert [r.n for r in out] == [1, 1, 1, 2, 0] and [r._pieces for r in out] == ["x", "x", "y", None, "z"]
    assert run(spark, [t], "other key") != [new]
    assert pii.pseudonymise(df.limit(0), "k").columns == df.columns and pii.pseudonymise(df.limit(0), "k").count() == 0


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Python" not in pii.pseudonymise(df, "k")._jdf.queryExecution().executedPlan().toString()


def test_neighbours_do_not_hide_a_card_or_iban(spark):
    values = {"card": ["4111 1111 1111 1111", "4111111111111111", "3782 822463 10005"],
              "iban": ["AT61 1904 3002 3457 3201", "AT611904300234573201", "SE45 5000 0000 0583 9825 7466"]}
    around = {"card": [("", ""), ("", " 12/27"), ("", " 123"), ("", " 2 items"), ("5 ", ""), ("7 ", " 99"), ("1 2 3 4 5 ", " 6 7"), ("+49 30 1234567 ", "")],
              "iban": [("", ""), ("", " BIC BKAUATWW"), ("", " OK"), ("", " 2024"), ("OK ", ""), ("NR 12 ", " EUR 5")]}
    cases = [(kind, v, a, b) for kind in values for v in values[kind] for a, b in around[kind]]
    out = run(spark, [a + v + b for _, v, a, b in cases])
    alone = {v: new for (_, v, a, b), new in zip(cases, out) if a == b == ""}
    for v, new in alone.items():
        assert v != new and (iban_ok(new) if v[0].isalpha() else luhn(new) % 10 == 0)
    for (_, v, a, b), new in zip(cases, out):
        assert new == a + alone[v] + b or a.startswith("+") and new.endswith(alone[v]) and len(new) == len(a + v), (a, v, b, new)


CARD = re.compile(r"[0-9]{4}( |-)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(\1[0-9]{1,3})?|[0-9]{4}( |-)[0-9]{6}\3[0-9]{4,5}|[0-9]{13,19}")


def slow_values(text):
    """Valid cards and IBANs, tried at every place and length by plain code."""
    out, at = [], 0
    while at < len(text):
        best = ""
        for n in range(13, 43):
            v, after = text[at:at + n], text[at + n:at + n + 2]
            if len(v) < n or re.match("[0-9A-Za-z]", after):
                continue
            if v[0].isdigit():
                fits = CARD.fullmatch(v) and re.match("2[2-7]|[3-6]", v) and luhn(v) % 10 == 0 and not re.match(r"\.[0-9]", after) \
                    and not re.search(r"[0-9A-Za-z.+]\Z|(^|[^0-9])-\Z", text[:at])
            else:
                plain = v.replace(" ", "")
                fits = re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", plain) and plain[:2] in pii.IBAN_LENGTHS.get(len(plain), "").split("|") \
                    and v in (plain, " ".join(plain[i:i + 4] for i in range(0, len(plain), 4))) and iban_ok(plain) and not re.search(r"[0-9A-Za-z]\Z", text[:at])
            best = v if fits else best
        if best:
            out.append((at, best))
        at += len(best) or 1
    return out


def test_values_are_those_of_plain_search(spark, monkeypatch):
    import random
    rng = random.Random(8)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "3782 822463 10005", "AT61 1904 3002 3457 3201", "DE89370400440532013000",
             "4111", "1111", " ", " ", " ", "-", "12", "7", ".", "x", "\n", "AT61", "1904", "GB82", "4000 0000", "+", "378282246310005", "6011 0009 9013 9424 12"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    want = [slow_values(t) for t in texts]
    assert sum(map(len, want)) > 300
    for name in ("_card", "_iban"):  # mark the values instead of replacing them
        monkeypatch.setattr(pii, name, lambda v, key: F.concat(F.lit("«"), v, F.lit("»")))
    monkeypatch.setattr(pii, "ANY", "(?!)")
    for places in (256, 2):
        monkeypatch.setattr(pii, "PLACES", places)
        for t, w, got in zip(texts, want, run(spark, texts)):
            assert got.replace("«", "").replace("»", "") == t
            assert re.findall("«(.*?)»", got) == [v for _, v in w], t


def test_ordinary_numbers_stay(spark):
    import random
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(100)) for _ in range(12)) for _ in range(500)]
    texts += [" ".join(f"{rng.uniform(0, 1000):.2f}" for _ in range(12)) for _ in range(100)]
    texts += [", ".join(f"{rng.uniform(-90, 90):.6f} {rng.uniform(-180, 180):.6f}" for _ in range(6)) for _ in range(100)]
    texts += ["10 20 30 40 50 60 70 80 90 100 110 120", "1990 1991 1992 1993 1994 1995", "12:30 13:45 2.5e10 1,234,567,890,123", "v1.2.3.4.5 build 20240301123456"]
    assert run(spark, texts) == texts


def test_dates_before_times(spark):
    out = run(spark, ["at 2024-03-01T10:00:00Z.", "2024-03-01", "2024-03-01Today"])
    assert out[0] == f"at {out[1]}T10:00:00Z." and out[1] != "2024-03-01" and out[2] == "2024-03-01Today"


def test_long_numeric_text_takes_linear_time(spark):
    import time
    run(spark, ["1 4111 1111 1111 1111"])
    times = []
    for n in (12_500, 50_000):
        text = " ".join(str(1000 + i * 7919 % 9000) for i in range(n))
        began = time.time()
        out = run(spark, [text])[0]
        times.append(time.time() - began)
        found = slow_values(text[:3_000])
        assert len(out) == len(text) and found and out[:found[0][0]] == text[:found[0][0]] and out != text
    assert times[1] < 30
