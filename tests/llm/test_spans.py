"""Spans: the helpers and both scans against plain Python, and long texts with many hits."""

import math
import random
import re
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import EXTRA, ROWS, brute_pii, sha

from folioscope.llm import pii, secret_scan
from folioscope.llm import spans as sp

# --- helpers ----------------------------------------------------------------------------------------------------------


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").repartition(1).select(*columns).first()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 9000])
def test_matches_lie_where_the_plain_search_finds_them(spark, n):
    text = "é".join("x" * (k % 5) + "ab" * (k % 3) for k in range(n))
    got = one(spark, text, sp.matches(F.col("t"), "(?:ab)+|x", 3).alias("m")).m
    assert [(r.start, r.end, r.match, r.kind) for r in got] == [(m.start(), m.end(), m.group(), 3) for m in re.finditer("(?:ab)+|x", text)]


def test_parts_are_cut_at_any_place(spark):
    text = "".join(chr(97 + k % 26) if k % 7 else "😀" for k in range(5000))
    places = [(0, 0), (0, 1), (1023, 1024), (1023, 1025), (1024, 1024), (1000, 4000), (4999, 5000), (5000, 5001), (0, 5000), (3, 2)]
    got = one(spark, text, F.array(*[sp.cut(sp.chunks(F.col("t")), F.lit(a), F.lit(b)) for a, b in places]).alias("x")).x
    assert got == [text[a:b] if b > a else "" for a, b in places]


def test_apart_and_replaced_by_all_pairs(spark):
    rng = random.Random(3)
    for _ in range(6):
        draw = lambda n: sorted((a, a + rng.randint(1, 9)) for a in rng.sample(range(300), n))  # noqa: E731,B023
        base, more, text = draw(rng.randint(0, 20)), draw(rng.randint(1, 25)), "".join(rng.choice("abé") for _ in range(320))
        column = lambda rows: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(0).alias("kind"), F.lit(b).alias("end"), F.lit("").alias("match")) for a, b in rows]).cast(sp.SPAN)
        got = one(spark, text, sp.apart(column(more), column(base)).alias("a"), sp.replaced(F.col("t"), column(more), F.array(F.lit("k"))).alias("r"))
        assert [(s.start, s.end) for s in got.a] == [(a, b) for a, b in more if not any(c < b and a < d for c, d in base)]
        out, at = "", 0
        for a, b in more:
            out += text[at:a] + "<k>" if a >= at else ""
            at = max(at, b)
        assert got.r == out + text[at:]


# --- 8: personal data -------------------------------------------------------------------------------------------------


def plain_added(text, trees, least):
    """The added spans of a text by plain Python: generators, features, trees, thresholds, base spans left alone."""
    base = [tuple(map(int, x.split(":")[1:])) for x in filter(None, brute_pii(text).split(","))]


    def mod97(m):
        a = 0
        for c in m[4:] + m[:4]:
            v = ord(c) - 55 if "A" <= c <= "Z" else int(c) if c.isdigit() else 0
            a = (a * (100 if v > 9 else 10) + v) % 97
        return a

    luhn = lambda d: sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0
    out = []
    for g, (kind, p) in enumerate(pii.GENERATORS):
        for f in re.finditer(p.replace("(?i:", "(?ai:"), text):
            m, a, b = f.group(), f.start(), f.end()
            if any(c < b and a < d for c, d in base):
                continue
            d, before, after = re.sub("[^0-9]", "", m), text[max(a - 40, 0) : a], text[b : b + 1]
            said = lambda p: bool(re.search(p.replace("$", r"\Z"), before))  # noqa: E731,B023
            x = [g, len(d), len(m), len(re.sub("[A-Za-z0-9]", "", m)), len(set(d)) + (d == ""), "(" in m, bool(re.match("000|9|666", d)), said(pii.FOR), said(pii.AGAINST), bool(re.search("[A-Za-z0-9_/#.-]", before[-1:])), bool(re.search("[A-Za-z0-9_/-]", after)), luhn(d)]
            x += [mod97(m.replace(" ", "")) == 1, bool(re.search(r"(?i)[(\[{]at[)\]}]", m)), bool(re.search(r"(?i)[^a-z](com|org|net|edu|gov|io|de|fr|es|uk)\Z", m)), bool(re.search("[0-9]", m)), bool(re.search(r"(?:[0-9][A-Za-z]|[A-Za-z][0-9])[^:=]*\Z", m))]
            if trees.margin(np.array([x], dtype=float))[0] >= least[g]:
                out.append((a, pii.KINDS.index(kind), b))
    return out


def test_added_spans_equal_the_plain_version(spark):
    trees, least = pii.fitted(spark)
    rng = random.Random(21)
    texts = [" ".join(t for t, _ in rng.sample(pii.snippets(), 12)) + rng.choice(("", "\n", " \n a@b.org")) for _ in range(60)]
    texts += ["password: hunter2hunter2 and token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" in it", "the secret: everything-changes here", "(234) 555-7890 at the beginning", "ends with (234) 555-7890"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    differ = 0
    for r in pii.report(df).collect():
        t = texts[r["doc_id"]]
        base = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in filter(None, brute_pii(t).split(",")))]
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + plain_added(t, trees, least)))
        differ += r["spans"] != want
    assert differ == 0


def test_keys_and_passwords_go(spark):
    rows = ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" then', "password: Xk29dQ81mz then", "the token: ring-bearer_story then"]
    got = [r["text"] for r in pii.redact(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0].startswith("<secret>") and got[1].startswith("<secret>") and got[2] == rows[2]


def test_many_hits_in_a_long_text_take_linear_time(spark):
    line = "mail a.b@c.org or call +1 234 555 7890 now, filler words fill the line up to eighty\n"
    text = line * 25_000  # 2 MB, 50,000 base hits
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1)
    pii.fitted(spark)
    began = time.time()
    got = pii.report(rows).first()
    took = time.time() - began
    assert (got["n_email"], got["n_phone"]) == (25_000, 25_000) and got["base_sha256"] == sha(brute_pii(text))
    began = time.time()
    assert pii.redact(rows).first()["text"] == line.replace("a.b@c.org", "<email>").replace("+1 234 555 7890", "<phone>") * 25_000
    assert took < 20 and time.time() - began < 20, (took, time.time() - began)


# --- 12: secrets ------------------------------------------------------------------------------------------------------


def brute_secrets(text):
    """The plain patterns, as the contract words them."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[1]) >= 8]
    for k, p, n in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m.group()) >= n]
    return sorted(out)


def plain_bin(token):
    """Class of length and bin of a candidate by plain Python."""
    signs = token.rstrip("=")
    alphabet = next(a for a in secret_scan.ALPHABETS if set(signs) <= set(a))
    x = np.array([alphabet.index(c) for c in signs], dtype=float)
    n, k = len(x), len(alphabet)
    tail = lambda z: math.erfc(abs(z) / math.sqrt(2))
    chi = (k / n * sum(signs.count(c) ** 2 for c in set(signs)) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = x * 2 >= k
    even = 2 * high.sum() * (n - high.sum()) / n
    spread = even * (even - 1) / (n - 1)
    runs = tail(((high[1:] != high[:-1]).sum() + 1 - even - 1) / math.sqrt(spread)) if spread > 0 else 0.0
    d = x - x.mean()
    serial = tail(((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n)) if (d * d).sum() else 0.0
    p = min(3 * min(tail(chi), runs, serial), 1.0)
    return sum(n >= c for c in secret_scan.CLASSES[1:]), min(max(math.floor(-10 * math.log10(max(p, 1e-40))), 0), secret_scan.BINS - 1)


def test_the_battery_equals_the_plain_version(spark):
    rng = random.Random(9)
    tokens = ["".join(rng.choice(a) for _ in range(rng.randint(20, 70))) for a in (string.hexdigits[:16], string.ascii_letters + string.digits, "ABC", "ab", string.ascii_lowercase, string.ascii_letters + "+/") for _ in range(40)]
    tokens += ["a" * 40, "ab" * 20, "configuration_manager_service", "x" * 20 + "==", *secret_scan.decoys(100)]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").repartition(4).select("t", secret_scan.scored(secret_scan.candidates(F.col("t"), F.lit(True))).alias("s")).collect()
    near = [(r["s"][0]["cls"], r["s"][0]["bin"], *plain_bin(r["t"])) for r in got if r["s"]]
    assert len(near) >= 300 and all(a == c and abs(b - d) <= 1 for a, b, c, d in near)
    assert np.mean([b == d for _, b, _, d in near]) > 0.97  # the normal curve is a rational one


def test_cutoffs_keep_false_ones_below_their_share(spark):
    counts, shares = np.zeros((4, 10)), np.tile(np.linspace(0.02, 1, 10), (4, 1))
    counts[0, 0], counts[0, 9] = 50, 50  # 100 * 0.02 <= 0.05 * 50
    counts[1, 0], counts[1, 9] = 5, 95  # 100 * 0.02 > 0.05 * 5
    assert secret_scan.loosest(counts, shares, 0.05) == [0, -1, -1, -1]
    table = secret_scan.ordinary_shares(spark)
    assert (np.diff(table, axis=1) >= -0.05).all() and table.min() >= 0 and table.max() <= 1
    assert (table[2:, 5] < 0.02).all()  # long ordinary names seldom look random


def test_secrets_by_brute_force(spark):
    rng = random.Random(4)
    bits = ["token", "secret", "SECRET", "api_key", "apikey", "passwd", "password", '"', "'", " ", "  ", ":", "=", "abcdefgh", "abc", "AKIA", "AKIAABCDEFGHIJKL", "AKIA0123", "0123456789abcdef", "deadbeef" * 4, "é", "😀", ".", "-", "\n", "x1Y2z3", "ſecret", "toKen"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 16))) for _ in range(1500)] + ["token" + " " * 50_000 + "x", "a" * 100_000, "token=" * 20_000, "AKIA" * 20_000, "ab-" * 50_000]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").repartition(4)
    for r in secret_scan.report(df).collect():
        want = brute_secrets(cases[r["doc_id"]])
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == sha(text), cases[r["doc_id"]]
        assert [r[f"n_{k}"] for k in secret_scan.KINDS[:3]] == [sum(w[1] == n for w in want) for n in range(3)]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
        for extra in (x.split(":") for x in r["spans"].split(",") if x.startswith("random")):
            assert not any(a < int(extra[2]) and int(extra[1]) < b for a, _, b in want)


def test_random_keys_are_found_and_names_left(spark):
    rng = random.Random(5)
    words = "configuration manager service handler internal external application document processing request response parameter connection".split()
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (32, 40, 64) for _ in range(60)]
    names = [rng.choice("_-/").join(rng.choice(words) for _ in range(4)) for _ in range(400)]
    texts = [f"see {t} there" for t in keys + names]
    got = [bool(r["spans"]) for r in secret_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert np.mean(got[: len(keys)]) > 0.95 and np.mean(got[len(keys) :]) < 0.02


def test_secrets_on_odd_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for c in [*EXTRA, "found", "proposed", "long_run"]:
        docs = docs.withColumn(c, F.lit("extra"))
    got = secret_scan.report(docs).collect()
    assert len(got) == len(ROWS) and all(r["spans"] == ("hex:0:32" if r["doc_id"] == 7 else "") and r["base_sha256"] == sha(r["spans"]) for r in got)
    assert secret_scan.report(docs.filter("false")).count() == 0 and secret_scan.redact(docs.filter("false")).count() == 0
    df = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.lit("my token: 0123456789abcdef end")).otherwise(F.col("text")))
    done = secret_scan.redact(df)
    assert done.columns == docs.columns and {r["text"] for r in done.filter("doc_id = 1").collect()} == {"my <assign> end"} and done.count() == len(ROWS)
    plan = secret_scan.report(docs)._jdf.queryExecution().executedPlan().toString() + secret_scan._measured(docs, "text", "b1", "f1")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
