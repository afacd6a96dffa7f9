"""Each operator against a brute-force version, and on the odd tables: null, empty, repeated, clashing, none at all."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import bpe, common, embedding_dedup, exact_dedup, language_id, packing, pii, separator_scan, simhash, token_files, toxicity
from folioscope.llm.queries import tokenizer_path
from folioscope.llm.tokens import IdEncoder, load_tokenizer

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor " * 3000
ROWS = [
    (1, "The cat's 2 hats, mail a.b@c.org!", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "The cat's 2 hats, mail a.b@c.org!", "en"),
    (4, "The cat's 2 hats, mail a.b@c.org!", "en"),
    (5, LONG, "la"),
    (6, "日本語 text Ünïcödé ÇA <|endoftext|> \x1c odd", ""),
    (7, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa aa a", "en"),
    (None, "no id here", "en"),
    (9, " \t\n ", "en"),
]
#: Extra columns with names that clash with results and with names used inside.
EXTRA = ["base", "spans", "score", "digest", "key", "n", "text_sha256", "keep_id", "_x"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for c in EXTRA:
        df = df.withColumn(c, F.lit("extra"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()), key=repr)


def texts():
    return [(d, t or "") for d, t, _ in ROWS]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(path, special=True):
    tok = load_tokenizer(path)
    if not special:
        tok.encode_special_tokens = True
    return tok, [(d, tok.encode(t, add_special_tokens=False).ids) for d, t in texts()]


# --- 2, 3, 5, 6: tokens -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_encode_as_the_library_does(path):
    rng = random.Random(3)
    signs = "aaabbc  ''sdtreIΣςİßéñ日ก한1٣½ﬁ!?\n\t\xa0\x1c\x85​😀—“ẞȺK"
    cases = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["<|endoftext|> a<|startoftext|>", "a" * 3000]
    got = IdEncoder(path)
    tok = load_tokenizer(path)
    assert [np.frombuffer(x, got.dtype).tolist() for x in got(cases)] == [tok.encode(c, add_special_tokens=False).ids for c in cases]
    if path == WORD:
        tok_ids = [tok.encode(c, add_special_tokens=False).ids for c in cases]
        made = list(bpe.BPECodec(path).encode_decode(cases))
        assert made == [(" ".join(map(str, i)), len(i), tok.decode(i, skip_special_tokens=False)) for i in tok_ids]


def test_bpe_digests_and_ids(docs, none):
    tok, ids = encoded(WORD)
    want = [(d, len(i), sha(" ".join(map(str, i))), sha(tok.decode(i, skip_special_tokens=False))) for d, i in ids]
    assert rows(bpe.digests(docs, WORD)) == sorted(want, key=repr)
    full = bpe.encode(docs, WORD)
    assert rows(full.select("doc_id", "ids", "score")) == sorted(((d, i, "extra") for d, i in ids), key=repr)
    assert bpe.digests(none, WORD).count() == 0


def test_separator_scan_stitches_blocks(docs, none):
    _, ids = encoded(BYTE, special=False)
    manifest, order = separator_scan.write_flat(docs, BYTE, 50256)
    for block in (7, 1000, 1 << 20):
        got = order.join(separator_scan.scan(manifest, 50256, block), ["file", "nth"])
        assert rows(got, "doc_id", "n_tokens") == sorted(((d, len(i) + 1) for d, i in ids), key=repr)
        spans = sorted((r["start"], r["n_tokens"]) for r in got.collect())
        at = 0
        for start, n in spans:
            assert start == at
            at += n
    assert separator_scan.token_counts(none, BYTE, 50256).count() == 0


def test_token_records_round_trip(docs, none):
    _, ids = encoded(WORD)
    manifest = token_files.write_records(docs, WORD, end_id=1)
    got = token_files.read_records(manifest, piece=500).collect()
    assert sorted(((r["doc_id"], r["ids"], r["ids_crc32"]) for r in got), key=repr) == sorted(((d, [*i, 1], crc([*i, 1])) for d, i in ids), key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    known = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert known == sorted(known)
    assert token_files.read_records(token_files.write_records(none, WORD, 1)).count() == 0


def test_a_broken_record_is_noticed():
    record = token_files.frame(b"\0" * 8 + (2).to_bytes(4, "little") + b"abcd")
    assert token_files.unframe(record)[1].tolist() == np.frombuffer(b"abcd", "<u2").tolist()
    for at in range(len(record)):
        with pytest.raises(ValueError):
            token_files.unframe(record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :])


def test_packing(docs, none):
    _, ids = encoded(BYTE)
    got = packing.pack_documents(docs, BYTE, end_id=2, capacity=64)
    want = []
    for d, i in ids:
        i = [*i, 2]
        cut = [0, *range(len(i) % 64 or min(64, len(i)), len(i) + 1, 64)]
        want += [(d, n, a, b - a, crc(i[a:b])) for n, (a, b) in enumerate(zip(cut, cut[1:]))]
    out = got.collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, BYTE, 2, 64).count() == 0


@pytest.mark.parametrize("most", [200_000, -1])
def test_packing_writes_its_pieces_alone_and_shuffles_only_many_sums(spark, monkeypatch, tmp_path, most):
    held = {"spark.sql.shuffle.partitions": "29", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in held}
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(packing, "BROADCAST_ROWS", most, raising=False)
    rng = random.Random(5)
    sizes = [(n, rng.randint(1, 64)) for n in range(3000)]
    items = spark.createDataFrame(sizes, "item long, length long").repartition(3)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        packed = packing.pack(items, 64)
        tasks, out = packed.rdd.getNumPartitions(), packed.collect()
        left = [f.relative_to(tmp_path).parts[0].split("-")[0] for f in tmp_path.rglob("part-*.parquet")]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert left == ["pieces"] * 3
    assert tasks <= 4 if most > 0 else tasks == 29
    assert sorted((r["item"], r["length"]) for r in out) == sizes
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in map(sorted, bins.values()):
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(own[-1]) <= 64
    counts = {x: sum(n == x for _, n in sizes) for x in range(1, 65)}
    assert len(bins) == sum(n for _, n in packing.plan(counts, 64))


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """No plan has fewer bins: for each k, pieces over half the capacity, and what of the others their bins can't hold."""
    best = 0
    for k in range(capacity // 2 + 1):
        big = {x: n for x, n in counts.items() if x > capacity / 2}
        room = sum(n * (capacity - x) for x, n in big.items() if x <= capacity - k)
        small = sum(x * n for x, n in counts.items() if k <= x <= capacity / 2)
        best = max(best, sum(big.values()) + max(0, -(-(small - room) // capacity)))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_the_plan_uses_every_piece_once_and_fills_exactly(seed):
    rng = random.Random(seed)
    counts = {x: rng.randint(1, 400) for x in rng.sample(range(1, 257), 60)}
    plan = packing.plan(counts, 256)
    used = defaultdict(int)
    for lengths, n in plan:
        assert sum(lengths) <= 256 and n > 0
        for x in lengths:
            used[x] += n
    assert used == counts
    assert sum(n for _, n in plan) <= 1.03 * least_bins(counts, 256) + 2
    assert packing.plan({100: 3, 60: 1, 96: 1}, 256) [0] == ((100, 96, 60), 1)  # a pair sum fills the gap


# --- 4, 9, 10: copies ---------------------------------------------------------------------------------------------


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for d, t in texts():
        groups[t].append(d)
    keep = {t: max((x for x in own if x is not None), default=None) for t, own in groups.items()}
    want = sorted(((d, keep[t], len(groups[t]), d == keep[t], sha(t)) for d, t in texts()), key=repr)
    for snap in (None, F.col("doc_id") < 4, F.lit(True), F.lit(False)):
        assert rows(exact_dedup.dedup(docs, snap)) == want
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id", "text") == sorted(((d, t) for d, t, _ in ROWS if d == keep[t or ""]), key=repr)
    assert exact_dedup.dedup(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0


def test_exact_dedup_salts_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 7)
    monkeypatch.setattr(exact_dedup, "BUCKET", 20)
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.dedup(df).filter("group_size > 1")
    assert got.count() == 100 and [r["keep_id"] for r in got.select("keep_id").distinct().collect()] == [297]


def brute_fingerprint(text, words):
    import xxhash

    own = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not own:
        return 0
    hashes = [xxhash.xxh64(" ".join(own[k : k + words]).encode(), seed=42).intdigest() for k in range(max(1, len(own) - words + 1))]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def brute_components(ids, linked):
    up = dict(enumerate(range(len(ids))))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    low = {}
    for k, d in enumerate(ids):
        low.setdefault(find(k), []).append(d)
    return [min(x for x in low[find(k)] if x is not None) if any(x is not None for x in low[find(k)]) else None for k in range(len(ids))]


@pytest.mark.parametrize("bits", [4, 6])
def test_simhash(spark, docs, none, bits):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    made = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            made.append(" ".join(own))
    every = [(d, t) for d, t in texts() if d is not None] + [(100 + k, t) for k, t in enumerate(made)]
    fps = [brute_fingerprint(t, 4) for _, t in every]
    linked = [(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= bits]
    component = brute_components([d for d, _ in every], linked)
    df = spark.createDataFrame(every, "doc_id long, text string").withColumn("fp", F.lit(1)).repartition(5)
    want = sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(every, fps, component)), key=repr)
    assert rows(simhash.near_duplicates(df, 4, bits)) == want
    assert any(len([c for c in component if c == x]) > 2 for x in component)
    assert simhash.near_duplicates(none, 4, bits).count() == 0
    kept = simhash.drop_near_duplicates(docs, 4, bits)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == [(1,), (2,), (5,), (6,), (7,), (None,)]


def test_simhash_deals_long_lists_over_units(spark, monkeypatch):
    monkeypatch.setattr(simhash, "UNIT", 8)
    ids = spark.range(200).select("id", (F.col("id") * 1).alias("fp"))
    got = simhash.links(ids, 4).collect()
    component = brute_components(list(range(200)), [(r["a"], r["b"]) for r in got])
    assert set(component) == {0} and all((r["a"] ^ r["b"]).bit_count() <= 8 for r in got)


def test_byte_blocks_cover():
    from itertools import combinations

    for least in range(1, 9):
        blocks = [set(b) for b in simhash.byte_blocks(least)]
        assert all(any(b <= set(c) for b in blocks) for c in combinations(range(8), least))


def test_embeddings(spark, none):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    near = base[rng.integers(0, 60, 150)] + 0.12 * rng.standard_normal((150, 16))
    vectors = [v.astype(np.float32).tolist() for v in [*base, *near]]
    vectors += [vectors[0]] * 3 + [[0.0] * 16, None, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0], []]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").withColumn("n", F.lit(3)).repartition(4)

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b or not len(a):
            return 0
        a, b = np.array(a, dtype=float), np.array(b, dtype=float)
        if not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
            return 0
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    linked = [(a, b) for b in range(len(vectors)) for a in range(b) if cosine(vectors[a], vectors[b]) >= 0.9]
    n = [0] * len(vectors)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    component = brute_components(list(range(len(vectors))), linked)
    got = rows(embedding_dedup.near_duplicates(df, 0.9, recall=0.99999))
    assert got == sorted(((k, n[k], component[k], component[k] == k) for k in range(len(vectors))), key=repr)
    assert embedding_dedup.near_duplicates(df.filter("false"), 0.9).count() == 0


def test_embeddings_deal_long_lists_over_units(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "UNIT", 16)
    rng = np.random.default_rng(1)
    v = rng.standard_normal(8)
    df = spark.createDataFrame([(k, (v + 0.01 * rng.standard_normal(8)).tolist()) for k in range(150)], "vec_id long, embedding array<double>")
    assert set(rows(embedding_dedup.near_duplicates(df, 0.9), "n_links", "component_id")) == {(149, 0)}


def test_the_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((2, 400, 64))
    b = a + 0.5 * b
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    turn = embedding_dedup.rotations(64, 1)
    ua, ub = a @ turn.T, b @ turn.T
    code = np.sign(ua) / 8
    f = (code * ua).sum(1)
    error = (code * ub).sum(1) / f - (a * b).sum(1)
    bound = embedding_dedup.SURE * np.sqrt(1 - f**2) / f / np.sqrt(63)
    assert abs(error.mean()) < 0.01 and (np.abs(error) <= bound).all()


# --- 1, 7, 8: classifiers and personal data -------------------------------------------------------------------------


def test_toxicity(spark, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    made = []
    for k in range(600):
        own = [word() for _ in range(rng.randint(5, 60))]
        bad = k % 4 == 0
        if bad:
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(len(own))] = rng.choice(["idiot", "zuppvile", "zuppmean", "zuppgrim"])
        made.append((k, " ".join(own), int(bad)))
    df = spark.createDataFrame([(d, t) for d, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in made if d % 3], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df.withColumn("score", F.lit("x")), model).collect()}
    held = [(got[d] >= 0.7, y) for d, _, y in made if d % 3 == 0]
    assert np.mean([p == y for p, y in held]) > 0.97 and all(0 <= s <= 1 for s in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot " * 20000)], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert score[1] == score[2] < 0.5 < score[3]
    assert rows(toxicity.score(odd, model, most=0.7), "doc_id") == [(1,), (2,)]
    nothing = toxicity.fit(df, labels.filter("false"))
    assert {r["score"] for r in toxicity.score(odd, nothing).collect()} == {0.0} or max(r["score"] for r in toxicity.score(odd, nothing).collect()) < 0.01
    assert toxicity.score(none, model).count() == 0


def test_language(spark, docs, none):
    rng = random.Random(7)
    parts = {"xx": ["ba", "do", "ki"], "yy": ["zu", "ve", "ont"], "zz": ["ql", "éé", "rr"]}
    speak = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(n))
    made = [(n, speak(k, rng.randint(3, 40)), k) for n, k in enumerate(list(parts) * 80)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, model).collect()}
    assert np.mean([got[d][0] == k for d, _, k in made if d % 4 == 2]) > 0.97
    assert all(0 <= s <= 1 for _, s in got.values())
    mixed = model.predict(speak("xx", 60) + " " + speak("yy", 30))
    assert mixed[0] == "xx" and 0.5 < mixed[1] < 0.8
    assert model.predict(None) == model.predict("") == model.predict("12 !? \n") == ("und", 0.0)
    assert language_id.fit(none, F.lit(True)).predict("abc") == ("und", 0.0)
    assert language_id.identify(docs, model).count() == len(ROWS) and language_id.identify(none, model).count() == 0


def brute_pii(text):
    """The plain patterns, as the contract words them."""
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for n, (k, p) in enumerate(kinds):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")) or k == "card" and not (14 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), n, f"{k}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_pii(spark, docs, none):
    rng = random.Random(8)
    bits = ["a@b.c", "x.y@z-q.org.", "1.2.3.4", "256.1.1.1", "001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (234) 555-7890", "+1234567890123456", "é", "日", "😀", " ", "-", "7", "+", "@", ".", "a@b", "%d@e.f", "0000 0000 0000 0000 000", "\n"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["a" * 100_000, "1" * 100_000, "1 " * 50_000, "+1" * 20_000, "a." * 50_000 + "@x.y", "a@b.c%d@e.f"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string").repartition(4)
    for r in pii.report(df).collect():
        want = brute_pii(cases[r["doc_id"]])
        assert r["base_sha256"] == sha(want), cases[r["doc_id"]]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [want.count(k + ":") for k in ("email", "ip", "card", "phone")]
    assert pii.report(none).count() == 0
    done = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect() if r["doc_id"] != 4}
    assert done[1] == "The cat's 2 hats, mail <email>!" and done[2] is None and done[3] == "" and pii.redact(docs).columns == docs.columns


def test_pii_adds_spans_by_context(spark):
    cases = {"call me at (234) 555-7890 now": "<phone>", "order 234-555-7890 is late": None, "my ssn is 123-45-6789.": "<ssn>", "part 123-45-6789": None, "write to jo (at) home (dot) org": "<email>", "a stay at home dot matrix": None, "invoice 1234567890123456": None}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in pii.redact(df).collect():
        text, mark = list(cases.items())[r["doc_id"]]
        assert (mark in r["text"]) if mark else r["text"] == text


def test_pii_needs_no_python(docs):
    plan = pii.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
