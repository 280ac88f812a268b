"""Problems 5, 7 and 8 against public tokenizers, numpy and their own bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lavra.llm import mixture, percentiles, tokens

AWKWARD = [
    None, "", " ", "   ", "a", "ção à", "ç", "<|endoftext|> x", "it's I'LL we've", "ab" * 3000, " " * 500, "\t\n\r\n x", "数字漢字 123٣", "\U0001f600\U0001f1e7 é", "1234567890" * 30,
    "　 \x1c\x85|", "a" * 5000,
]


def brute_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_segment_tree_against_scan():
    ranks = tokens.encoder(tokens.vocabulary_path()).ranks
    rng = random.Random(0)
    for _ in range(400):
        piece = "".join(rng.choice("abcer aio'ç1") for _ in range(rng.randint(1, 40))).encode()
        assert tokens.merge_piece(piece, ranks) == brute_merge(piece, ranks)
    assert tokens.merge_piece(b"a" * 97, ranks) == brute_merge(b"a" * 97, ranks)


def test_ids_against_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(tokens.vocabulary_path().replace(".tiktoken", ".json"))
    reference.encode_special_tokens = True
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(99, "a"), (99, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", tokens.token_ids(F.col("text")).alias("ids"), tokens.token_count(F.col("text")).alias("n"))
    for r in df.collect():
        want = reference.encode(r.text, add_special_tokens=False).ids if r.text else []
        assert r.ids == want and r.n == len(want), r.text
    assert df.limit(0).count() == 0


def test_percentiles_and_merging(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v), "x") for k in ("a", "b", None) for v in np.round(rng.lognormal(3, 2, 151), 2)]
    rows += [("neg", v, "y") for v in (-5.5, 0.0, -0.0, 3.25, -5.5)] + [("one", 7.0, None), ("none", None, None), ("nan", float("nan"), None)]
    df = spark.createDataFrame(rows, "k string, v double, value string")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    whole = percentiles.group_value_counts(df, ["k"], ["v"])
    halves = [percentiles.group_value_counts(df.where(f"pmod(xxhash64(k, v), 2) = {i}"), ["k"], ["v"]) for i in (0, 1)]
    for counts in (whole, percentiles.merge_counts(*halves)):
        got = {(r.k, r.fraction): (r.percentile, r.n_values) for r in percentiles.percentiles_from_counts(counts, ["k"], {"v": qs}).collect()}
        groups = {}
        for k, v, _ in rows:
            if v is not None and v == v:
                groups.setdefault(k, []).append(v)
        assert {k for k, _ in got} == set(groups)
        for k, values in groups.items():
            for q in qs:
                assert np.isclose(got[k, q][0], np.percentile(values, 100 * q), rtol=1e-12), (k, q)
                assert got[k, q][1] == len(values)
    assert percentiles.percentiles_from_counts(whole.limit(0), ["k"], {"v": qs}).count() == 0
    with pytest.raises(ValueError):
        percentiles.percentiles_from_counts(whole, ["k"], {"v": [1.5]})


def test_latest_and_off_by(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (1, 2, 7.0), (2, None, 1.0), (3, None, None)], "id long, ver int, v double")
    got = {r.id: r.v for r in percentiles.latest_versions(df, ["id"], "ver", ["v"]).collect()}
    assert got == {1: 7.0, 2: 1.0, 3: None}
    exact = spark.createDataFrame([("m", "v", 0.5, 100.0)], "k string, column_name string, fraction double, percentile double")
    published = spark.createDataFrame([("m", 102.0, 102.1), ("m", None, 97.9), ("z", 1.0, 1.0)], "k string, a double, b double")
    found = percentiles.off_by(published, exact, ["k"], {"a": ("v", 0.5), "b": ("v", 0.5)}, 0.02)
    assert sorted((r.k, r.column_name) for r in found.collect()) == [("m", "b"), ("m", "b")]


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, " Big " if i % 3 else "SMALL", rng.randint(1, 60), "q") for i in range(900)] + [(1000 + i, "other", 9, "q") for i in range(50)] + [(2000, None, 5, "q"), (2001, "big", 0, "q")]
    d = spark.createDataFrame(docs, "doc_id long, source string, size long, slot string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixture.mix(d, t, F.col("size"), block_tokens=60)
    rows = mix.collect()
    uses = {}
    for r in rows:
        uses.setdefault(r.doc_id, []).append(r.repeat_no)
    assert all(len(u) == len(set(u)) <= (1 if docs[k][1] == " Big " else 3) for k, u in uses.items())
    shares = {r.source: r for r in mixture.reached_shares(mix, t).collect()}
    assert abs(shares["big"].actual_share - 5 / 9) < 0.03 and abs(shares["small"].actual_share - 4 / 9) < 0.03
    assert shares["absent"].actual_share == 0 and shares["absent"].most_repeats == 0
    total = sum(r.n_tokens for r in rows)
    limit = min(sum(s for _, n, s, _ in docs if n == " Big ") * 9 / 5, 3 * sum(s for _, n, s, _ in docs if n == "SMALL") * 9 / 4)
    assert 0.95 * limit <= total <= 1.02 * limit
    # Every stretch of the schedule is mixed as the whole.
    by_slot = sorted(rows, key=lambda r: r.slot)
    half = by_slot[: len(by_slot) // 2]
    assert abs(sum(r.n_tokens for r in half if r.source == "big") / sum(r.n_tokens for r in half) - 5 / 9) < 0.05
    assert sorted(map(str, rows)) == sorted(map(str, mixture.mix(d, t, F.col("size"), block_tokens=60).collect()))
    assert sum(r.n_tokens for r in mixture.mix(d, t, F.col("size"), total_tokens=3000, block_tokens=60).collect()) <= 3300
    assert mixture.mix(d.limit(0), t, F.col("size")).count() == 0
    assert mixture.mix(d, t.limit(0), F.col("size")).count() == 0


def test_schedule_is_low_discrepancy(spark):
    rows = mixture.schedule(spark, {"a": 0.5, "b": 0.3, "c": 0.2}, 10_000).collect()
    for name, share in {"a": 0.5, "b": 0.3, "c": 0.2}.items():
        own = sorted((r.slot, r.nth) for r in rows if r.source == name)
        assert [n for _, n in own] == list(range(len(own)))
        assert all(abs(n - s * share) < 6 for s, n in own)
