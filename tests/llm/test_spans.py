"""Problem 9 against brute force."""

import random

from pyspark.sql import functions as F

from lavra.llm import spans


def brute(docs, span):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in docs:
        covered = set()
        for i in range(len(t or "") - span + 1):
            if len(where[t[i : i + span]]) > 1:
                covered.update(range(i, i + span))
        if covered:
            out[d] = max(out.get(d, 0), len(covered))
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij éã漢\U0001f600") for _ in range(n))
    docs = [[i, word(rng.randint(150, 900))] for i in range(60)]
    for length in (199, 200, 200, 201, 230, 260, 300, 500, 199, 200, 205, 210):
        passage = word(length)
        for i in rng.sample(range(60), rng.choice([2, 2, 3, 9])):
            at = rng.choice([0, len(docs[i][1]), rng.randint(0, len(docs[i][1]))])
            docs[i][1] = docs[i][1][:at] + passage + docs[i][1][at:]
    twice = word(300)
    docs += [[100, twice + word(50) + twice], [101, None], [102, ""], [103, word(199)], [104, docs[0][1]], [104, docs[0][1]], [105, "x" * 450], [106, "y" + "x" * 350]]
    docs += [[None, docs[3][1]], [110, word(40_000) + docs[5][1]], [111, "ab" * 300], [112, "z" + "ab" * 200 + "q"]]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, owner string")
    got = {r.doc_id: r.shared_chars for r in spans.shared_spans(df).collect()}
    assert got == brute([d for d in docs if d[0] is not None], 200)
    assert spans.shared_spans(df.limit(0)).count() == 0


def test_every_shared_span_has_a_common_chunk():
    rng = random.Random(1)
    import numpy as np

    window = spans.cut_window(200)
    hasher = spans.SpanHasher(11)

    def digests(text):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        p, q, _ = spans._chunks(codes, np.array([0, len(codes)]), window)
        before, after = spans._reach(window)
        return set(hasher.of(hasher.sums(codes), p - before, q + after + 1).tolist())

    for alphabet in ("ab", "abcdefghijklmnop ", "a"):
        for _ in range(150):
            word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))  # noqa: B023, E731
            shared = word(200)
            a, b = word(rng.randint(0, 300)) + shared + word(rng.randint(0, 300)), word(rng.randint(0, 300)) + shared + word(rng.randint(0, 300))
            assert digests(a) & digests(b)


def test_window_bounds():
    for span in range(100, 400):
        w = spans.cut_window(span)
        assert span - 2 * w - 29 >= 2 * w


def test_hashes_do_not_depend_on_the_place(spark):
    import numpy as np

    h = spans.SpanHasher(11)
    codes = np.array([5, 6, 7, 1, 5, 6, 7, 1], np.uint32)
    sums = h.sums(codes)
    a = h.of(sums, np.array([0, 4, 0]), np.array([3, 7, 4]))
    assert a[0] == a[1] != a[2]
    tree = spans.TreeHasher(3, 29).all(codes)
    assert tree[0] == tree[4] and len(set(tree.tolist())) == 4 and len(spans.TreeHasher(9, 29).all(codes)) == 0


def test_second_hash_is_not_linear():
    """A Thue-Morse text and its complement, which running sums modulo 2^64 cannot tell apart, have other hashes."""
    import numpy as np

    bits = np.array([bin(i).count("1") % 2 for i in range(4096)], np.uint32)
    a, b = (spans.SpanHasher(11).of(spans.SpanHasher(11).sums(t), np.array([0]), np.array([4096])) for t in (bits + 97, 98 - bits))
    assert a[0] == b[0]
    for span in (200, 1024, 4096):
        assert not np.intersect1d(spans.TreeHasher(span, 29).all(bits[:span] + 97), spans.TreeHasher(span, 29).all(98 - bits[:span])).size


def test_one_id_with_several_texts(spark):
    """Texts of one id share nothing with each other, and each is measured by itself."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    x, y = word(300), word(250)
    docs = [(1, word(40) + x), (1, x + word(10) + y), (2, word(20) + y), (3, word(400))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.shared_chars for r in spans.shared_spans(df).collect()} == brute(docs, 200) == {1: 250, 2: 250}
    assert spark.range(1).select(F.lit(1)).count() == 1
