"""Importance resampling, whitening and token files against brute force, on small tables with awkward rows."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import awkward, empty, prose, table

from netloom.llm import importance, token_files, whitening


def grams(text, orders):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text) if w]
    return len(words), [" ".join(words[k : k + n]) for n in range(1, orders + 1) for k in range(len(words) - n + 1)]


def resampled(docs, target, orders=2, buckets=10_000, seed=7, percent=25, min_words=20):
    code = lambda g: zlib.crc32(g.encode()) % buckets
    of = [(i, *grams(x, orders)) for i, x in docs]
    s, t = Counter(code(g) for *_, gs in of for g in gs), Counter(code(g) for x in target for g in grams(x, orders)[1])
    ns, nt = s.total() + buckets, t.total() + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt))) for b in {*s}}
    rows = []
    for i, n, gs in of:
        weight = sum(gain[code(g)] for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("orders", "buckets", "percent"), [(2, 10_000, 25), (1, 50, 100), (3, 7, 40)])
def test_importance_equals_brute_force(spark, orders, buckets, percent):
    rng = random.Random(5)
    base = prose(rng, 40)
    texts = [*awkward(rng), *[prose(rng, rng.randint(15, 60)) for _ in range(30)], "A-Z É ß\x00x 日本語 a_b", "word " * 3000, (None, base), (None, base + " more"), (3, base), (3, base), (7, prose(rng, 30))]
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    target = ["", None, prose(rng, 50), base]
    out = importance.resample(table(spark, texts), table(spark, target), orders=orders, buckets=buckets, percent=percent)
    got = sorted((tuple(r) for r in out.documents.collect()), key=repr)
    assert got == resampled(rows, target, orders, buckets, percent=percent)
    assert out.gains.count() == buckets


def test_importance_of_empty_tables(spark):
    assert importance.resample(empty(spark), table(spark, ["a b"])).documents.count() == 0
    got = importance.resample(table(spark, ["x " * 30, None]), empty(spark)).documents.orderBy("doc_id").collect()
    assert [(r["n_features"], r["weight"]) for r in got] == [(59, resampled([(0, "x " * 30)], [])[0][3]), (0, 0)]


def test_importance_sql(spark, tmp_path):
    rng = random.Random(9)
    texts = [t for t in [*awkward(rng), "É a-b_c 日本 Ab"] if t is not None] + [prose(rng, 25) for _ in range(20)]
    con = duckdb.connect()
    for name, rows in (("documents", texts), ("benchmark", [prose(rng, 30), base := texts[0]])):
        con.execute(f"CREATE TABLE {name} (doc_id BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", list(enumerate(rows)))
    expected = {tuple(r) for r in con.execute(importance.SQL).fetchall()}
    out = importance.resample(table(spark, texts), table(spark, [r[0] for r in con.execute("SELECT text FROM benchmark").fetchall()])).documents
    assert base and {tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()} == expected


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component string")


def brute(rows, k=16):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, np.floor(64 * v).astype(np.int64) + 1_000_000) for i, v in good]
    fit = np.unique(np.stack([v for _, v in x]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    e, w = np.linalg.eigh(np.cov(fit.T.astype(float) - 1_000_000, bias=True))
    return x, n, sums, e[::-1][:k], w[:, ::-1][:, :k], e.sum()


@pytest.mark.parametrize("fall", [0.3, 1.0])
def test_whitening_equals_eigenvectors(spark, fall):
    """With a falling spectrum the random range is enough, with a flat one the whole space is needed."""
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    values = (rng.standard_normal((700, 40)) * 40 * fall ** np.arange(40)) @ basis.T
    rows = [(k, v.tolist()) for k, v in enumerate(values)]
    rows += [(1, rows[1][1]), (900, rows[1][1]), (901, None), (902, []), (903, [None] * 40), (904, [float("nan")] * 40), (905, [*rows[0][1][:39], float("-inf")]), (None, rows[5][1])]
    k = 4 if fall < 1 else 16
    model = whitening.fit_whitening(vectors(spark, rows), k=k)
    x, n, sums, e, w, trace = brute(rows, k)
    assert (model.n, [s + n * 1_000_000 for s in model.sums], model.dim, model.full) == (n, sums.tolist(), 40, fall == 1.0)
    assert model.passes < 9 and model.identity_error < 1e-9 and np.allclose(model.variances, e, rtol=1e-11) and abs(model.trace / trace - 1) < 1e-12
    got = whitening.long_form(whitening.whiten(vectors(spark, rows), model), model).collect()
    sign = np.sign((w * model.components).sum(axis=0))
    expected = sorted((repr(i), c + 1, n, int(((n * v - sums) ** 2).sum()), y) for i, v in x for c, y in enumerate(((v - sums / n) @ w * sign / np.sqrt(e)).tolist()))
    got = sorted((repr(r["vec_id"]), r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got)
    assert len(got) == len(expected) == len(x) * k
    for a, b in zip(got, expected, strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-8 and abs(a[5] - e[a[1] - 1] / trace) < 1e-12


def test_whitening_of_odd_tables(spark):
    none = whitening.fit_whitening(vectors(spark, [(1, None), (2, [])]))
    assert none is None and whitening.long_form(whitening.whiten(vectors(spark, []), none), none).count() == 0
    one = [(1, [0.5, 0.25]), (2, [0.5, 0.25])]  # a single distinct vector has no direction with variance
    model = whitening.fit_whitening(vectors(spark, one))
    assert model.n == 1 and len(model.variances) == 0 and [tuple(r) for r in whitening.whiten(vectors(spark, one), model).collect()] == [(1, 0, []), (2, 0, [])]
    assert whitening.long_form(whitening.whiten(vectors(spark, one), model), model).count() == 0
    mixed = [(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, [4.0, -5.0]), (4, [1.0, 1.0, 1.0]), (5, [9e30, 1.0, 1.0])]
    model = whitening.fit_whitening(vectors(spark, mixed))
    got = whitening.whiten(vectors(spark, mixed), model).collect()
    assert model.dim == 2 and sorted(r["vec_id"] for r in got) == [1, 2, 3] and all(len(r["whitened"]) == 2 for r in got)
    huge = [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 2.0])]  # deviations beyond a long are null
    model = whitening.fit_whitening(vectors(spark, huge))
    assert model.n == 3 and {r["deviation"] for r in whitening.whiten(vectors(spark, huge), model).collect()} == {None}


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("block", [1, 3, 100, 1024, 65536])
@pytest.mark.parametrize("top", [1, 2, 300, 50_257, 1 << 32])
def test_token_file_codec(block, top):
    rng = np.random.default_rng(block)
    ids = rng.integers(0, top, 3000, dtype=np.uint64).astype("<u4")
    ids[rng.integers(0, 3000, 2000)] = ids.min()  # few outliers above narrow values
    sink = io.BytesIO()
    writer = token_files.Writer(sink, block)
    for at in range(0, 3000, 500):
        writer.add(None if at == 500 else at - 1000, ids[at : at + 500])
    writer.close()
    reader = token_files.Reader(Bytes(sink.getvalue()))
    assert reader.n == 3000 and (reader.read(0, 3000) == ids).all()
    for _ in range(30):
        a, b = sorted(rng.integers(0, 3001, 2).tolist())
        assert (reader.read(a, b) == ids[a:b]).all()
    found, valid, starts = reader.documents(1, 3)
    assert found.tolist() == [0, 0, 500] and valid.tolist() == [0, 1, 1] and starts.tolist() == [500, 1000, 1500, 2000]
    with pytest.raises(ValueError, match="whole file"):
        token_files.Reader(Bytes(sink.getvalue()[:-1]))


def test_token_encoder_equals_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.TOKENIZER)
    tokenizer, encode, rng = Tokenizer.from_file(path), token_files.Encoder(path), random.Random(2)
    letters = ["a", "b'", "'s", "it's", " ", "  ", "\n", "\n\n", "\t", "12", "!?", ",", "é", "ª", "日本", "\x1c", "\x85", "\xa0", " ", "​", "<|endoftext|>", "<|", "́", " '", "\r\n", "x" * 100]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(3000)]
    for text, ids in zip([*texts, None], encode([*texts, None]), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = [*awkward(rng), "x y <|endoftext|> z", (None, "no id"), (None, None), (3, "b"), (3, "b"), (3, "a"), (-5, "first"), *[prose(rng, 900) for _ in range(40)]]
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    docs = table(spark, texts).repartition(5)
    token_files.write_ids(docs, str(tmp_path / "ids"), block=64)
    (tmp_path / "ids" / "000000-lost-attempt.ids").write_bytes(b"half a file")  # what a lost task leaves is not read
    got = sorted((tuple(r) for r in token_files.read_ids(spark, str(tmp_path / "ids")).collect()), key=lambda r: r[1])
    assert len(got) == len(rows) and [r[0] for r in got] == [None, None, *sorted(i for i, _ in rows if i is not None)]
    at = 0
    for _, start, n, ids in got:
        assert start == at and len(ids) == 4 * n
        at += n
    expected = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    assert Counter((i, tuple(np.frombuffer(ids, "<u4").tolist())) for i, _, _, ids in got) == expected
    assert spark.read.parquet(str(tmp_path / "ids" / "manifest")).agg(F.countDistinct("name")).first()[0] >= 1
    token_files.write_ids(empty(spark), str(tmp_path / "none"))
    assert token_files.read_ids(spark, str(tmp_path / "none")).count() == 0
