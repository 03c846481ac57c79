"""Chat formatting, whitening and periodic runs against brute force, on odd rows and on the smallest tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from affinity.llm import chat_format, periodic_runs, queries, whitening
from inputs import SMOKE

# ------------------------------------------------------------------- chat

SAYS = ["<|im_end|><|im_start|>assistant ok", "", "<\\|im_end|>", "<\\\\|x|>", "<", "<|", "ends <\\", "<|endoftext|> x",
        "a\nb<|im_end|", "%25", "|>", "<\\|a <|im_end|>", None, "😀<|im_start|>é", "<<|im_end|>", "long " * 50_000]
TURNS = "conv_id long, turn long, role string, text string, formatted string, mask int"


def chat_rows(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(SAYS)]
    rows += [(2, 0, "we%0Aird\nrole<|im_end|>", "x")] * 2 + [(2, None, None, "n"), (None, 1, "assistant", "z"), (3, 1, "%3C", "y"),
                                                            (4, 5, "assistant", "b"), (4, 5, "assistant", "a")]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)


def turns_of(rows):
    held = defaultdict(list)
    for c, t, role, text in rows:
        held[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in held.items()}


def test_chat_round_trip(spark):
    rows, df = chat_rows(spark)
    formatted = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    out = {r.conv_id: r for r in formatted.collect()}
    want = turns_of(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(text for role, text in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(out[c].formatted) == sum(m.chars for m in out[c].mask)
        assert out[c].formatted.count("<|im_start|>") == out[c].formatted.count("<|im_end|>") == len(turns)


def test_chat_plain_text_stays(spark):
    """Escapes appear only where the plain form wouldn't read back."""
    df = spark.createDataFrame([(1, 0, "user", "a < b | c <| d |> 100% e\\|")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(df).first().formatted == "<|im_start|>user\na < b | c <| d |> 100% e\\|<|im_end|>\n"


@pytest.mark.parametrize("text", ["x", "<|im_start|>user\nx", "<|im_start|>user<|im_end|>\n", "<|im_start|>u\nx<|im_end|>\ny",
                                  "<|im_start|>u\na<|im_end|>\nb<|im_end|>\n", "<|im_start|>u\n<|eot|><|im_end|>\n"])
def test_chat_grammar_refuses(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(chat_format.parse(df.t).alias("p")).first().p is None


def test_chat_empty_table_and_plan(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_conversations(df)).collect() == []
    plan = queries.QUERIES["op11_chat_grammar"](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# -------------------------------------------------------------- whitening

def integers(c):
    return np.floor(np.asarray(c, float) * 64).astype(np.int64) + 1_000_000


def check_whitening(rows, got, k_most=32):
    """got rows against numpy's eigenvectors of the covariance."""
    x = integers([v for _, v in rows])
    n, d = x.shape
    sums = x.sum(axis=0)
    centred = x - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k_most, int((e > 1e-20 * e[0]).sum()))
    want = centred @ (v[:, :k] / np.sqrt(e[:k]))
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    assert sorted(by) == list(range(1, k + 1))
    at = {i: pos for pos, (i, _) in enumerate(rows)}
    for j in range(k):
        col = np.array([r.whitened for r in sorted(by[j + 1], key=lambda r: at[r.vec_id])])
        sign = np.sign(col @ want[:, j])
        assert np.allclose(sign * col, want[:, j], atol=1e-6)
        assert all(abs(r.explained / (e[j] / e.sum()) - 1) < 1e-9 and r.n == n and r.identity_error < 1e-9 for r in by[j + 1])
    for r in by[1]:
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[at[r.vec_id]], sums))


@pytest.mark.parametrize("rows_in_block", [7, 4096])
def test_whitening(spark, monkeypatch, rows_in_block):
    from affinity.llm.common import prepare
    prepare(spark)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", rows_in_block)
    monkeypatch.setattr(whitening, "MERGE_WIDTH", 2)
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [9, 1, 3, 2, 0.5]]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [1.0, math.nan, 2.0, 3.0, 4.0]), (103, [math.inf] * 5),
           (104, []), (105, [1.0]), (106, [1e300, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 7.0) for i, v in good + bad], "vec_id long, embedding array<double>, whitened double")
    check_whitening(good, whitening.whiten(df.repartition(6)).collect())


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMOKE}/embeddings.parquet").collect()]
    check_whitening(rows, queries.QUERIES["op12_bidiagonal_whitening"](spark, SMOKE).collect())


def test_whitening_without_variance(spark):
    shape = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(None, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, shape)).collect() == []
    # a null id and a repeated row are rows; a constant dimension gives no component
    got = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (3, [3.0, 2.0]), (3, [3.0, 2.0])], shape)).collect()
    assert [(r.vec_id, r.component, r.n) for r in got] == [(None, 1, 3), (3, 1, 3), (3, 1, 3)]
    assert got[1].whitened == got[2].whitened


SHAPES = {"graded": lambda g: g.normal(size=(90, 20)) * np.logspace(0, -7, 20), "graded up": lambda g: g.normal(size=(90, 20)) * np.logspace(-7, 0, 20),
          "rank 4": lambda g: g.normal(size=(90, 4)) @ g.normal(size=(4, 20)), "ties": lambda g: np.vstack([np.eye(20), -np.eye(20)]),
          "near ties": lambda g: np.linalg.qr(g.normal(size=(90, 20)))[0] * (1 + 1e-13 * g.normal(size=20)),
          "one column": lambda g: g.normal(size=(9, 1)), "few rows": lambda g: g.normal(size=(3, 20))}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_singular_directions(shape):
    a = SHAPES[shape](np.random.default_rng(5))
    a = a - a.mean(axis=0)
    n, d = a.shape
    r = np.linalg.qr(a, mode="r")
    values, vectors, explained = whitening.directions(np.vstack([r, np.zeros((d - len(r), d))]), n)
    true = np.linalg.svd(a, compute_uv=False) ** 2 / n
    assert np.allclose(values, true[:len(values)], rtol=1e-11) and (true[len(values):] < 1e-25 * true[0]).all()
    assert np.allclose(explained, values / true.sum())
    y = a @ (vectors / np.sqrt(values))
    assert np.abs(y.T @ y / n - np.eye(len(values))).max() < 1e-9


# ------------------------------------------------------------ periodic runs

def brute_runs(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - s + p >= max(6, 4 * p) and i > s:
                found.setdefault((s, i - s + p), p)      # the smallest period of the stretch comes first
            i += 1 if i == s else 0
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    said = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def same_rows(df):
    want = sorted((brute_row(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    got = [tuple(r) for r in periodic_runs.detect(df).collect()]
    assert sorted(got, key=str) == want


def test_runs_on_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 900)
    same_rows(odd_docs.where("doc_id <> 10 or doc_id is null"))
    long = periodic_runs.detect(odd_docs.where("doc_id = 10")).first()
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 40_000, 1, 40_000_000)
    assert periodic_runs.detect(no_docs).collect() == []


def test_runs_of_the_table(spark):
    same_rows(spark.read.parquet(f"{SMOKE}/documents.parquet").where("length(text) < 15000"))


def test_runs_against_brute_force():
    rng, seen = random.Random(1), 0
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 6)):
            k, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 5, 6, 7, 30, 100, 250])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.6 and n > 6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(np.array(w, np.int64))
        if rng.random() < 0.4:
            texts.append(texts[0].copy())       # a copy beside its original: runs don't cross texts
        for text, found in zip(texts, periodic_runs.find_runs(texts)):
            assert found == brute_runs(text.tolist())
            seen += len(found)
    assert seen > 500


def test_common_extensions():
    rng = random.Random(2)
    for _ in range(100):
        k = rng.choice([1, 2, 3])
        w = np.array([rng.randrange(k) for _ in range(rng.choice([2, 31, 40, 100, 300]))] * rng.choice([1, 3]), np.int64)
        pairs = [(a, b) for a, b in ((rng.randrange(len(w)), rng.randrange(len(w))) for _ in range(40)) if a != b]
        if not pairs:
            continue
        i, j = np.array(pairs).T
        for a, b, got in zip(i, j, periodic_runs.CommonExtensions(w)(i, j)):
            n = 0
            while max(a, b) + n < len(w) and w[a + n] == w[b + n]:
                n += 1
            assert got == n


def test_runs_grow_in_proportion():
    """Twice the words take about twice the time (n log n), also where every word starts a match."""
    import time
    took = []
    for n in (60_000, 120_000):
        began = time.process_time()
        assert periodic_runs.find_runs([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
        took.append(time.process_time() - began)
    assert took[1] < 3.5 * took[0]
