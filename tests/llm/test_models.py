"""The language model and the toxicity chain: exact parts by brute force, the rest held out."""
import math
import random
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pytest

from quire.llm import lm_score, toxicity
from quire.session import ensure_checkpoint_dir

from .helpers import WORDS, awkward, crowded, documents, empty


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_base(rows, got):
    count = Counter()
    for d, t in rows:
        if not held(d):
            count.update([*words(t), "</end>"])
    total, known = sum(count.values()), len(count)
    want = []
    for d, t in rows:
        w = [*words(t), "</end>"]
        base = sum(math.log10((count[x] + 1) / (total + known + 1)) for x in w)
        want.append((d or -1, held(d), len(w), sum(count[x] > 0 for x in w), total, round(base, 6)))
    assert sorted((x.doc_id or -1, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6))
                  for x in got) == sorted(want)


def test_base_scores_are_exact_on_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    got = lm_score.score_texts(crowded(documents(spark, rows))).collect()
    check_base(rows, got)
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)
    assert lm_score.score_texts(empty(spark)).count() == 0


def test_model_beats_the_base_on_held_out_texts(spark):
    r = random.Random(8)
    tongues = [["".join(r.choice(a) for _ in range(r.randint(2, 6))) + e for _ in range(800)]
               for a, e in (("abcd", "x"), ("efgh", "y"), ("ijkl", "é"))]
    rows = []
    for i in range(500):
        t = tongues[i % 3]
        rows.append((i, " ".join(t[min(int(r.paretovariate(0.6)), len(t)) - 1] for _ in range(60))))
    got = lm_score.score_texts(documents(spark, rows)).collect()
    check_base(rows, got)
    out = [x for x in got if x.held_out]
    assert len(out) > 40
    assert sum(x.score for x in out) > sum(x.base_score for x in out) * 0.95     # 5% better at least
    again = lm_score.score_texts(documents(spark, rows).repartition(5)).collect()
    assert {x.doc_id: round(x.score, 6) for x in again} == {x.doc_id: round(x.score, 6) for x in got}


def test_stirling_and_table_draws():
    d = 0.4
    s = lm_score.log_stirling(d, 8)
    assert s[1, 1] == pytest.approx(0) and s[3, 3] == pytest.approx(0)
    assert math.exp(s[3, 1]) == pytest.approx((1 - d) * (2 - d))
    assert math.exp(s[3, 2]) == pytest.approx((1 - d) + (2 - 2 * d))
    # the draw follows the exact conditional
    n, c, p, others, strength = 40_000, 5, 0.03, 7, 1.0
    rng = np.random.default_rng(0)
    t = lm_score.draw_tables(rng, np.full(n, c), np.full(n, math.log(p)), np.full(n, others), d, strength,
                             lm_score.log_stirling(d))
    w = np.array([math.exp(s[c, k]) * p ** k * np.prod([strength + d * (others + j) for j in range(k)])
                  for k in range(1, c + 1)])
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - w / w.sum()).max() < 0.01
    big = lm_score.draw_tables(rng, np.array([0, 1, 64, 100_000]), np.log(np.full(4, 0.01)), np.zeros(4), d, strength,
                               lm_score.log_stirling(d))
    assert big[0] == 0 and big[1] == 1 and 1 <= big[2] <= 64 and 1 <= big[3] <= 100_000


def test_predictions_sum_to_one():
    """Over all known words and the unknown one, in every context and after every round."""
    r = np.random.default_rng(4)
    n_words, contexts = 60, np.arange(1, 6)
    word = np.repeat(np.arange(1, n_words + 1, dtype=np.uint64), len(contexts))
    ctx = np.tile(contexts, n_words).astype(np.uint16)
    n = (r.pareto(0.7, len(word)) * (r.random(len(word)) < 0.6)).astype(np.int64)
    n[::len(contexts)] += 1                                     # every word is known
    customers = np.bincount(ctx, n, minlength=1 << 16).astype(np.int64)
    model = {"customers": customers, "known": n_words, "d0": 0.6, "d1": 0.5,
             "s0": lm_score.log_stirling(0.6), "s1": lm_score.log_stirling(0.5)}
    b = lm_score.Block(0, word, ctx, n, model)
    for number in range(4):
        k = {"tables": np.bincount(ctx, b.t, minlength=1 << 16).astype(np.int64), "c0": int(b.c0.sum()),
             "t0": int(b.t0.sum())}
        p = b.predict(k)
        unknown = (lm_score.STRENGTH + model["d0"] * k["t0"]) / (n_words + 1) / (k["c0"] + lm_score.STRENGTH)
        for c in contexts:
            back = (lm_score.STRENGTH + model["d1"] * k["tables"][c]) / (customers[c] + lm_score.STRENGTH)
            assert p[ctx == c].sum() + back * unknown == pytest.approx(1, abs=1e-9)
        assert (b.t >= np.minimum(n, 1)).all() and (b.t <= n).all()
        b.sweep(number, k)


def test_the_previous_word_is_the_context(spark):
    """Words that share a last character are different contexts: only the word before says what follows."""
    r = random.Random(5)
    firsts, seconds = [f"w{i}x" for i in range(40)], [f"s{i}" for i in range(40)]
    rows = []
    for i in range(400):
        picks = [r.randrange(40) for _ in range(30)]
        rows.append((i, " ".join(f"{firsts[p]} {seconds[p]}" for p in picks)))
    rows += [(1000, "w3x s3"), (1001, "w3x s4")]
    got = {x.doc_id: x for x in lm_score.score_texts(documents(spark, rows)).collect()}
    check_base(rows, list(got.values()))
    assert got[1000].score > got[1001].score + 1            # ten times as likely at least


def test_word_predictions_sum_to_one():
    """Over all known words and the unknown one, after every word and after every round."""
    r = np.random.default_rng(3)
    n_words, prevs = 40, np.arange(1, 13, dtype=np.uint64)
    word = np.repeat(np.arange(1, n_words + 1, dtype=np.uint64), len(prevs))
    prev = np.tile(prevs, n_words)
    ctx = (prev % 4).astype(np.uint16)
    n = (r.pareto(0.7, len(word)) * (r.random(len(word)) < 0.4)).astype(np.int64)
    n[::len(prevs)] += 1
    seen = np.bincount(prev.astype(np.int64) - 1, n, minlength=n_words).astype(np.int64)
    model = {"vocab": np.arange(1, n_words + 1, dtype=np.uint64), "seen": np.append(seen, [0, 0]), "known": n_words,
             "d0": 0.6, "d1": 0.5, "d2": 0.7} | {f"s{i}": lm_score.log_stirling(d) for i, d in enumerate((0.6, 0.5, 0.7))}
    b = lm_score.Words(0, word, prev, ctx, n, model)
    for number in range(4):
        k = lm_score._state({x: (np.asarray(at, np.uint64), np.asarray(v).astype(np.int64)) for x, (at, v)
                             in b.totals().items()}, n_words)
        p = b.predict(k)
        unknown = (lm_score.STRENGTH + 0.6 * k["t0"]) / (n_words + 1) / (k["c0"] + lm_score.STRENGTH)
        for v in prevs:
            c = int(v % 4)
            up = (lm_score.STRENGTH + 0.5 * k["tables"][c]) / (k["customers"][c] + lm_score.STRENGTH)
            back = (lm_score.STRENGTH + 0.7 * k["seats"][v - 1]) / (seen[v - 1] + lm_score.STRENGTH)
            assert p[prev == v].sum() + back * up * unknown == pytest.approx(1, abs=1e-9)
        assert (b.above.n == np.bincount(b.pair, b.t)).all() and (b.t >= np.minimum(n, 1)).all() and (b.t <= n).all()
        b.sweep(number, k)


def zipf_texts(seed, docs, words, pool):
    r = random.Random(seed)
    names = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 8))) for _ in range(pool)]
    return [(i, " ".join(names[int(pool * r.random() ** 4)] for _ in range(words))) for i in range(docs)]


def test_tables_between_the_steps_are_smaller_than_the_texts(spark):
    rows = zipf_texts(2, 400, 400, 9000)
    scratch = Path(unquote(urlparse(ensure_checkpoint_dir(spark)).path)) / "scratch"
    size = lambda: sum(p.stat().st_size for p in scratch.glob("lm-*/**/*.parquet"))
    before = size()
    got = lm_score.score_texts(documents(spark, rows).repartition(3)).collect()
    check_base(rows, got)
    moved = (size() - before) / sum(len(t) for _, t in rows)
    assert 0 < moved < 1


def test_scores_are_those_of_one_process(spark):
    """Sampled over plain dictionaries of hashes: neither chunks nor packing nor numbering change a score."""
    rows = zipf_texts(6, 150, 80, 400) + [(900, None), (901, ""), (902, "nie gesehen é"), (911, "nie gesehen à b")]
    toks = {d: lm_score.tokens(t or "") for d, t in rows}
    count, pairs, seen = Counter(), Counter(), Counter()
    for d, (h, v, c) in toks.items():
        for w, p, x in zip(h.tolist(), v.tolist(), c.tolist()):
            pairs[w, p, x] += not held(d)
            count[w] += not held(d)
            seen[p] += not held(d)
    vocab = sorted(w for w in count if count[w])
    number = {w: i for i, w in enumerate(vocab)}
    code = lambda p, x: 0 if p == 0 else number[p] + 1 if p in number else len(vocab) + 1 + x
    by2, by1, by0 = Counter(), Counter(), Counter()
    for (w, p, x), n in pairs.items():
        if n:
            by2[n] += 1
            by1[w, x] += 1
    for w, _ in by1:
        by0[w] += 1
    found = [Counter(by0.values()), Counter(by1.values()), by2]
    model = {"known": len(vocab), "seen": np.array([*(seen[w] for w in vocab), 0, seen[0]])}
    for i, f in enumerate(found):
        model[f"d{i}"] = lm_score._discount(f[1], f[2])
        model[f"s{i}"] = lm_score.log_stirling(model[f"d{i}"])
    blocks = []
    for number_of in range(16):
        e = sorted((w, p, x) for w, p, x in pairs if w >> 60 == number_of)
        if e:
            w, p, x = (np.array(v) for v in zip(*((number.get(w, len(vocab)), code(p, x), x) for w, p, x in e)))
            order = np.lexsort((p, w))
            n = np.array([pairs[k] for k in e])
            blocks.append(([e[i] for i in order], lm_score.Words(number_of, w[order], p[order], x[order], n[order], model)))
    prob = Counter()
    for number_of in range(5):
        k = {"seats": np.zeros(len(vocab) + 2), "customers": np.zeros(1 << 16), "tables": np.zeros(1 << 16), "c0": 0, "t0": 0}
        for _, b in blocks:
            np.add.at(k["seats"], b.at, b.t)
            np.add.at(k["customers"], b.above.ctx, b.above.n)
            np.add.at(k["tables"], b.above.ctx, b.above.t)
            k["c0"] += b.above.c0.sum()
            k["t0"] += b.above.t0.sum()
        for e, b in blocks:
            if number_of > lm_score.BURN_IN:
                for key, v in zip(e, b.predict(k)):
                    prob[key] += v / lm_score.SAMPLES
            if number_of < 4:
                b.sweep(number_of, k)
    want = {d: sum(math.log10(prob[x]) for x in zip(*(v.tolist() for v in t))) for d, t in toks.items()}
    got = {x.doc_id: x.score for x in lm_score.score_texts(documents(spark, rows).repartition(4)).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_entries_are_packed_and_found_again(monkeypatch):
    r = np.random.default_rng(1)
    for top in (1, 200, 70_000, 1 << 40):
        v = r.integers(0, top, 500)
        assert (lm_score._loose(lm_score._squeeze(v)) == v).all()
    assert len(lm_score._loose(lm_score._squeeze(np.zeros(0, np.int64)))) == 0
    rows = [(i, i % 7 == 2, t) for i, (_, t) in enumerate(zipf_texts(4, 30, 60, 300))]
    hashes = np.unique(np.concatenate([lm_score.tokens(t)[0] for _, h, t in rows if not h]))
    args = sorted(rows, key=lambda x: x[1]), hashes, np.ones(len(hashes), np.uint8), 4, 1800
    short = list(lm_score._chunk(*args))
    monkeypatch.setattr(lm_score, "KEY_BITS", 0)            # sorted by three columns instead of one number
    assert short == list(lm_score._chunk(*args))
    for row in short[1:]:
        word, prev = lm_score._unpack(row)
        assert lm_score._pack(word, prev) == {k: row[k] for k in ("word", "run", "prev")}
        assert len({*zip(word.tolist(), prev.tolist())}) == len(word)
    assert sum(len(lm_score._loose(row["doc"])) for row in short[1:]) == sum(len(t.split()) + 1 for _, _, t in rows)


def toxic_rows(r, n, first=0):
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for i in range(first, first + n):
        w = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        low, toxic = r.random() < 0.2, r.random() < 0.25
        if low:
            w += ["zzz"] * r.randint(2, 9)
        if toxic:
            for _ in range(r.randint(2, 5)):
                w[r.randrange(len(w))] = r.choice(["Idiot,", "scum.", "moron", "trash!"])
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if low else 1, int(toxic)))
    return rows, labels


def test_chain_finds_toxic_texts_it_has_not_seen(spark):
    r = random.Random(6)
    rows, labels = toxic_rows(r, 900)
    lab = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    model = toxicity.train(docs, lab, max_docs=500)
    got = {x.doc_id: x for x in toxicity.classify(docs, model).collect()}
    new = [(got[i].toxic, t == 1, got[i].low_quality, q == 0) for i, q, t in labels[600:]]
    assert sum(a == b for a, b, _, _ in new) / len(new) > 0.98
    assert sum(a == b for _, _, a, b in new) / len(new) > 0.95
    assert all(0 <= got[i].toxic_prob <= 1 for i in got)


def test_chain_uses_the_earlier_category():
    """The second label equals the first, which two models of half the signal each must carry over."""
    r = random.Random(2)
    rows, _ = toxic_rows(r, 300)
    y = np.array([[int("zzz" in t), int("zzz" in t)] for _, t in rows])
    c = toxicity.Chain([t for _, t in rows], y, ["first", "second"])
    assert c.models[1].dense.shape == (1,) and c.models[1].dense[0] > 0


def test_chain_awkward_rows(spark):
    rows = awkward()
    docs = crowded(documents(spark, rows))
    lab = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 0, 1), (6, None, None), (None, 0, 1), (7, 1, 0), (10, 1, 1)],
                                "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, toxicity.train(docs, lab))
    assert got.columns.count("toxic") == 1 and dict(got.dtypes)["toxic"] == "boolean"
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= x.toxic_prob <= 1 and x.key == "extra key" for x in out)
    none = toxicity.train(docs, lab.limit(0))
    assert not any(x.toxic or x.low_quality for x in toxicity.classify(docs, none).collect())
    assert toxicity.classify(empty(spark), none).count() == 0


def test_threshold_keeps_equal_outputs_together():
    z, y = np.array([2.0, 1.0, 1.0, 1.0, 0.0, 0.0]), np.array([1.0, 1.0, 1.0, 0.0, 0.0, 0.0])
    cut = toxicity.best_threshold(z, y)
    assert 0 < cut < 1          # a cut at 1.0 itself would lose all that are there
    assert toxicity.best_threshold(np.zeros(4), np.array([1.0, 0, 0, 0])) < 0


def test_long_texts_bring_all_their_words_to_the_fit(spark):
    # what tells the classes apart comes after 5,000 other words of a text
    filler = " ".join("".join(chr(97 + int(c)) for c in f"{i:05d}") for i in range(5000))
    rows = [(i, f"{filler} {'vile' if i % 2 else 'fine'} zz{'ab'[i % 2]}") for i in range(24)]
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(24)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    model = toxicity.train(docs, lab)
    assert len(model.vocab) == 5000 + 4
    got = {r.doc_id: r.toxic for r in toxicity.classify(docs, model).collect()}
    assert got == {i: bool(i % 2) for i in range(24)}
