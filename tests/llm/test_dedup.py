"""Line dedup and MinHash near-dedup against brute force."""
import hashlib
import random

from quire.llm import line_dedup, minhash_dedup
from quire.llm.common import connected_components

from .helpers import awkward, components, crowded, documents, empty, near, shingle_set


def lines_reference(rows, min_chars=line_dedup.MIN_CHARS):
    """Kept lines of each document; ids are unique here. Null ids come last."""
    seen, out = [], {}
    for doc_id, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out[doc_id, text] = None
            continue
        kept = []
        for line in text.split("\n"):
            if len(line) < min_chars:
                kept.append(line)
            else:
                if not any(near(line, s) for s in seen):
                    kept.append(line)
                seen.append(line)
        out[doc_id, text] = "\n".join(kept)
    return out


def edited(r, line):
    p = r.randrange(len(line))
    return r.choice([line[:p] + line[p + 1:], line[:p] + r.choice("abcé") + line[p:],
                     line[:p] + r.choice("xyzß") + line[p + 1:], line + "!", line[1:], line])


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcde é") for _ in range(n)) for n in (10, 11, 12, 30, 31, 127, 128, 129, 200, 255, 256, 257, 700)]
    rows = []
    for i in range(60):
        lines = [r.choice([edited(r, b), edited(r, edited(r, b)), b, "", "short"]) for b in r.choices(base, k=6)]
        rows.append((i, "\n".join(lines)))
    got = {(x.doc_id): x.text for x in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    want = {k[0]: v for k, v in lines_reference(rows).items()}
    assert got == want
    assert any(len(want[i]) < len(t) for i, t in rows)


def test_line_dedup_repeats_in_one_line_text(spark):
    # "aab...": several deletions give the same variant; ties between places in one document
    rows = [(1, "aaaaaaaaaaaa\naaaaaaaaaaa\naaaaaaaaaab"), (2, "aaaaaaaaaaaaa\nbaaaaaaaaaaa")]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {k[0]: v for k, v in lines_reference(rows).items()}


def test_line_dedup_edge_cases(spark):
    rows = awkward()
    got = line_dedup.dedup_lines(crowded(documents(spark, rows)))
    assert {"text", "n_lines", "n_kept", "size", "line"} <= set(got.columns)
    out = got.collect()
    assert len(out) == len(rows)
    want = lines_reference(rows)
    by_id = {k[0]: v for k, v in want.items() if k[0] is not None}
    assert all(x.text == by_id[x.doc_id] for x in out if x.doc_id is not None)
    assert all(x.line == "extra line" for x in out)
    null = next(x for x in out if x.doc_id == 1)
    assert null.text is None and (null.n_lines, null.n_kept) == (0, 0)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_short_lines_take_part(spark):
    rows = [(1, "And.\n\n前言\nx\n}"), (2, "前言\nAnd.\n\nOther"), (3, "Other\nAnt.\nxy\nfar"), (4, "é\n序言\n附录一\nAn.")]
    exact = {x.doc_id: x.text for x in line_dedup.dedup_lines(documents(spark, rows), bound=0).collect()}
    assert exact == {1: "And.\n\n前言\nx\n}", 2: "\nOther", 3: "Ant.\nxy\nfar", 4: "é\n序言\n附录一\nAn."}
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: "And.\n\n前言\nx", 2: "\nOther", 3: "far", 4: "附录一"}
    r = random.Random(4)
    rows = [(i, "\n".join("".join(r.choice("ab前") for _ in range(r.randint(0, 9))) for _ in range(8))) for i in range(30)]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {k[0]: v for k, v in lines_reference(rows, 1).items()}


def test_line_dedup_bound_zero_and_many_near_lines(spark):
    rows = [(i, f"a common line of text with number {i:04d} in it") for i in range(300)]
    exact = line_dedup.dedup_lines(documents(spark, rows + rows[:50]), bound=0).where("n_kept > 0")
    assert exact.count() == 350          # repeated rows are one document and are cut alike
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {k[0]: v for k, v in lines_reference(rows).items()}


def near_reference(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {d: len(s) for d, s in sets.items()}, components(ids, links)


def varied(r, text, share):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_minhash_equals_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        text = " ".join(r.choice(vocab) for _ in range(r.choice([3, 6, 40, 120, 400])))
        for _ in range(r.choice([1, 2, 8])):
            rows.append((n, r.choice([text, text.upper(), text.replace(" ", "\t ")])
                         if r.random() < 0.3 else varied(r, text, r.choice([0.01, 0.02, 0.04, 0.06]))))
            n += 1
    # many documents that share one passage but are not near copies
    passage = " ".join(r.choice(vocab) for _ in range(60))
    for _ in range(80):
        rows.append((n, passage + " " + " ".join(f"own{r.randrange(10**6)}" for _ in range(40))))
        n += 1
    # a chain: each is near the next, the ends are far apart
    w = [f"c{i}" for i in range(300)]
    for step in range(6):
        rows.append((n, " ".join(w[step * 8:step * 8 + 200])))
        n += 1
    sizes, comp = near_reference(rows)
    got = {x.doc_id: x for x in minhash_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert {d: x.n_shingles for d, x in got.items()} == sizes
    assert {d: x.component_id for d, x in got.items()} == comp
    assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())
    assert len(set(comp.values())) < len(rows) - 20


def test_minhash_edge_cases(spark):
    rows = awkward()
    out = minhash_dedup.near_duplicates(crowded(documents(spark, rows))).collect()
    assert len(out) == len(rows)
    by = {}
    for x in out:
        by.setdefault(x.doc_id, []).append(x)
    assert [x.component_id for x in by[5]] == [5, 5] and by[6][0].component_id == 5 and not by[6][0].kept
    assert all(by[d][0].n_shingles == 0 and by[d][0].kept and by[d][0].component_id == d for d in (1, 2, 3))
    assert all(x.kept for x in by[None])
    assert by[4][0].n_shingles == 1
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_minhash_hot_groups(spark):
    """Thousands of exact copies and hundreds of near copies end in one component each."""
    r = random.Random(9)
    a = " ".join(f"x{r.randrange(200)}" for _ in range(100))
    b = " ".join(f"y{r.randrange(200)}" for _ in range(200))
    rows = [(i, a) for i in range(1500)] + [(2000 + i, varied(r, b, 0.005)) for i in range(400)]
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert {got[i] for i in range(1500)} == {0}
    assert got == near_reference(rows)[1]


def test_components_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 999), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[999] == got[1000] == 999


def test_sketch_agreement_matches_similarity():
    import numpy as np
    r = np.random.default_rng(2)
    for n in (8, 100, 1500):
        agree, true = [], 0
        for _ in range(60):
            u = np.unique(r.integers(0, 2**63, 2 * n, dtype=np.uint64))
            k = int(n * 0.75)
            a, b = np.sort(u[:n]), np.sort(np.concatenate((u[:k], u[n:2 * n - k])))
            true = k / (2 * n - k)
            agree.append((minhash_dedup.sketch(a) == minhash_dedup.sketch(b)).mean())
        assert abs(np.mean(agree) - true) < 0.03, n


def test_op1_digest_columns(spark):
    import __spark_entry__ as E
    out = E.queries()["op1_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {k[0]: v or "" for k, v in lines_reference(rows).items()}
    assert {x.doc_id: x.text_sha256 for x in out} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
