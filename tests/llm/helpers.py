"""Fixtures for the operators of quire.llm: awkward documents, and brute-force references."""
import random
import re

WORDS = re.compile("[^\x20\x09-\x0d]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """(doc_id, text) or (doc_id, text, source) rows as a documents table."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else 0) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def awkward(seed=1):
    """Nulls, empty texts, blank texts, one word, repeated rows, a very long text, odd characters."""
    r = random.Random(seed)
    long_text = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(500)) for _ in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "word", None), (5, "same text of some words here", "b"),
            (5, "same text of some words here", "b"), (6, "same text of some words here", "b"), (7, long_text, "b"),
            (8, "é ß 日本語 😀 \x00 ▁▁ x", "c"), (None, "no id at all but words and words", "c"), (None, None, None),
            (9, "line one is here\nline one is here\n\nline one is hers\r\nend of the text", "a")]
    return rows + [(10 + i, " ".join(r.choice("red green blue black white grey".split()) for _ in range(12)), f"s{i % 3}")
                   for i in range(20)]


def crowded(df):
    """The same table with extra columns whose names operators might use inside."""
    from pyspark.sql import functions as F
    out = df
    for name in ("size", "taken", "line", "pos", "key", "rep", "shard", "a", "b", "words", "chunk", "_n", "_h", "toxic"):
        out = out.withColumn(name, F.lit(f"extra {name}"))
    return out


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def shingle_set(text, k=5):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(a, b):
    """Edit distance of at most 1."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]
