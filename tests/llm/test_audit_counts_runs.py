"""Filter interaction audit, token counts and periodic runs against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trailweave.llm import filter_audit, periodic, queries, token_counts

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
WORDS = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string"
CLASH = ["body", "own0", "id", "part", "hash", "mask", "N", "good", "toxic", "first", "w", "h", "g", "a", "p", "top", "a.b", "Runs", "n_words", "n_tokens"]


def corpus():
    rnd = random.Random(11)
    word = lambda k: rnd.choice(["the", "of", "Über", "中文", "x" * 17, "x" * 16 + "y", "x" * 40, "x" * 39 + "y", *[f"w{i}" for i in range(k)]])
    prose = lambda n, k=400: " ".join(word(k) for _ in range(n))
    texts = [None, "", " \n\t", "one", prose(150), prose(150, 3), prose(30).upper(), prose(120).upper() + " # ", "#", "aaaa" * 50, "ab " * 3000, "é à" * 40, "x" * 3000, "<|endoftext|> a <|endoftext|>", "  two  spaces \r\n\t", "\x00\x85 z", prose(4000)]
    texts += [prose(rnd.randint(80, 130), rnd.choice([3, 40, 900])) for _ in range(25)]
    rows = [(i, t, rnd.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(i, rows[i % 12][1], rnd.choice(["en", "de"])) for i in range(100, 130)]  # copies
    return [*rows, (100, rows[4][1], "en"), (100, rows[4][1], "en"), (3, "one", "fr"), (None, "one", "en"), (None, None, None), (None, rows[4][1], "en")]


LABELS = [(i, i % 2, (i // 2) % 2) for i in range(0, 140, 3)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (6, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


def audit_brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    judged = []
    for i, t, lang in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        judged.append((lang or "", fails, i in good, i in toxic))
    want, shapley = {}, defaultdict(int)
    for order in map("".join, itertools.permutations("ABCDE")):
        for part, fails, is_good, is_toxic in judged:
            gone = False
            for step, letter in enumerate(order, 1):
                x = want.setdefault((part, order, step), [0] * 6)
                now = fails[letter] and not gone
                x[2] += fails[letter] and gone
                gone = gone or now
                x[0] += not gone
                x[1] += now
                x[3] += fails[letter] and sum(fails.values()) == 1
                x[4] += now and is_good
                x[5] += now and is_toxic
                shapley[part, letter] += now
    return {(part, order, step): (*x, shapley[part, order[step - 1]]) for (part, order, step), x in want.items()}


def test_filter_audit(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    made = filter_audit.audit(docs.withColumns({c: F.lit("mine") for c in CLASH}), labels.withColumns({c: F.lit("mine") for c in ("id", "good", "n", "extra")}))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in made.collect()}
    assert got == audit_brute(corpus(), LABELS) and made.count() == len(got)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {r.kept for r in filter_audit.audit(docs, labels.limit(0), {"A": "n_words < 100"}).where("step = 2 and part = 'fr'").collect()} == {0}


def test_transducer(spark, docs):
    rows = filter_audit.measure(docs.withColumn("key", F.struct("doc_id", "text")).withColumn("a.b", F.lit(1))).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        t = r.key.text or ""
        w = WORDS.findall(t)
        assert (r.n_words, r.n_distinct, r.n_capitals, r.n_points, r.n_symbols) == (len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#$%&*|]", t)))


def test_token_counts(spark, docs):
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(2)
    alphabets = ["ab", "aAbBzZ09 '", "etaoin shrdlu", "".join(map(chr, range(32, 127))), "é中🙂  \n\t\r  x'", "<|endoftext|> "]
    texts = ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 120))) for a in alphabets for _ in range(150)] + ["ab" * 4000, "".join(rnd.choice("abcdefgh") for _ in range(20000)), "a" * 511, "a b" * 256, " a" * 512, " a" * 513]
    more = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)
    odd = docs.unionByName(more).withColumn("key", F.col("text")).withColumns({"a.b": F.lit(1), "N_Tokens": F.lit(5), "body": F.lit(2)})
    rows = token_counts.count_tokens(odd, P.path("byte_bpe_50k.json")).collect()
    assert len(rows) == len(corpus()) + len(texts)
    for r in rows:
        t = r.key or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512), t[:50]
    assert token_counts.count_tokens(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def runs_brute(w, least=6, repeats=4):
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, repeats * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    runs = sorted((s, q, n) for (s, n), q in found.items())
    gone = {t for s, q, n in runs for t in range(s + q, s + n)}
    return [(s, n, q) for s, q, n in runs], " ".join(x for t, x in enumerate(w) if t not in gone)


def periodic_texts():
    rnd = random.Random(13)
    texts = [None, "", "a", "a " * 6, "a " * 5, "a b " * 4, "a b " * 3 + "a", "a\n" * 3000, "x y z " * 700 + "x", "a a a a a a b " * 5]
    for _ in range(150):
        w = [rnd.choice("abcdefg"[: rnd.choice([1, 2, 3, 7])]) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            p = [rnd.choice("abcxy") for _ in range(rnd.randint(1, 6))]
            at = rnd.randint(0, len(w))
            w[at:at] = (p * 9)[: rnd.randint(1, 50)]
        texts.append(rnd.choice([" ", "\n", " \t "]).join(w))
    return texts


@pytest.mark.parametrize("least,repeats", [(6, 4), (10, 5), (3, 3)])
def test_periodic_runs(spark, least, repeats):
    rows = [(i, t) for i, t in enumerate(periodic_texts())] + [(5, "a b " * 9), (None, "a b " * 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.col("text")).withColumns({"own0": F.lit(1), "Collapsed": F.lit(2), "a.b": F.lit(3), "body": F.lit(4)}).repartition(3)
    got = periodic.periodic_runs(frame, min_length=least, repeats=repeats).collect()
    assert len(got) == len(rows)
    for r in got:
        runs, left = runs_brute(WORDS.findall(r.key or ""), least, repeats)
        assert ([tuple(x) for x in r.runs], r.collapsed, r["a.b"]) == (runs, left, 3)
    assert periodic.periodic_runs(frame.limit(0)).count() == 0


def test_periodic_query(spark, tmp_path):
    rows = [(i * 37, t) for i, t in enumerate(periodic_texts() + [" ".join(f"w{(k * k) % 91}" for k in range(n)) for n in range(1, 300, 3)])] + [(None, "a b " * 9), (7, None), (-7, "x y " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, changed = [], 0
    for i, t in rows:
        w = WORDS.findall(t or "")
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
            changed += 1
        runs, left = runs_brute(w)
        s, n, q = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.append((i, len(runs), s, n, q, None if s is None else 1000 * n // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, f"file://{tmp_path}").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and changed > 15
