"""The corpus pipeline against a brute-force version of its stages."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
WORDS = re.compile("[^\x20\x09-\x0d]+")


def corpus():
    """(rows, ids that the quality rules must reject)."""
    rnd = random.Random(9)
    common = "the of and to in is that it was for".split()
    word = lambda: rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("etaoinshr") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(200)
    good = [prose(rnd.randint(80, 160)) for _ in range(30)] + [prose(50) + " " + passage, passage + "\n" + prose(70), base, base, base + " " + prose(3), prose(3000)]
    bad = [None, "", "too short", prose(100).upper(), prose(100).replace(" ", "$$$ "), "same words again and again here now " * 30]
    texts = [(t, False) for t in good] + [(t, True) for t in bad]
    rnd.shuffle(texts)
    rows = [(i, t, "en", "s", len(t or "")) for i, (t, _) in enumerate(texts)]
    return rows, {i for i, (_, junk) in enumerate(texts) if junk}


def brute(rows, junk):
    docs = {i: t for i, t, *_ in rows if i not in junk}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in docs.items():
        w = WORDS.findall(t.translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    label = {i: i for i in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    docs = {i: t for i, t in docs.items() if label[i] == i}
    first = {}
    for i in sorted(docs):
        w = WORDS.findall(docs[i])
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    cut = {}
    for i, t in docs.items():
        w = WORDS.findall(t)
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        cut[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    return cut


def test_pipeline(spark, tmp_path):
    rows, junk = corpus()
    sf_dir = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    want = brute(rows, junk)
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(want) and len(want) < len(rows) - len(junk)
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, text in want.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(got[i], key=lambda r: r.piece):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([*corpus()[0], (None, None, None, None, None), (None, "the of and to in is " * 30, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = ["n_words", "kept", "row", "own0", "_text", "a.b", "Kept_Text", "component_id", "ids"]
    docs = docs.withColumns({c: F.lit(f"mine {c}") for c in odd})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "")
        assert made.columns == docs.columns
        assert [tuple(r) for r in made.select(*[F.col(f"`{c}`") for c in odd]).distinct().collect()] == [tuple(f"mine {c}" for c in odd)]
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.best_fit_packing(spark, docs, "").columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
