"""The training-data operators against brute force on small, awkward tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailweave.llm import bpe, chat, embed_dedup, licences, minmax, packing, quality, shared, substrings, token_files, tokens, urls

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
WORDS = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, n_words string, component_id int"
#: Columns that internal names of the operators might clash with.
CLASH = ["_text", "_lang", "_doc", "_tkey", "_runs", "_keys", "_left", "_pieces", "_hits", "body", "Own", "doc", "node", "c", "key", "a.b", "Ids", "conv", "vec", "rank", "window"]


def clashing(frame):
    return frame.withColumns({c: F.lit(f"mine {c}") for c in CLASH})


def unharmed(frame, but=()):
    names = [c for c in CLASH if c not in but]
    rows = frame.select(*[F.col(f"`{c}`") for c in names]).distinct().collect()
    assert [tuple(r) for r in rows] == [tuple(f"mine {c}" for c in names)]


def corpus():
    rnd = random.Random(5)
    words = ["the", "of", "and", "is", "to", *("w%d" % i for i in range(60))]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = prose(120), prose(40)
    texts = [None, "", " \n\t", "one", "one two three", base, base, base.upper(), base + " tail", base.replace("w1 ", "w2 ", 1), passage + " " + prose(30), prose(25) + "\n" + passage, "é中🙂 " * 50, prose(3000), "x" * 5000, "a b\n" * 40, "### $$$ ||| " * 40]
    texts += [prose(rnd.randint(1, 60)) for _ in range(25)]
    return [(i, t, "en", "old", 7) for i, t in enumerate(texts)] + [(5, base, "en", "old", 7), (None, base, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def known():
    return [(i, t or "") for i, t, *_ in corpus() if i is not None]


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 2000, "least_block": 256}, {"chunk_bytes": 500, "least_block": 64}])
def test_substrings(docs, none, sizes):
    first = {}
    words = [(i, WORDS.findall(t)) for i, t in known()]
    for i, w in sorted(words):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    want = []
    for i, w in words:
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substrings.remove_repeats(docs, **sizes).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got if r.doc_id is not None) == sorted(want)
    (lost,) = [r for r in got if r.doc_id is None]
    assert lost.n_removed == 0
    assert sum(w[2] for w in want) > 0
    assert substrings.remove_repeats(none, **sizes).count() == 0
    odd = substrings.remove_repeats(clashing(docs), **sizes)
    unharmed(odd)
    assert odd.count() == docs.count()


@pytest.mark.parametrize("percent,few", [(85, 8), (80, 8), (80, 0)])
def test_near_duplicates(spark, monkeypatch, docs, none, percent, few):
    monkeypatch.setattr(minmax, "FEW", few)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in known():
        w = WORDS.findall(t.translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    _, links = minmax.link_components(docs, "doc_id", "text", percent=percent)
    found = {r.node: r.component for r in links.collect()}
    assert {i: found.get(i, i) for i in sets} == label
    got = minmax.near_duplicates(docs, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert len(got) == docs.count()
    assert minmax.near_duplicates(none).count() == 0
    assert minmax.keep_one(docs, percent=percent).columns == docs.columns
    unharmed(minmax.keep_one(clashing(docs), percent=percent))


@pytest.mark.parametrize("few,rounds", [(8, 4), (0, 1)])
def test_groups_that_are_alike_but_for_their_leader(spark, monkeypatch, few, rounds):
    monkeypatch.setattr(minmax, "FEW", few)
    monkeypatch.setattr(minmax, "ROUNDS", rounds)
    rnd = random.Random(3)
    core = ["c%d" % i for i in range(150)]
    rows = []
    for family in range(4):  # each is alike, and shares with the others just less than the threshold
        tail = ["f%d-%d" % (family, i) for i in range(27)]
        for k in range(12):
            words = core + tail + ["x%d-%d" % (family, rnd.randint(0, 3)) for _ in range(rnd.randint(0, 4))]
            rows.append((family * 100 + k, " ".join(words)))
    rows += [(5, " ".join(core[:60])), (950, " ".join(core[:60] + ["y"])), (5, rows[20][1])]  # an id with two texts
    sets = defaultdict(list)
    for i, t in rows:
        w = t.split()
        sets[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    label = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=80, bands=36).collect()
    assert {r.doc_id: r.component_id for r in got} == label and len(set(label.values())) > 2


def test_bands_follow_from_the_threshold(docs, monkeypatch):
    assert (minmax.bands_for(85), minmax.bands_for(80)) == (24, 36) and all((1 - (p / 100) ** 5) ** minmax.bands_for(p) < 1e-6 for p in (50, 70, 95, 100))
    used, near = [], minmax.near_duplicates
    monkeypatch.setattr(minmax, "near_duplicates", lambda *a, bands: used.append(bands) or near(*a, bands=bands))
    minmax.keep_one(docs.limit(3), percent=80)
    corpus_pipeline.near_dedup(None, docs.limit(3), "")
    assert used == [36, 36]


def test_a_chain_of_copies_is_one_component(spark):
    words = ["w%d" % i for i in range(400)]
    rows = []
    for k in range(12):
        words[k * 30] = f"new{k}"
        words[k * 30 + 7] = f"also{k}"
        rows.append((100 - k, " ".join(words)))
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {89}


@pytest.mark.parametrize("sizes,least", [({}, 1024), ({"block_values": 16 * 16}, 1024), ({"block_values": 16 * 7}, 5)])
def test_embeddings(spark, monkeypatch, sizes, least):
    monkeypatch.setattr(embed_dedup, "LEAST_ROWS", least)  # so that small tables have pivots too
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(40, 16))
    near = base[:10] + 0.12 * rnd.normal(size=(10, 16))
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.concatenate((base, near, near[:3], 5 * base[:2])))]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [1.0]), (905, [float("inf")] + [0.0] * 15)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **sizes).collect()}
    x = np.array([v for i, v in rows if i < 900], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.95
    label = np.arange(len(x))
    for _ in x:
        label = np.array([label[row].min() for row in link])
    want = {i: (int(link[i].sum()) - 1, int(label[i]), bool(label[i] == i)) for i in range(len(x))} | {i: (0, i, True) for i in range(900, 906)}
    assert got == want
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_that_link_with_nothing_and_repeated_ids(spark):
    """A third of the rows has no usable vector; one id has two vectors; columns have the operator's own names."""
    rows = [(i, None) for i in range(100, 130)] + [(i, [0.0, 0.0]) for i in range(130, 160)] + [(None, [1.0, 0.0])] * 3 + [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 3.0]), (4, [float("nan"), 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("key", "rep", "weight", "links", "component", "vec", "size", "node")})
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(frame).collect()), key=repr)
    alone = [(i, 0, i, True) for i, v in rows if i is not None and (i >= 100 or i == 4)] + [(None, 0, None, True)] * 3
    assert [g for g in got if g in alone] == sorted(alone, key=repr)
    assert {g[0] for g in got if g not in alone} == {1, 2, 3} and len(got) == len(rows)
    assert all(g[2] == 1 for g in got if g[0] in (1, 2) and g[1]) and embed_dedup.near_vectors(frame.limit(0)).count() == 0


def test_long_vectors_and_pruned_cells(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "LEAST_ROWS", 5)
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(8, 1500))
    x = np.concatenate([c + rnd.choice([0.05, 0.2, 0.5]) * rnd.normal(size=(25, 1500)) for c in centres])
    x[0], x[1] = np.sign(x[0]), np.sign(x[0])  # flat vectors, the largest products
    x[1, :37] *= -1
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_values=1500 * 20).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert got == {i: int(n) - 1 for i, n in enumerate((x @ x.T >= 0.95).sum(axis=1))} and len(set(got.values())) > 2


def test_quantisation_bounds_hold():
    x = np.random.default_rng(1).normal(size=(200, 64))
    unit, codes, step, rest = embed_dedup.quantise(x)
    error = np.abs(unit @ unit.T - np.outer(step, step) * (codes @ codes.T))
    assert (error <= rest[:, None] + rest[None] + np.outer(rest, rest) + 1e-6).all()


def test_quality_counts_and_guards(docs, none):
    got = [r for r in quality.judge(docs).collect() if r.doc_id is not None]
    for r, (i, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(known()), strict=True):
        w = WORDS.findall(t)
        windows = defaultdict(list)
        for p in range(len(w) - 7):
            windows[tuple(w[p : p + 8])].append(p)
        again = {q for ps in windows.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)), i
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
    assert quality.judge(none).count() == 0


def test_quality_verdicts(spark):
    rnd = random.Random(1)
    common = "the of and to in is that it was for".split()
    prose = lambda: " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("etaoinshr") for _ in range(6)) for _ in range(150))
    rows = [(i, prose(), "en") for i in range(60)] + [(100 + i, prose().upper(), "en") for i in range(4)] + [(200 + i, prose().replace(" ", "### "), "en") for i in range(4)] + [(300, prose(), None)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i in [*range(60), 300]) and not any(kept[i] for i in [*range(100, 104), *range(200, 204)])


def test_languages_without_a_word_list(spark):
    rnd = random.Random(2)
    prose = lambda common, letters: " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice(letters) for _ in range(6)) for _ in range(150))
    en = lambda: prose("the of and to in is that it was for".split(), "etaoinshr")
    ru = lambda: prose("и в не на что он как это но по".split(), "оеаинтсрвл")
    pl = lambda: prose("i w nie się jest to że z do jak".split(), "aioeznrwsc")
    rows = [(i, en(), "en") for i in range(40)] + [(100 + i, ru(), "ru") for i in range(40)] + [(200 + i, pl(), "pl") for i in range(40)] + [(300, ru(), None), (301, pl(), "en"), (302, ru(), "uk"), (303, ru(), "de")]
    junk = [(400, en().upper(), "en"), (401, en().replace(" ", "### "), "ru"), (402, pl().replace(" ", " x$%& "), "pl"), (403, "same words again and again here now " * 30, "uk")]
    frame = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id: r.kept for r in quality.judge(frame).collect()}
    assert [i for i, *_ in rows if not kept[i]] == [] and not any(kept[i] for i, *_ in junk)
    alone = {r.doc_id: (r.char_distance, r.word_distance) for r in quality.judge(frame.where("lang = 'en' AND doc_id < 40")).collect()}
    _, refs = quality.references(frame.where("doc_id < 300"))
    _, only = quality.references(frame.where("doc_id < 40"))
    assert set(refs) == {"en", "ru", "pl"} and all(np.array_equal(a, b) for a, b in zip(refs["en"][:2], only["en"][:2], strict=True)) and len(alone) == 40


def test_distance_is_jensen_shannon():
    p, q = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]]), np.array([0.5, 0.5, 0.0])
    m = (p[1] + q) / 2
    kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    assert np.allclose(quality.distance(p, q), [0, np.sqrt((kl(p[1], m) + kl(q, m)) / 2)])


#: Letters that one table of letters knows and another does not, and others with odd cases.
NEW_LETTERS = "\ua7cb\ua7dc\u1c89\U00010d50\U00016ea0İßſŉǅⅷ²\u0345\u0301\u2000\u180e\x1c\x85"
ODD = ["n\U00016ea0't", " ", "  ", "   x", "a  b", "a \n b", "\n\n x ", "x \t y  ", "'s don't 'LL", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>", "ΑΣ Σ", "İé e\u0301", "1 22 333", "a" * 300, "x\x1cy\x85z", "…“q”", "<|", "word,word.word"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunk_encoder_equals_the_library(name):
    library = tokenizers.Tokenizer.from_file(P.path(name))
    rnd = random.Random(3)
    letters = list(" \n\t'sdtLM.,1é中🙂ßΣ-_") + ["  ", " the", "ing", "<|endoftext|>"] + list(NEW_LETTERS)
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    anywhere = [chr(c) for c in range(32, 0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(rnd.choice(anywhere + letters * 3000) for _ in range(8)) for _ in range(3)] + ["".join(rnd.sample(anywhere, 6)) + " 'S " for _ in range(1500)]
    encoders = [tokens.load(P.path(name))] + ([bpe.Codec(P.path(name)).encoder] if name.startswith("byte") else [])
    for encoder in encoders:
        ids, counts = encoder.encode(texts)
        ends = np.cumsum(counts)
        for t, a, b in zip(texts, ends - counts, ends, strict=True):
            assert library.encode(t, add_special_tokens=False).ids == ids[a:b].tolist(), t


def test_speculation_verifies_and_repairs():
    codec = bpe.Codec(P.path("byte_bpe_50k.json"))
    s = codec.speculator
    assert all(s.merge(raw) == [i] for i, raw in enumerate(s.bytes))  # every token encodes to itself, which the pair test needs
    codec.encoder.encode([" ".join("".join(random.Random(i).choice("etaoinshr") for _ in range(9)) for i in range(500))])
    assert 0 < s.failed < s.checked
    failed = s.failed
    long = ["a" * 300, "ab" * 40_000, "".join(random.Random(1).choice("etaoinshr") for _ in range(5000))]
    want = [tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(t, add_special_tokens=False).ids for t in long]
    assert s.encode(long) == want and failed < s.failed < failed + 3  # long pre-tokens are speculated on too


def test_bpe_round_trip(docs, none):
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in bpe.encode_decode(docs.select("doc_id", "text"), P.path("byte_bpe_50k.json")).collect():
        text = dict(known()).get(r.doc_id, corpus()[5][1])
        ids = library.encode(text, add_special_tokens=False).ids
        assert (np.frombuffer(r.ids, "<u4").tolist(), r.decoded, r.n_tokens) == (ids, library.decode(ids, skip_special_tokens=False), len(ids))
    assert bpe.encode_decode(none, P.path("byte_bpe_50k.json")).count() == 0


def test_token_files(spark, docs, none):
    path = shared.new_path(spark, "tokens")
    token_files.write(docs, path, P.path("word_bpe_49k.json"), end_id=1, segment_ids=400)
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    want = sorted(((i, t or "") for i, t, *_ in corpus()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    at = 0
    for r, (i, t) in zip(rows, want, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, at, len(ids), ids)
        at += len(ids)
    odd = clashing(docs).withColumns({c: F.lit(1) for c in ("shard", "segment", "ids", "image", "text2")})
    token_files.write(odd, again := shared.new_path(spark, "tokens"), P.path("word_bpe_49k.json"), end_id=1)
    assert sorted(map(str, token_files.read(spark, again).collect())) == sorted(map(str, rows))
    token_files.write(none, empty := shared.new_path(spark, "tokens"), P.path("word_bpe_49k.json"), end_id=1)
    assert token_files.read(spark, empty).count() == 0


@pytest.mark.parametrize("counts", [[1], [0, 0, 5], [3] * 500, [100000, 0, 1], list(range(200))])
def test_elias_fano_select(counts):
    ids = np.arange(sum(counts)) % 60000
    image = token_files.pack(np.array(counts), ids, 2)
    s = token_files.Segment(image)
    ends = np.concatenate(([0], np.cumsum(counts)))
    assert s.offsets(0, len(counts)).tolist() == ends.tolist() == [s.offset(i) for i in range(len(ends))]
    assert s.ids.tolist() == ids.tolist()
    for lo in range(0, len(counts), 97):
        assert s.offsets(lo, hi := min(lo + 90, len(counts))).tolist() == ends[lo : hi + 1].tolist()
    with pytest.raises(ValueError):
        token_files.pack(np.array([1]), np.array([65536]), 2)


def test_packing(spark, docs, none):
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.cut(docs.select("doc_id", "text"), P.path("byte_bpe_50k.json"), end_id=2, capacity=64)
    rows = packing.pack(pieces, by=["doc_id", "piece"], capacity=64, open_bins=8).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    texts = defaultdict(list)
    for i, t, *_ in corpus():
        texts[i].append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    for i, docs_ids in texts.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, docs_ids))
        if len(docs_ids) == 1:
            ps = sorted(by_doc[i], key=lambda r: r.piece)
            assert [p.start for p in ps] == np.cumsum([0, *(p.length for p in ps)])[:-1].tolist()
            assert sum((np.frombuffer(p.ids, "<u4").tolist() for p in ps), []) == docs_ids[0]
            assert all(p.length == 64 for p in ps[1:]) and len(ps) == -(-len(docs_ids[0]) // 64)
    made = packing.sequences(spark.createDataFrame([(r.sequence_id, r.offset, r.length, bytes(r.ids)) for r in rows], "sequence_id long, offset long, length long, ids binary")).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in made) and len(made) == len(bins)
    assert packing.pack(packing.cut(none, P.path("byte_bpe_50k.json"), 2), by=["doc_id"]).count() == 0
    odd = packing.pack(packing.cut(clashing(docs), P.path("byte_bpe_50k.json"), 2), by=["doc_id", "piece"])
    unharmed(odd, ["Ids"])
    unharmed(bpe.encode_decode(clashing(docs), P.path("byte_bpe_50k.json")), ["Ids"])


@pytest.mark.parametrize("kind", ["mixed", "long", "short"])
def test_packing_needs_few_sequences(spark, kind):
    rnd = random.Random(7)
    draw = {"mixed": lambda: rnd.choice([rnd.randint(1, 1024), 1024, rnd.randint(1, 60)]), "long": lambda: rnd.choice([rnd.randint(513, 700), rnd.randint(50, 300), rnd.randint(50, 300)]), "short": lambda: rnd.randint(1, 90)}[kind]
    rows = [(i, draw()) for i in range(40_000)]
    bound = max(-(-sum(n for _, n in rows) // 1024), sum(n > 512 for _, n in rows))  # no two of the latter fit together
    frame = spark.createDataFrame(rows, "item long, length long").repartition(4)
    made = packing.pack(frame, by=["item"]).select("sequence_id").distinct().count()
    assert made <= 1.02 * bound


def test_packer_takes_the_tightest_bin_and_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (6, 7, 3, 9, 4, 1)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 9)]
    p = packing.Packer(10, 2)
    assert [p.place(n)[0] for n in (6, 5, 8, 2, 5)] == [0, 1, 2, 2, 1]  # the third opening closes bin 0, the fullest
    with pytest.raises(ValueError):
        p.place(11)


def test_urls(spark, monkeypatch):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/")]
    rnd = random.Random(4)
    made = [None, "", "abc", "http://", "HTTP://A.Example.COM/en/77?x", "x://org", "x://forg/es/", "x://a..org/#", "x://example.net/de/8x\ny", "a://b://com/en/"]
    made += [f"http://{rnd.choice(['', 'a.', 'b.c.'])}{rnd.choice(['example.', 'x.', ''])}{rnd.choice(['com', 'net', 'org', 'io'])}/{rnd.choice(['en', 'de', 'es'])}/{rnd.randint(0, 99)}" for _ in range(300)]
    rows = [(i, u, "old") for i, u in enumerate(made)]

    def brute(u):
        host = path = ""
        if u and "://" in u:
            host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + q), len(h), v, h + q) for v, h, q in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")

    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    want = [brute(u) for u in made]
    assert [(r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).orderBy("page_id").collect()] == want
    unharmed(urls.judge(clashing(pages), rules))
    monkeypatch.setattr(urls, "PER_CASCADE", 1)  # a list of several cascades, and level 1 so loose that it is built anew
    monkeypatch.setattr(urls, "hashes_for", lambda *_: 1)
    monkeypatch.setattr(urls, "LEAST", 5)
    monkeypatch.setattr(urls, "SLACK", 0)
    assert [(r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).orderBy("page_id").collect()] == want
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


@pytest.mark.parametrize("most", [24, 2])
def test_cascade_is_exact_on_its_universe(spark, monkeypatch, most):
    listed, universe = [f"k{i}" for i in range(0, 3000, 10)], [(f"k{i}",) for i in range(3000)]
    monkeypatch.setattr(urls, "BITS", 4)  # so dense that it needs several levels
    monkeypatch.setattr(urls, "HASHES", 2)
    monkeypatch.setattr(urls, "_MAX_LEVELS", most)
    keys = spark.createDataFrame(universe, "key string")
    (cascade,) = urls.build([listed], keys)
    assert len(cascade.levels) > 2 or (most == 2 and cascade.left)
    assert {r.key for r in keys.where(cascade.holds(F.col("key"))).collect()} == set(listed)


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\") to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = [None, "", "Nothing here.", "x\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", mit + " Licensed under CC BY-NC 4.0.", "Redistributions of source code must retain the above copyright notice."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licences.scan(frame).orderBy("doc_id").collect()
    unharmed(licences.scan(clashing(frame)))
    assert licences.scan(frame.limit(0)).count() == 0 and [r.licences for r in licences.scan(frame.union(frame)).where("doc_id = 3").collect()] == [["MIT"]] * 2
    long = spark.createDataFrame([(1, "word, " * 300_000 + "\nReleased under the MIT License.\n" + "x\n" * 100_000)], "doc_id long, text string")
    assert licences.scan(long).first().licences == ["MIT"]
    assert [r.licences for r in rows] == [[], [], [], ["MIT"], ["Apache-2.0"], ["MIT", "CC-BY-NC-4.0"], []]
    assert rows[6].unmatched == ["BSD_SOURCE"] and rows[4].unmatched == []
    assert rows[5].sentence_ids == ["MIT_GRANT", "MIT_NOTICE", "CC_BY_NC_4_REF"]


MIT_TEXT = """MIT License

Copyright (c) 2020 Some One
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL_TEXT = """ *  This program is free software: you can redistribute it and/or modify
 *  it under the terms of the GNU General Public License as published by
 *  the Free Software Foundation, either version 3 of the License, or
 *  (at your option) any later version.
 *
 *  This program is distributed in the hope that it will be useful,
 *  but WITHOUT ANY WARRANTY; without even the implied warranty of
 *  MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 *  GNU General Public License for more details.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
APACHE_TEXT = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""


def test_real_licence_texts(spark):
    wrapped = [MIT_TEXT, GPL_TEXT, BSD_TEXT, BSD_TEXT.replace("the copyright holder nor", "Some\n   Company nor"), BSD_TEXT.split("3. ")[0], APACHE_TEXT]
    unwrapped = [re.sub(r"\n[ *#]*(?=[^\n *#\d])", " ", t) for t in (GPL_TEXT, BSD_TEXT)] + [MIT_TEXT.replace("One\n", "One\n\n").replace("\n\n", "\t").replace("\n", " ").replace("\t", "\n")]
    split = MIT_TEXT.replace("free of charge, to", "free of charge,\n\nto").split("The above")[0]
    texts = [*wrapped, *unwrapped, *(t.replace("\n", "\r\n") for t in wrapped), split]
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    want = [["MIT"], ["GPL-3.0-or-later"], ["BSD-3-Clause"], ["BSD-3-Clause"], ["BSD-2-Clause"], ["Apache-2.0"]]
    assert [r.licences for r in rows] == [*want, want[1], want[2], want[0], *want, []]
    assert rows[0].sentence_ids == ["MIT_GRANT", "MIT_NOTICE", "AS_IS", "NO_LIABILITY"] and not any(r.unmatched for r in rows)


GNU_TEXT = """    This NOUN is free software; you can redistribute it and/or
    modify it under the terms of the GNU FAMILY
    License as published by the Free Software FoundationSEP either
    version VERSION of the License, or (at your option) any later version.

    This NOUN is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
OTHER_TEXTS = {
    "ISC": """Copyright (c) 2020, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DAMAGES.""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty.""",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike\n4.0 International License.",
    "GPL-2.0-or-later": GNU_TEXT.replace("NOUN", "program").replace("FAMILY", "General Public").replace("SEP", ";").replace("VERSION", "2"),
    "LGPL-2.1-or-later": GNU_TEXT.replace("NOUN", "library").replace("FAMILY", "Lesser General Public").replace("SEP", ";").replace("VERSION", "2.1"),
    "LGPL-3.0-or-later": GNU_TEXT.replace("NOUN", "program").replace("FAMILY", "Lesser General Public").replace("SEP", ",").replace("VERSION", "3"),
    "AGPL-3.0-or-later": GNU_TEXT.replace("NOUN", "program").replace("FAMILY", "Affero General Public").replace("SEP", ",").replace("VERSION", "3"),
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.",
}


def test_texts_of_other_licences(spark):
    texts = [f(t) for t in OTHER_TEXTS.values() for f in (str, lambda t: re.sub(r"(?m)^", "# ", t), lambda t: t.replace("\n", "\r\n"))]
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licences for r in rows] == [[name] for name in OTHER_TEXTS for _ in range(3)]
    assert not any(r.unmatched for r in rows)


CONTROL = ["</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "<\\s> [\\INST]", "\\n \\", "<\\\\|end|>", "<|endoftext|>", "a<|startoftext|>b", "<<SYS>> x <</SYS>>", "<<\\SYS>><</s><<s>", "<|im_start|><\\|x|>", "", None]


def test_chat_round_trip(spark):
    rnd = random.Random(6)
    rows = []
    for c in [None, *range(25)]:
        for t in range(rnd.randint(1, 30)):
            role = "system" if t == 0 and rnd.random() < 0.4 else rnd.choice(["user", "assistant", "assistant", "a\\n\nb", None, "system"])
            rows.append((c, rnd.choice([t, t, None]), role, rnd.choice([*CONTROL, "word " * rnd.randint(1, 60), "w! " * rnd.choice([1, 400])])))
    rows += rows[:3]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=200, history=30)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(made).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        want[c] = (len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(loss), sha(loss))
    assert got == want
    for r in made.collect():
        assert r.over_budget == (r.n_tokens > 200)
        bare = re.sub(r"<\|(turn|end)\|>", "", r.formatted)
        assert not re.search(r"<\|\w+\|>|</?s>|\[/?INST\]|<</?SYS>>", bare)
    assert chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    odd = chat.windows(clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), budget=200, history=30)
    assert {r.conv_id: r.turns_sha256 for r in chat.digest(odd).collect()} == {c: w[1] for c, w in want.items()}


def test_chat_windows_keep_the_system_turn_and_mask_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, ["user", "assistant"][t % 2], f"turn {t} " + "w " * 20) for t in range(1, 20)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=200, history=60).orderBy("window").collect()
    assert len(made) > 2 and not any(r.over_budget for r in made)
    for r in made:
        assert r.formatted.startswith("<|turn|>system\nbe kind<|end|>\n")
    assert all(r.n_context > 1 for r in made[1:])
    learned = [re.search(r"turn (\d+)", r.formatted[s.start : s.start + s.length])[1] for r in made for s in r.loss_spans]
    assert learned == [str(t) for t in range(1, 20, 2)]


def test_crc_of_ids(spark):
    df = spark.createDataFrame([(bytearray(np.array([1, 70000], "<u4").tobytes()),)], "ids binary")
    assert df.select(F.crc32("ids")).first()[0] == zlib.crc32(np.array([1, 70000], "<u4").tobytes())
