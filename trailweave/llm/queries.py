"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embed_dedup, filter_audit, licences, minmax, packing, periodic, quality, shared, substrings, token_counts, token_files, urls


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "token-files")
    token_files.write(_read(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licences.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(control))
    return chat.digest(chat.windows(turns))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), end_id=2)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, by=["doc_id", "piece"])


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


#: (verdict, host, path) of the rules to apply.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _read(spark, sf_dir, "labels"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """Of a tenth of the documents, by a checksum of their id, the words from one place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    some = docs.withColumns({"h": h, "g": g}).withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda x: x != "")))
    some = some.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("w", 1, F.col("a")), F.slice(again, 1, rest)), " ")
    return some.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_made_periodic(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.p")).alias("period"), F.expr("1000 * top.length div -top.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_WORDS = r"""
docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents)"""

_PAIRS = ", ".join(f"('{k}', '{v}')" for k, v in licences.SENTENCES.items())


def _replaced(count: int) -> str:
    left = "s"
    for _, ids in licences.RULES[:count]:
        left = f"replace({left}, '{''.join(f'<{i}>' for i in ids)}', '|')"
    return left


_HITS = ", ".join(f"CASE WHEN contains({_replaced(n)}, '{''.join(f'<{i}>' for i in ids)}') THEN '{licence}' END" for n, (licence, ids) in enumerate(licences.RULES))
_NAMES = list(dict.fromkeys(licence for licence, _ in licences.RULES))
_FIRST = ", ".join(f"'{w}'" for w in sorted({k.split()[0] for k in licences.SENTENCES}))
_RUN = max(len(k.split()) for k in licences.SENTENCES) + licences.NAME_WORDS
_FILLED = "s"
for _begin, _pattern, _form in licences.NAMED:
    _FILLED = f"CASE WHEN starts_with({_FILLED}, '{_begin}') THEN regexp_replace({_FILLED}, '{_pattern}', '{_form}') ELSE {_FILLED} END"
_OP2 = rf"""
WITH known(sentence, name) AS (VALUES {_PAIRS}),
plain AS (
  SELECT doc_id, regexp_replace(replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.!?:;]+([\x09-\x0D\x20]|$)', chr(1) || chr(1) || '\1', 'g'), chr(10), chr(1)), '[^\p{{L}}\p{{N}}\x01]+', ' ', 'g') AS p
  FROM documents),
parts AS (SELECT doc_id, list_transform(string_split_regex(p, ' ?\x01 ?'), lambda x: trim(x)) AS xs FROM plain),
begins AS (
  SELECT doc_id, pos, xs[pos:pos + {_RUN} - 1] AS run FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS pos FROM parts)
  WHERE split_part(xs[pos], ' ', 1) IN ({_FIRST})),
spans AS (
  SELECT doc_id, pos, pos + n AS next, {_FILLED} AS s
  FROM (SELECT doc_id, pos, n, array_to_string(run[1:n], ' ') AS s
    FROM (SELECT doc_id, pos, run, unnest(range(1, coalesce(nullif(list_position(run, ''), 0), len(run) + 1))) AS n FROM begins))),
hits AS (
  SELECT doc_id, list({{'pos': pos, 'next': next, 'ids': [name]}} ORDER BY pos, next DESC) AS xs FROM spans JOIN known ON s = sentence GROUP BY doc_id),
ids AS (
  SELECT doc_id, list_reduce(list_prepend({{'pos': 0::BIGINT, 'next': 0::BIGINT, 'ids': []::VARCHAR[]}}, xs),
    lambda a, x: CASE WHEN x.pos >= a.next THEN {{'pos': x.pos, 'next': x.next, 'ids': list_concat(a.ids, x.ids)}} ELSE a END).ids AS names
  FROM hits),
seq AS (SELECT d.doc_id, coalesce(names, []) AS names, coalesce('<' || array_to_string(names, '><') || '>', '') AS s FROM documents d LEFT JOIN ids USING (doc_id)),
hit AS (SELECT *, [{_HITS}] AS h FROM seq)
SELECT doc_id, len(names) AS n_known, array_to_string(names, ',') AS sentence_ids,
  array_to_string(list_filter([{", ".join(f"CASE WHEN list_contains(h, '{x}') THEN '{x}' END" for x in _NAMES)}], lambda x: x IS NOT NULL), ',') AS licences
FROM hit"""

_OP3 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
ranked AS (
  SELECT *, len(regexp_extract_all(text, '\w+|[^\w\x09-\x0D\x20]')) + 4 AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rank
  FROM turns),
marked AS (SELECT *, rank = 1 AND role = 'system' AS sys, CASE WHEN rank = 1 AND role = 'system' THEN 0 ELSE tokens END AS own FROM ranked),
summed AS (
  SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY rank) AS upto,
    greatest(1, floor((1024 - 128 - coalesce(max(CASE WHEN sys THEN tokens END) OVER (PARTITION BY conv_id), 0)) / 2)) AS stride
  FROM marked),
slots AS (SELECT *, own > stride AS big, floor((upto - own) / stride) AS slot FROM summed),
breaks AS (
  SELECT *, NOT sys AND rank > 1 AND NOT coalesce(lag(sys) OVER w, false) AND (big OR slot <> lag(slot) OVER w OR lag(big) OVER w) AS b
  FROM slots WINDOW w AS (PARTITION BY conv_id ORDER BY rank)),
spans AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY rank) AS span FROM breaks),
ends AS (SELECT *, max(span) OVER (PARTITION BY conv_id) AS last, max(upto) OVER (PARTITION BY conv_id, span) AS stop FROM spans),
sized AS (
  SELECT conv_id, rank, role, text,
    CASE WHEN sys THEN last + 1 WHEN span < last AND stop - upto + own <= 128 THEN 2 ELSE 1 END AS times,
    17 + sum(length(regexp_replace(regexp_replace(x, '<(\\*)(\|\w+\|>|/?s>|</?SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g'))) AS chars
  FROM (SELECT *, unnest([text, replace(replace(role, '\', '\\'), chr(10), '\n')]) AS x FROM ends)
  GROUP BY ALL)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rank)) AS turns_sha256,
  length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rank), '')) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rank), '')) AS loss_sha256,
  CAST(sum(times * chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

_OP4 = r"""
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT a AS node, a AS other FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other),
n AS (SELECT a, count(*) AS c FROM links GROUP BY a),
m AS (SELECT node, min(other) AS o FROM reach GROUP BY node)
SELECT v.vec_id, coalesce(n.c, 0) AS n_links, coalesce(m.o, v.vec_id) AS component_id, coalesce(m.o, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.node = v.vec_id"""

_OP7 = r"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS p FROM pages),
named AS (
  SELECT page_id,
    CASE WHEN p > 0 THEN translate(regexp_extract(substr(u, p + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN p > 0 THEN regexp_extract(substr(u, p + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut),
rules(verdict, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (
  SELECT page_id, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) AS k
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT n.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM named n LEFT JOIN fits f ON f.page_id = n.page_id AND k = 1"""

_OP6 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
long_sets AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM docs WHERE len(w) >= 5),
sets AS (SELECT DISTINCT doc_id, s FROM long_sets UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT a AS node, a AS other FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, coalesce(min(reach.other), d.doc_id) AS component_id, coalesce(min(reach.other), d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN reach ON reach.node = d.doc_id
GROUP BY d.doc_id"""

_OP9 = f"""
WITH {_WORDS},
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM docs WHERE len(w) >= 13),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM windows),
seen AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM keyed),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM seen WHERE doc_id > least),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(l.ps), 0) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(d.w) + 1), lambda i: NOT coalesce(list_contains(l.ps, i), false)), lambda i: d.w[i]), ' '), '')) AS kept_sha256
FROM docs d LEFT JOIN lists l USING (doc_id)"""


_CHAR_CLASSES = ["[a-z]", "[A-Z]", r"[^\x00-\x7F]", r"[.,;:?''\"()-]", r"[#*$%&|<>!~^_=+{}\[\]@/\\`]", r"[\x00-\x08\x0E-\x1F\x7F]"]
_JS = "sqrt(greatest(0, least(1, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)))"
_OP10 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
base AS (
  SELECT row, doc_id, lang, t, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines
  FROM docs),
windows AS (SELECT row, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM docs)),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, s) AS c FROM windows) WHERE c > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM again, range(8) r(k) GROUP BY row),
counted AS (
  SELECT b.*, len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM base b LEFT JOIN covered c USING (row)),
failing AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
terms AS (SELECT row, lang, n_words, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM docs JOIN (SELECT row, n_words FROM base) USING (row)),
labels AS (SELECT lang FROM base WHERE lang IS NOT NULL AND n_words >= {quality.MIN_WORDS} GROUP BY lang HAVING count(*) >= {quality.MIN_DOCS}),
common AS (
  SELECT lang, word FROM (
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(DISTINCT row) DESC, word) AS k
    FROM terms JOIN labels USING (lang) WHERE n_words >= {quality.MIN_WORDS} GROUP BY lang, word)
  WHERE k <= {quality.COMMON}),
chars AS (
  SELECT row, c, n, sum(n) OVER (PARTITION BY row) AS total
  FROM (SELECT row, unnest([{", ".join(f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in _CHAR_CLASSES)}]) AS n, unnest(range({len(_CHAR_CLASSES)})) AS c FROM base)),
medians AS (
  SELECT lang, c, quantile_disc(round_even(n / greatest(total, 1) * {quality._STEPS}, 0), 0.5) AS m
  FROM chars JOIN base USING (row) JOIN labels USING (lang) WHERE n_words >= {quality.MIN_WORDS} GROUP BY lang, c),
char_ref AS (SELECT lang, c, m / greatest(sum(m) OVER (PARTITION BY lang), 1) AS q FROM medians),
seen AS (SELECT t.row, c.lang, c.word, count(*) AS n FROM terms t JOIN common c USING (word) GROUP BY ALL),
grid AS (SELECT row, n_words, b.lang AS own, c.lang, c.word FROM base b, common c),
word_part AS (
  SELECT g.row, g.own, g.lang, g.word, g.n_words, coalesce(s.n, 0) AS n FROM grid g LEFT JOIN seen s ON s.row = g.row AND s.lang = g.lang AND s.word = g.word),
word_bins AS (
  SELECT row, own, lang, word, n_words, n / greatest(n_words, 1) AS p FROM word_part
  UNION ALL SELECT row, any_value(own), lang, NULL, any_value(n_words), (any_value(n_words) - sum(n)) / greatest(any_value(n_words), 1) FROM word_part GROUP BY row, lang),
word_sums AS (SELECT lang, word, sum(round_even(p * {quality._UNIT}, 0)) AS s FROM word_bins WHERE own = lang AND n_words >= {quality.MIN_WORDS} GROUP BY lang, word),
word_ref AS (SELECT lang, word, s / greatest(sum(s) OVER (PARTITION BY lang), 1) AS q FROM word_sums),
by_word AS (
  SELECT row, min(d) AS d FROM (
    SELECT row, lang, {_JS} AS d FROM (SELECT row, lang, p, q FROM word_bins JOIN word_ref r USING (lang) WHERE word_bins.word IS NOT DISTINCT FROM r.word) GROUP BY row, lang) GROUP BY row),
by_char AS (
  SELECT row, min(d) AS d FROM (
    SELECT row, lang, {_JS} AS d FROM (SELECT row, r.lang, n / greatest(total, 1) AS p, q FROM chars JOIN char_ref r USING (c)) GROUP BY row, lang) GROUP BY row)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
  NOT base_failed AND NOT (coalesce(f.lang IN (SELECT lang FROM labels), false) AND
    ((f.word_chars >= {quality.MIN_CHARS} AND coalesce(c.d, 0) > {quality.MAX_CHAR_DISTANCE}) OR (f.n_words >= {quality.MIN_WORDS} AND coalesce(w.d, 0) > {quality.MAX_WORD_DISTANCE}))) AS kept
FROM failing f LEFT JOIN by_char c USING (row) LEFT JOIN by_word w USING (row)"""


_OP11 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f
  FROM docs LEFT JOIN said USING (doc_id)),
counts AS (SELECT part, good, toxic, f, count(*) AS n FROM failing GROUP BY ALL),
letters(c, k) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT filter_order, CAST(s AS INT) AS step, ks[s] AS k, ks[1:s - 1] AS before FROM orders, range(1, 6) r(s)),
judged AS (
  SELECT part, good, toxic, n, filter_order, step, k, f[k] AS own, len(list_filter(before, lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS fails FROM counts, steps),
totals AS (
  SELECT part, filter_order, step, k,
    sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN own AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN own AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM totals"""


_QUERIES = (
    op1_token_files,
    op2_licence_rules,
    op3_chat_windows,
    op4_embedding_near_dedup,
    op5_best_fit_packing,
    op6_minmax_near_dedup,
    op7_url_cascade,
    op8_bpe_round_trip,
    op9_substring_dedup,
    op10_distribution_divergence,
    op11_filter_audit,
    op12_token_counts,
    op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licence_rules": _OP2,
        "op3_chat_windows": _OP3,
        "op4_embedding_near_dedup": _OP4,
        "op6_minmax_near_dedup": _OP6,
        "op7_url_cascade": _OP7,
        "op9_substring_dedup": _OP9,
        "op10_distribution_divergence": _OP10,
        "op11_filter_audit": _OP11,
    }
