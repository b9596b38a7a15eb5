"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import exact_dedup, language_id, line_dedup, mixing, near_dedup, neighbours, periodic_runs
from recollect.llm import pieces, pii, quality, span_dedup, spelling, url_filter
from recollect.llm._session import table

URL_RULES = [
    url_filter.host_rule("com", "/", "allow"),
    url_filter.host_rule("example.com", "/en/", "block"),
    url_filter.host_rule("www.example.com", "/en/", "allow"),
    url_filter.host_rule("net", "/es/", "block"),
    url_filter.host_rule("net", "/fr/", "block"),
    # Words of hosts that are blocked where no rule above fits.
    *[url_filter.word_rule(w, rf"^(?:[^/]*[^a-z0-9/])?{w}(?:[^a-z0-9]|$)") for w in ("adult", "bet", "bets", "betting", "casino", "gambling", "poker", "porn", "sex", "slots", "viagra", "xxx")],
]


def held_out(remainder: int, of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == remainder


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, docs.where(~held_out(0, 5)))
    return found.select("doc_id", held_out(0, 5).alias("held_out"), "lang_pred", "score")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), "token_ids", F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("round_trip"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.flatten(F.transform("spans", lambda s: s["slots"]))
    mixed = mixing.mix(table(spark, sf_dir, "documents")).withColumn("slots", slots)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_min("slots").alias("first_slot"), F.size(F.array_distinct("slots")).cast("long").alias("n_slots"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(2, 4)).select("doc_id", "quality")
    found = quality.classify(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", held_out(2, 4).alias("held_out"), "score", "predicted")


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = span_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """Documents whose id has a crc32 divisible by 10 go on periodically from a word on; null ids have no crc32."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(mixing.WORD), F.lit(0))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("_some"), F.expr("crc32(cast(doc_id as string)) div 10").alias("_g"))
    rows = rows.withColumn("_words", F.when(F.col("_some"), words)).withColumn("_n", F.size("_words"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    moved = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_words", place(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_period(table(spark, sf_dir, "documents")))
    order = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("top", F.get(order, F.lit(0))).withColumn("length", -F.col("top.less"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), "length", F.col("top.period").alias("period"),
        F.expr("1000 * length div top.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base_sha256 are of the patterns' spans, spans also has what the tagger adds."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = found.withColumn("base", F.filter("spans", lambda s: s["base"]))
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{kind}'))").cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def with_planted_typos(runs: DataFrame) -> DataFrame:
    """Words of which those with a crc32 of id and word divisible by 199 lack a letter; null ids have no crc32."""
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("word")))
    at = F.when(F.col("doc_id").isNotNull() & (F.col("h") % 199 == 0), (F.col("h") % F.length("word")).cast("int"))
    short = F.concat(F.substr("word", F.lit(1), F.col("at")), F.substr("word", F.col("at") + 2))
    return runs.withColumn("h", h).withColumn("at", at).select("doc_id", F.coalesce(short, "word").alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = with_planted_typos(spelling.letter_runs(table(spark, sf_dir, "documents")))
    return spelling.variants(spelling.lexicon(runs))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_language_id, op3_pieces, op4_line_dedup, op5_neighbours, op6_mixing, op7_url_filter, op8_quality, op9_span_dedup, op10_exact_dedup, op11_periodic_runs, op12_pii, op13_spelling_variants)}

#: Unsigned crc32 of an ASCII string: its bytes one after the other, each by eight shifts.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda r, c: list_reduce(list_prepend(xor(r, c), list_resize(CAST([] AS BIGINT[]), 8, 0)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.a = d.doc_id""",
    "op5_neighbours": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_url_filter": r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.)*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(host_rule, path_rule, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, arg_max(host_rule || path_rule, len(host_rule || path_rule)) AS rule, arg_max(verdict, len(host_rule || path_rule)) AS verdict
  FROM u JOIN r ON (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE WHEN regexp_matches(u.host, '(^|[^a-z0-9])(adult|bet|bets|betting|casino|gambling|poker|porn|sex|slots|viagra|xxx)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f ON f.page_id = u.page_id""",
    "op9_span_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m ON g.g = m.g AND g.doc_id > m.first),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w.w) AS n, coalesce(len(gone), 0) AS r, CASE WHEN gone IS NULL THEN w.w ELSE list_transform(list_filter(range(1, len(w.w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w.w[i]) END AS kept FROM w LEFT JOIN x ON x.doc_id = w.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, n.h AS text_sha256 FROM n JOIN g ON g.h = n.h""",
    "op11_periodic_runs": rf"""
WITH h AS MATERIALIZED (SELECT doc_id, {_CRC.format("CAST(doc_id AS VARCHAR)")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS w FROM a),
-- A run of period p and 4 * p words has a multiple of p in its first p words, and there three periods are equal.
p AS (SELECT doc_id, w, n, unnest(range(1, n // 4 + 1)) AS p FROM d WHERE n >= 4),
i AS (SELECT doc_id, w, n, p, unnest(range(0, n - p, p)) AS i FROM p),
c AS (SELECT * FROM i WHERE w[i + 1] = w[i + p + 1] AND w[i + 2] IS NOT DISTINCT FROM w[i + p + 2] AND w[i + 1 : i + 2 * p] = w[i + p + 1 : i + 3 * p]),
e AS (SELECT doc_id, p, coalesce(list_max(list_filter(range(i), lambda k: w[k + 1] <> w[k + p + 1])) + 1, 0) AS s,
  p + coalesce(list_min(list_filter(range(i, n - p), lambda k: w[k + 1] <> w[k + p + 1])), n - p) AS e FROM c),
r AS (SELECT doc_id, s, e - s AS l, min(p) AS p FROM e WHERE e - s >= greatest(6, 4 * p) GROUP BY ALL),
x AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(s + p, s + l)) AS k FROM r) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_runs, first({{'s': s, 'l': l, 'p': p}} ORDER BY l DESC, s, p) AS t, string_agg(concat(s, ',', l, ',', p, chr(10)), '' ORDER BY s, p) AS lines FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, t.s AS start, t.l AS length, t.p AS period, 1000 * t.l // t.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda k: NOT list_contains(gone, k)), lambda k: w[k + 1]) END, ' '), '')) AS collapsed_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, list_resize(CAST([] AS BIGINT[]), 8, 0)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
o AS (SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{6,}'))")} AS w FROM documents),
u AS (SELECT doc_id, w, count(*) AS c, hex(encode(doc_id || ':' || w)) AS x FROM o GROUP BY doc_id, w),
h AS (SELECT w, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))),
  lambda r, b: xor(r >> 8, t[(xor(r, b) & 255) + 1]))) AS h FROM u, t),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 199 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
k AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v),
g AS MATERIALIZED (SELECT word, n, word[1 : k - 1] || '*' || word[k + 1 :] AS g, word[1 : k - 1] || word[k + 1 :] AS d FROM k),
p AS (SELECT a.word, b.word AS x, b.n FROM g a JOIN g b ON a.g = b.g AND a.word <> b.word
  UNION SELECT v.word, g.word, g.n FROM v JOIN g ON g.d = v.word UNION SELECT g.word, v.word, v.n FROM v JOIN g ON g.d = v.word),
b AS (SELECT word, count(*) AS n_near, first({{'x': x, 'n': n}} ORDER BY n DESC, x) AS b FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * v.n THEN b.x END AS form, CASE WHEN b.n >= 5 * v.n THEN b.n END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
r AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(root, step) AS root, n, n_near, form_n FROM f JOIN r ON r.word = f.word GROUP BY f.word, form, n, n_near, form_n""",
    "op6_mixing": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:15] AS BIGINT) AS draw FROM documents),
s AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
c AS (SELECT *, [5.0, 2.0, 1.0][1 + (nth - 1) % 3]::DOUBLE AS w, 3.0 * n AS cap, sum(n) OVER () AS total FROM s),
-- Sources in the order in which they are held; the level of the first that isn't counts for the rest.
f AS (SELECT *, (total - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k
  FROM c WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, min(CASE WHEN cap >= level * w THEN k END) OVER () AS free FROM f),
t AS (SELECT source, CAST(n AS BIGINT) AS n, CASE WHEN free IS NULL OR k < free THEN cap ELSE (SELECT level FROM g h WHERE h.k = g.free) * w END AS target FROM g),
b AS (SELECT *, (n + 4095) // 4096 AS blocks, goal // n * ((n + 4095) // 4096) + (goal % n + 4095) // 4096 AS slots FROM (SELECT *, CAST(round(target) AS BIGINT) AS goal FROM t) WHERE n > 0),
a AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b),
-- The first Fibonacci number that is not below the number of slots, and the one before, which is its own inverse up to the sign.
fib(step, modulus) AS (SELECT CAST(1 AS BIGINT), CAST(2 AS BIGINT) UNION ALL SELECT modulus, step + modulus FROM fib WHERE modulus < (SELECT sum(slots) FROM a)),
l AS (SELECT modulus, CASE WHEN step * step % modulus = 1 % modulus THEN step ELSE modulus - step END AS back FROM fib ORDER BY modulus DESC LIMIT 1),
q AS (SELECT source, blocks, CAST((start + i) * back % modulus AS BIGINT) AS slot FROM (SELECT *, unnest(range(CAST(slots AS BIGINT))) AS i FROM a), l),
r AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank, blocks FROM q),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM d),
m AS (SELECT o.doc_id, size, t.n, t.target, CASE WHEN t.n = 0 THEN 0 ELSE goal // t.n * size + greatest(0, least(first + size, goal % t.n) - first) END AS taken
  FROM o JOIN t ON t.source IS NOT DISTINCT FROM o.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM o.source),
v AS (SELECT o.doc_id, min(slot) AS first_slot, count(DISTINCT slot) AS n_slots FROM o JOIN a ON a.source IS NOT DISTINCT FROM o.source JOIN r ON r.source IS NOT DISTINCT FROM o.source
  WHERE size > 0 AND r.rank % r.blocks BETWEEN first // 4096 AND (first + size - 1) // 4096 AND (r.rank < a.slots - 1 OR goal % n = 0 OR first < goal % n) GROUP BY o.doc_id)
SELECT m.doc_id, size, n AS source_size, target, CAST(taken AS BIGINT) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots FROM m LEFT JOIN v ON v.doc_id = m.doc_id""",
}
