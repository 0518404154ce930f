"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.llm import common, conversations, decontaminate, divergence, extraction, jaccard, langid, language_model, licenses, lines, mixing, neighbours, substrings, toxicity
from memlake.llm.common import read
from memlake.llm.registry import QUERIES, SQL, query


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(common.fold("doc_id", 5) != 0))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", common.held_out("doc_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(common.fold("doc_id", 4) != 2))
    return langid.identify(docs, profiles, keep=["doc_id"]).select(
        "doc_id", common.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op10_decontamination", rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, win, len(win) AS n FROM (
    SELECT item, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: list_slice(w, i, i + 9))
                             WHEN len(w) > 0 THEN [w] ELSE [] END) AS win FROM b)),
dw AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS win FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw USING (n, win)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h USING (r) LEFT JOIN found f USING (r)""")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


@query("op3_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 19), ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)),
word AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p)
         GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read(spark, sf_dir, "documents"), keep=["doc_id"])
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_mixing", r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) - 1) % 3 + 1 AS weight,
             3 * source_size AS ceiling FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(ceiling) OVER need, 0) AS BIGINT) AS remaining,
             CAST(sum(weight) OVER () - coalesce(sum(weight) OVER need, 0) AS BIGINT) AS heavy FROM w
      WINDOW need AS (ORDER BY ceiling / weight, source IS NULL, CAST(source AS BLOB)
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, remaining * weight > ceiling * heavy AS is_full FROM l),
v AS (SELECT remaining, heavy FROM f WHERE NOT is_full ORDER BY remaining * 1.0 / heavy DESC, heavy DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_full OR v.heavy IS NULL THEN CAST(ceiling AS DOUBLE)
        ELSE least(CAST(v.remaining AS DOUBLE) / v.heavy * weight, CAST(ceiling AS DOUBLE)) END AS target
      FROM f LEFT JOIN v ON true),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             CAST('0x' || md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|mix-1')[1:13] AS BIGINT)
               / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r""")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op2_ngram_jaccard", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE
        WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
f AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM f x JOIN f y ON x.g = y.g AND x.doc_id < y.doc_id
      GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.other)
SELECT doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM s JOIN reach USING (doc_id) GROUP BY doc_id""")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(read(spark, sf_dir, "documents"), least_chars=None, keep=["doc_id"])
    return found.select("doc_id", "n_lines", F.size("removed_lines").cast("bigint").alias("n_removed"),
                        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op8_language_model")
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"), common.held_out("doc_id", 7, 2))


@query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


_LETTERS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_source_divergence", rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS} AS w
           FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
      FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 30),
s AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + 1000000000 * (coalesce(c.n, 0) + 5) // (coalesce(o.n, 0) + 5 * s.v) AS p,
             1 + 1000000000 * (k.total + 5) // (s.n + 5 * s.v) AS q
      FROM g JOIN s USING (lang) JOIN k USING (lang) LEFT JOIN o USING (lang, source) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(sum(abs(a.p - b.p)), 0) AS BIGINT) AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN p a ON a.lang = x.lang AND a.source = x.source
      LEFT JOIN p b ON b.lang = y.lang AND b.source = y.source AND b.term = a.term GROUP BY ALL
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part
                 ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM f)
WHERE part = 'pair' OR rank <= 50""")
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


@query("op12_license_scan")
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"), keep=["doc_id"])
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


@query("op13_conversation_repair", r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
rows0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce('=' || CAST(conv_id AS VARCHAR), '') AS key,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hit AS (SELECT *, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)),
                      lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS h FROM rows0, crc),
dam AS (SELECT key, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit WHERE h <> 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, encode(role), encode(text)) - 1 AS pos FROM dam),
f AS (SELECT key, pos, turn, role, text, left(role, 1) AS initial,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 THEN 'duplicate'
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'none' END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY key ORDER BY pos) || left(role, 1) AS neighbours FROM pos),
ins AS (SELECT * FROM (VALUES (0, '', 0, []), (1, '', 1, []), (2, '', 2, []), (3, '', 3, []), (0, 'I', 2, ['user:']),
        (1, 'I', 2, ['user:']), (3, 'I', 2, ['user:']), (2, 'I', 3, ['assistant:']), (0, 'II', 3, ['user:', 'assistant:']),
        (1, 'II', 3, ['user:', 'assistant:'])) t(st, letters, st2, lines)),
ops AS (SELECT * FROM (VALUES ('D', 0, '', 0, 3), ('D', 1, '', 1, 3), ('D', 2, '', 2, 3), ('D', 3, '', 3, 3), ('K', 0, 's', 1, 0),
        ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 3, 'u', 2, 0), ('K', 2, 'a', 3, 0), ('R', 0, '', 2, 2), ('R', 1, '', 2, 2),
        ('R', 3, '', 2, 2), ('R', 2, '', 3, 2)) t(letter, st2, needs, st3, price)),
way(key, i, st, best) AS (
  SELECT DISTINCT key, 0::BIGINT, 0, {'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]} FROM f
  UNION ALL
  SELECT w.key, w.i + 1, o.st3, min({'c': w.best.c + 2 * length(n.letters) + o.price + CASE WHEN o.letter <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END,
         'a': w.best.a || n.letters || o.letter, 'l': w.best.l || n.lines || CASE o.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
              ELSE [CASE o.st3 WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END})
  FROM way w JOIN f ON f.key = w.key AND f.pos = w.i JOIN ins n ON n.st = w.st
       JOIN ops o ON o.st2 = n.st2 AND (o.letter = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (o.letter = 'R' OR o.needs = f.initial)))
  GROUP BY w.key, w.i, o.st3),
per AS (SELECT key, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (neighbours IS NOT NULL AND neighbours NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY key),
fin AS (SELECT p.key, min({'c': w.best.c + 2 * length(n.letters), 'a': w.best.a || n.letters, 'l': w.best.l || n.lines}) AS best
        FROM per p JOIN way w ON w.key = p.key AND w.i = p.n JOIN ins n ON n.st = w.st AND n.st2 IN (0, 3) GROUP BY p.key)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM rows0) LEFT JOIN per USING (key) LEFT JOIN fin USING (key)""")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage the rows as the contract says, repair them, and give the digest of every original conversation."""
    rows = read(spark, sf_dir, "conversations")
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                       (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("_hit"))
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    damaged = rows.where("_hit != 0").select(
        "conv_id", "turn", F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
    found = conversations.digest(conversations.repair(damaged))
    every = rows.select("conv_id", conversations._key("conv_id").alias("key")).distinct()
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
            "repaired_sha256": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    return every.join(found, "key", "left").fillna(none).select("conv_id", *none)
