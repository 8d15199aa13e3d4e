"""The queries of this subpackage over the supplied tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.llm import bpe, caps, contamination, divergence, licenses, mainhtml, ngramjoin, pii, quality, repeats, sharding, spelling, tokencount

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: for the supplied tables; whoever pseudonymises real data passes a secret
PII_KEY = "specula"
#: bytes of text that a shard may have
SHARD_BYTES = 1 << 20


@query("op2_extendible_hashing", f"""
WITH held AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash FROM documents),
levels AS (SELECT doc_id, bytes, hash, d, hash >> (60 - d) AS prefix FROM held, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS d)),
nodes AS (SELECT d, prefix, sum(bytes) AS total, min(hash) = max(hash) AS single FROM levels GROUP BY d, prefix),
leaf AS (SELECT l.doc_id, l.bytes, l.hash, min(l.d) AS depth, arg_min(n.total, l.d) AS total, arg_min(l.prefix, l.d) AS prefix
         FROM levels l JOIN nodes n USING (d, prefix) WHERE n.total <= {SHARD_BYTES} OR n.single OR l.d = 60 GROUP BY l.doc_id, l.bytes, l.hash)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 60, '0'), depth) END AS shard, depth, CAST(total AS BIGINT) AS shard_bytes,
       total > {SHARD_BYTES} AS oversized FROM leaf""")
def extendible_hashing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return sharding.shards(docs, "doc_id", F.col("size"), SHARD_BYTES).withColumnRenamed("key", "doc_id")


@query("op3_byte_bpe")
def byte_bpe(spark, folder):
    return bpe.encode(table(spark, folder, "documents"), "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN, ["doc_id"], ("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op1_feistel_pseudonyms")
def feistel_pseudonyms(spark, folder):
    return pii.pseudonymise(table(spark, folder, "documents").select("doc_id", "text"), "text", key=PII_KEY, found="n_values")


@query("op4_cap_filters", """
WITH RECURSIVE ok AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least ON least.id = e.vec_id""")
def cap_filters(spark, folder):
    found = caps.links(table(spark, folder, "embeddings"), "vec_id", "embedding", "label", 0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


@query("op5_decontamination", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(words), 13) AS size, array_to_string(words[i:i + 12], ' ') AS phrase
       FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS phrase
       FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, sizes WHERE len(words) >= size)),
hits AS (SELECT d.doc_id, d.i, d.size, b.item_id FROM dw d JOIN bw b ON d.phrase = b.phrase AND d.size = b.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def decontamination(spark, folder):
    found = contamination.match(table(spark, folder, "documents"), "text", table(spark, folder, "benchmark"), "item_id", "text", ["doc_id"])
    return contamination.contaminated(found).select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                                                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op6_license_scan")
def license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"), "text", ["doc_id"])


@query("op7_token_counts")
def token_counts(spark, folder):
    return tokencount.count(table(spark, folder, "documents"), "text", public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], 4096)


@query("op8_ngram_jaccard")
def ngram_jaccard(spark, folder):
    found = ngramjoin.components(table(spark, folder, "documents"), "doc_id", "text", n=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def quality_model(docs, labels):
    """Learned without the rows that are held out."""
    return quality.learn(docs, "doc_id", "text", labels.filter(~held_out(F.col("doc_id"))), "doc_id", "quality")


@query("op9_attention_quality")
def attention_quality(spark, folder):
    docs = table(spark, folder, "documents")
    found = quality.score(docs, "text", quality_model(docs, table(spark, folder, "labels")), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_tree_scoring")
def tree_scoring(spark, folder):
    return mainhtml.main_text(table(spark, folder, "pages"), "html", ["page_id", "url"])


@query("op12_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n, count(DISTINCT r) AS docs FROM w GROUP BY lang, source, term),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
sizes AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(s.v, 0) AS v, coalesce(s.total, 0) AS total, CAST(coalesce(t.n, 0) AS HUGEINT) AS n
           FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sizes s USING (lang)
           LEFT JOIN (SELECT lang, source, sum(c.n) AS n FROM c SEMI JOIN kept USING (lang, term) GROUP BY lang, source) t USING (lang, source)),
share AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p,
                 1 + (CAST(1000000000 AS HUGEINT) * (k.n + 2)) // (g.total + 2 * g.v) AS q
          FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM share WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""")
def source_divergence(spark, folder):
    return divergence.divergences(table(spark, folder, "documents"), "text", "lang", "source", least=10, top=10)


#: every so many runs lose a letter, so that there are variants to find
LOST_LETTER = 199


@query("op13_spelling_variants", f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i) UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
runs AS (SELECT own, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS own, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
coded AS (SELECT run, n, hex(encode(own || ':' || run)) AS code FROM runs WHERE length(run) >= 6),
drawn AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(code) // 2), lambda i: CAST('0x' || substr(code, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda x, y: xor(x >> 8, steps[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM coded, crc),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {LOST_LETTER} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM drawn)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.part UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON a.word = b.part),
about AS (SELECT word, count(*) AS n_near, max(n) AS top, arg_min(near, (-n, near)) AS near FROM near GROUP BY word),
found AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN near END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n FROM words w LEFT JOIN about USING (word)),
way(word, root, form) AS (SELECT word, word, form FROM found UNION ALL SELECT way.word, f.word, f.form FROM way JOIN found f ON f.word = way.form)
SELECT f.word, f.form, way.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM found f JOIN way ON way.word = f.word AND way.form IS NULL""")
def spelling_variants(spark, folder):
    held = spelling.words(table(spark, folder, "documents"), "doc_id", "text", letters=6, least=5, every=LOST_LETTER)
    return spelling.variants(held, ratio=5)


@query("op11_suffix_repeats")
def suffix_repeats(spark, folder):
    found = repeats.without_repeats(table(spark, folder, "documents"), "doc_id", "text", length=200, keep=None)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
