"""The numbered queries: each applies its operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark.llm import divergence, extraction, langid, lines, lm, mixing, packing, pii, quality, sharding, simhash, topk, whitening
from daymark.llm.common import documents, remainder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op5_line_dedup",
    f"""
    WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    numbered AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
    keyed AS (SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM numbered),
    frequent AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    judged AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last_doc AS gone FROM keyed k LEFT JOIN frequent f USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op5_line_dedup(spark, sf_dir):
    kept = lines.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


POWER = 0.7


@query(
    "op2_poisson_mix",
    f"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS source FROM documents),
    s AS (SELECT source, count(*) AS n FROM d GROUP BY 1),
    r AS (SELECT source, pow(n::DOUBLE, {POWER}) / sum(pow(n::DOUBLE, {POWER})) OVER () * sum(n) OVER () / n AS rate FROM s),
    m AS (SELECT *, CAST(ceil(rate / 50.0) AS INT) AS draws, rate / ceil(rate / 50.0) AS mean FROM r),
    k AS (SELECT *, unnest(range(0, CAST(floor(mean + 12 * sqrt(mean) + 20) AS INT) + 1)) AS k FROM m),
    p AS (SELECT *, exp(-mean + k * ln(mean) - sum(ln(greatest(k, 1))) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
    c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM p),
    u AS (SELECT d.*, m.draws, m.rate, CAST(('0x' || substr(md5('mix:' || doc_id || ':' || j), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN m USING (source), LATERAL (SELECT unnest(range(1, m.draws + 1)) AS j)),
    n AS (SELECT u.doc_id, u.source, u.rate, CAST(count(c.k) AS BIGINT) AS n_copies
      FROM u LEFT JOIN c ON c.source = u.source AND u.u >= c.below GROUP BY ALL),
    x AS (SELECT doc_id, source, rate, n_copies, unnest(range(0, n_copies)) AS copy FROM n)
    SELECT doc_id, source, copy, round(rate, 9) AS rate, md5('mix-order:' || doc_id || ':' || copy) AS shuffle_key FROM x
    """,
)
def op2_poisson_mix(spark, sf_dir):
    mixed = mixing.mix(documents(spark, sf_dir), power=POWER)
    return mixed.select("doc_id", "source", "copy", F.round("rate", 9).alias("rate"), "shuffle_key")


def digested(pieces):
    """Pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    packed = packing.pack(digested(packing.tokenise(documents(spark, sf_dir), added=True)))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op7_language_mixture")
def op7_language_mixture(spark, sf_dir):
    docs = documents(spark, sf_dir)
    judged = langid.predict(docs.select("doc_id", "text"), langid.train(langid.learned(docs)))
    return judged.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "shares", "unexplained")


@query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    found = quality.judged(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))


@query(
    "op4_top_k_search",
    """
    WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
      FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op4_top_k_search(spark, sf_dir):
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


@query("op6_pii_anchors")
def op6_pii_anchors(spark, sf_dir):
    found = pii.find(documents(spark, sf_dir))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@query("op10_main_text")
def op10_main_text(spark, sf_dir):
    found = extraction.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_recurrent_lm")
def op9_recurrent_lm(spark, sf_dir):
    found = lm.score_learned(documents(spark, sf_dir), lm.learning())
    return found.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


WEIGHT = "1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * v)"
APART = "CAST(((p - q) * (p - q)) // (p + q) AS BIGINT)"


@query(
    "op11_source_divergence",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
    t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[A-Za-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM d),
    k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
    c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
    g AS (SELECT DISTINCT lang, source FROM d),
    full_ AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
    w AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n, sum(c) OVER (PARTITION BY lang, term) AS lc, sum(c) OVER (PARTITION BY lang) AS ln FROM full_ JOIN v USING (lang)),
    p AS (SELECT lang, source, term, c, {WEIGHT.format(c='c', n='n')} AS p, {WEIGHT.format(c='lc', n='ln')} AS q FROM w),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(CAST(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p) AS BIGINT)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, {APART} FROM p WHERE c > 0 AND p > q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM x)
    SELECT * FROM r WHERE part = 'pair' OR rank <= 10
    """,
)
def op11_source_divergence(spark, sf_dir):
    return divergence.audit(documents(spark, sf_dir))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query(
    "op12_histogram_shards",
    """
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size FROM documents),
    k AS (SELECT doc_id, size, text, substr(md5(text), 1, 15) AS a, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS b,
      size > (SELECT sum(size) FROM d) // (24 * 16) AS large FROM d),
    big AS (SELECT *, row_number() OVER (ORDER BY size DESC, a, b) AS i FROM k WHERE large),
    deal AS (SELECT 0::BIGINT AS i, list_transform(range(24), lambda x: 0::BIGINT) AS held, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS at
      UNION ALL SELECT big.i, list_transform(range(1, 25), lambda s: held[s] + CASE WHEN s = list_position(held, list_min(held)) THEN big.size ELSE 0 END),
        big.doc_id, CAST(list_position(held, list_min(held)) AS BIGINT) FROM deal JOIN big ON big.i = deal.i + 1),
    held AS (SELECT held FROM deal ORDER BY i DESC LIMIT 1),
    full_ AS (SELECT s, held[s] AS h FROM held, (SELECT unnest(range(1, 25)) AS s)),
    rest AS (SELECT coalesce(sum(size), 0) AS rest FROM k WHERE NOT large),
    ranked AS (SELECT h, row_number() OVER (ORDER BY h) AS k, sum(h) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM full_),
    level_ AS (SELECT (rest + upto) // k AS level FROM ranked, rest WHERE (rest + upto) // k >= h ORDER BY k DESC LIMIT 1),
    ends AS (SELECT s, sum(greatest(0, level - h)) OVER (ORDER BY s) AS c FROM full_, level_),
    small AS (SELECT *, sum(size) OVER (ORDER BY a, b) AS upto FROM k WHERE NOT large),
    cut AS (SELECT small.*, CAST((SELECT count(*) FROM ends WHERE s < 24 AND 2 * c < 2 * upto - size) AS INT) AS shard FROM small),
    placed AS (SELECT k.doc_id, k.size, k.text, CAST(deal.at - 1 AS INT) AS shard, 0 AS kind, deal.i AS i, '' AS a, '' AS b FROM deal JOIN k USING (doc_id)
      UNION ALL SELECT doc_id, size, text, shard, 1, 0, a, b FROM cut),
    steps AS (SELECT b, 0 AS n, b AS v FROM (SELECT unnest(range(256)) AS b)
      UNION ALL SELECT b, n + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE n < 8),
    lookup AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE n = 8)
    SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32, 'bytes' AS law, shard,
      row_number() OVER (PARTITION BY shard ORDER BY kind, i, a, b) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM placed, lookup
    """,
)
def op12_histogram_shards(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sharding.shard(sharding.measured(docs).drop("text"))
