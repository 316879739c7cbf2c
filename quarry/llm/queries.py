"""The thin queries ``opN_<name>``: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, divergence, language, licenses, mixing, prefix_trie, quality, secrets, sharding, simhash, token_counts, tokens, warc
from quarry.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """Where the public vocabulary file ``name`` is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), short=True)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"), new_path(spark, "ledger"), path="doc_id")

    def said(kinds: list[str] | None = None) -> Column:
        f = F.col("findings") if kinds is None else F.filter("findings", lambda x: x["kind"].isin(kinds))
        return F.array_join(F.transform(f, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    n = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("path").alias("doc_id"), *map(n, secrets.BASE), F.sha2(said(secrets.BASE), 256).alias("base_sha256"), said().alias("spans"), "blob")


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(read(spark, sf_dir, "pages"))
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = language.train(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), language.predict(F.col("text"), model, spark).alias("p")).select("doc_id", "held_out", "p.*")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(read(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tokens.write(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), new_path(spark, "tokens"))
    return tokens.digests(table)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    out = prefix_trie.trie(read(spark, sf_dir, "conversations"), shared=F.crc32(conv.cast("string")) % 9, base=conv - conv % 5, most=8)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(read(spark, sf_dir, "documents"))
    at, base = F.transform("base", lambda x: x["at"]), F.transform("base", lambda x: x["label"])
    said = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    found = F.transform("found", lambda x: x["label"])
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), said(base).alias("base_labels"), said(F.concat(base, found)).alias("labels"), "score"
    )


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op4_warc_salvage": op4_warc_salvage,
    "op5_language_id": op5_language_id,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_token_orc": op8_token_orc,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_license_scan": op13_license_scan,
}

#: SQL has neither a fit by expectation maximisation, nor code-point spans of matches, nor n-gram hashing, CRC-32, XXH64 or
#: the tokenizers; those queries are tested against brute force, round trips and the libraries instead.
ORACLE_SQL: dict[str, str] = {
    "op4_warc_salvage": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM g""",
    # Sources by how soon they reach twice their size; all before the first that does not are full.
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), 1, 15) AS BIGINT) AS r FROM documents),
        s AS (SELECT source, sum(size) AS ss FROM d GROUP BY source),
        w AS (SELECT source, ss, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 1.5 * sum(ss) OVER () AS t FROM s),
        o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * ss / w, source) AS k,
                     coalesce(sum(2 * ss) OVER (ORDER BY 2.0 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
                     sum(w) OVER (ORDER BY 2.0 * ss / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
        f AS (SELECT min_by(given, k) AS given, min_by(rest, k) AS rest, min(k) AS k FROM o WHERE (t - given) * w <= 2 * ss * rest),
        g AS (SELECT o.source, o.ss, CAST(CASE WHEN o.k < f.k THEN 2 * o.ss ELSE CAST(o.w * (o.t - f.given) AS DOUBLE) / f.rest END AS DOUBLE) AS target, o.t FROM o, f),
        q AS (SELECT d.*, g.ss, g.target, g.t, sum(size) OVER (PARTITION BY d.source ORDER BY r, doc_id) AS upto,
                     row_number() OVER (PARTITION BY d.source ORDER BY r, doc_id) AS n FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
        e AS (SELECT q.*, round_, CASE WHEN target > 0 THEN CAST(upto + round_ * ss AS DOUBLE) / target ELSE 0 END AS finish
              FROM q, (VALUES (0), (1)) v(round_) WHERE round_ = 0 OR target > ss),
        a AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, round_, n) - size AS ahead FROM e)
        SELECT doc_id, any_value(size) AS size, CAST(any_value(ss) AS BIGINT) AS source_size, any_value(target) AS target,
               CAST(sum(CASE WHEN 2 * ahead + size <= 2 * t THEN size ELSE 0 END) AS BIGINT) AS taken, source
        FROM a GROUP BY doc_id, source, n""",
    # Every kept term against every group, zeros and all.
    "op11_source_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        c AS (SELECT lang, source, id, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM c GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        own AS (SELECT c.lang, c.source, c.term, count(*) AS n FROM c JOIN kept USING (lang, term) GROUP BY ALL),
        gt AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
                     1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 5)) // (coalesce(gt.total, 0)::HUGEINT + 5 * l.v) AS p,
                     1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total::HUGEINT + 5 * l.v) AS q
              FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
              LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source),
        s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        every_ AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
                 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                 UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every_)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    # CRC-32 bit by bit; nodes as lists of the digests of their turns.
    "op12_prefix_trie": r"""
        WITH t AS (SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS b,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
        n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
        k AS (SELECT c, c - c % 5 AS base, n,
                     CAST(xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda a, ch:
                         list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(a, ch)), 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS BIGINT) AS h FROM n),
        v AS (SELECT k.*, least(h, coalesce(m.n, 0)) AS taken FROM k LEFT JOIN n m ON m.c = k.base),
        r AS (SELECT v.c, t.pos AS d, t.x, t.b FROM v JOIN t ON t.c = v.base AND t.pos <= v.h
              UNION ALL SELECT v.c, v.taken + t.pos - v.h, t.x, t.b FROM v JOIN t ON t.c = v.c AND t.pos > v.h),
        p AS (SELECT c, d, b, string_agg(x, ',') OVER w AS node, count(*) OVER (PARTITION BY c) AS len FROM r WINDOW w AS (PARTITION BY c ORDER BY d)
              UNION ALL SELECT v.c, 0, 0, '', (SELECT count(*) FROM r WHERE r.c = v.c) FROM v),
        g AS (SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len = d) AS ends FROM p GROUP BY d, node),
        e AS (SELECT child.*, up.node AS up, up.conv_id AS up_id FROM g child LEFT JOIN g up ON up.d = child.d - 1 AND (up.d = 0 OR starts_with(child.node, up.node || ','))),
        kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM e WHERE d > 0 GROUP BY ALL),
        f AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN kids ON kids.d = e.d AND kids.node = e.node),
        s AS (SELECT a.d, a.node, sum(CAST(z.n_children = 0 AS BIGINT)) AS n_leaves, sum((z.n_convs - 1) * z.b) AS saved FROM f a JOIN f z ON z.d >= a.d AND (a.d = 0 OR z.node = a.node OR starts_with(z.node, a.node || ',')) GROUP BY ALL)
        SELECT conv_id, CAST(f.d AS BIGINT) AS depth, up_id AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
        FROM f JOIN s ON s.d = f.d AND s.node = f.node""",
}
