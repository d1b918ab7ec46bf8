"""Queries of the text operators over the driver's tables, and the same results as DuckDB SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import bpe_digest
from tidemark.llm.embedding_dedup import LEAST_COSINE, embedding_links
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.filter_audit import ORDERS, filter_audit
from tidemark.llm.jaccard_join import jaccard_links
from tidemark.llm.line_dedup import line_digest
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ppm import lm_scores
from tidemark.llm.quality import RULES, STOP_WORDS, Rule, quality_rules
from tidemark.llm.secret_scan import ACCESS, ALLOW, ASSIGN, CANDIDATE, CLASSES, HEX, WINDOW, c_log_c, entropy_limit, find_secrets, secret_digest
from tidemark.llm.source_divergence import LEAST_DOCS, TOP_TERMS, source_divergence
from tidemark.llm.toxicity import toxicity_scores
from tidemark.llm.warc import warc_round_trip


#: The mix of op6: no source is read over 1.1 times as often as the largest, three quarters of all words in all, blocks of 4,096.
MIX_EPOCHS, MIX_SHARE, MIX_BLOCK = 1.1, 0.75, 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(_table(spark, sf_dir, "documents"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return q.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & F.col("passed")).alias("kept"),
        F.array_join("failed", ",").alias("failed_rules"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(_table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), max_epochs=MIX_EPOCHS, budget_share=MIX_SHARE, block_tokens=MIX_BLOCK)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digest(_table(spark, sf_dir, "documents"), rank_path(), public_tokenizers.PATTERN)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(_table(spark, sf_dir, "documents"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_ppm": op10_ppm,
    "op2_secret_scan": op2_secret_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_source_mix": op6_source_mix,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_filter_audit": op13_filter_audit,
}

#: Fixed by the contracts, as DuckDB spells them.
_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_WORDED = r"list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


def _rule_sql(r: Rule) -> str:
    tests = [f"{r.stat} >= {r.low!r}::DOUBLE"] * (r.low is not None) + [f"{r.stat} <= {r.high!r}::DOUBLE"] * (r.high is not None)
    return f"CASE WHEN NOT ({' AND '.join(tests)}) THEN '{r.name}' END"


def _hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SUMS = ", ".join(str(c_log_c(n)) for n in range(WINDOW + 1))

ORACLES = {
    "op2_secret_scan": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        k AS (SELECT doc_id, t, unnest([{{'k': 'assign', 'o': 0, 'r': 0}}, {{'k': 'access', 'o': 1, 'r': 0}}, {{'k': 'hex', 'o': 2, 'r': 0}}, {{'k': 'cand', 'o': 3, 'r': 0}}], recursive := true) FROM d),
        f AS (SELECT doc_id, k, o, CASE o WHEN 0 THEN regexp_extract_all(t, {_quoted(ASSIGN)}) WHEN 1 THEN regexp_extract_all(t, {_quoted(ACCESS)}) WHEN 2 THEN regexp_extract_all(t, {_quoted(HEX)}) ELSE regexp_extract_all(t, {_quoted(CANDIDATE)}) END AS m,
                     CASE o WHEN 0 THEN regexp_split_to_array(t, {_quoted(ASSIGN)}) WHEN 1 THEN regexp_split_to_array(t, {_quoted(ACCESS)}) WHEN 2 THEN regexp_split_to_array(t, {_quoted(HEX)}) ELSE regexp_split_to_array(t, {_quoted(CANDIDATE)}) END AS g FROM k),
        p AS (SELECT doc_id, k, o, m[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM f, unnest(range(1, len(m) + 1)) AS u(i)),
        base AS (SELECT doc_id, k, o, s, s + length(v) AS e FROM p WHERE o < 3 AND (o > 0 OR length(regexp_extract(v, {_quoted(ASSIGN)}, 1)) >= 8)),
        q AS (SELECT doc_id, s, regexp_extract_all(v, {_quoted(ALLOW)}) AS m, regexp_split_to_array(v, {_quoted(ALLOW)}) AS g FROM p WHERE o = 3),
        c AS (SELECT doc_id, (s + list_sum(list_transform(g[1:i], lambda x: length(x))) - length(g[i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, g[i] AS v FROM q, unnest(range(1, len(g) + 1)) AS u(i) WHERE length(g[i]) >= {WINDOW}),
        h AS (SELECT doc_id, s, v, CASE {' '.join(f"WHEN regexp_full_match(v, '[{chars}]+') THEN {k}" for k, (_, chars, _) in enumerate(CLASSES))} END AS k FROM c),
        w AS (SELECT doc_id, s, k, j, string_split(substr(v, j + 1, {WINDOW}), '') AS ch FROM h, unnest(range(0, length(v) - {WINDOW - 1})) AS u(j)),
        x AS (SELECT doc_id, s, k, j FROM w WHERE list_sum(list_transform(list_distinct(ch), lambda q: ([{_SUMS}])[len(list_filter(ch, lambda y: y = q)) + 1])) <= ([{', '.join(str(entropy_limit(bits)) for _, _, bits in CLASSES)}])[k + 1]),
        y AS (SELECT *, CASE WHEN j <= lag(j) OVER (PARTITION BY doc_id, s ORDER BY j) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM x),
        z AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, s ORDER BY j) AS stretch FROM y),
        every AS (SELECT * FROM base UNION ALL SELECT doc_id, ([{', '.join(_quoted(kind) for kind, _, _ in CLASSES)}])[k + 1], k + 3, s + min(j), s + max(j) + {WINDOW} FROM z GROUP BY doc_id, s, k, stretch),
        a AS (SELECT doc_id, count(*) FILTER (o = 0) AS na, count(*) FILTER (o = 1) AS nc, count(*) FILTER (o = 2) AS nh, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS b, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o, e) AS z FROM every GROUP BY 1)
        SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(z, '') AS spans FROM d LEFT JOIN a USING (doc_id)
    """,
    "op1_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        p AS (SELECT doc_id, t, {_WORDS.format(t='t')} AS w, {_WORDED.format(t='t')} AS l FROM d),
        tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM p, unnest(range(1, len(w) - 1)) AS u(i)),
        twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        cover AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS v(o) GROUP BY 1),
        s AS (SELECT p.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '!')) AS n_marks, len(l) - len(list_distinct(l)) AS n_dup_lines,
                coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, list_filter(w, lambda x: list_contains([{_STOPS}], lower(x))) AS st,
                len(list_filter(l, lambda x: regexp_matches(x, '^\s*(?:[-*•‣]|\d+[.)])\s'))) AS n_bullets, len(list_filter(l, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ellipsis
              FROM p LEFT JOIN cover USING (doc_id)),
        r AS (SELECT *, len(list_distinct(list_transform(st, lambda x: lower(x)))) AS stop_words, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
                CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word, CASE WHEN n_words > 0 THEN n_marks / n_words ELSE 0 END AS marks_per_word,
                CASE WHEN n_words > 0 THEN len(st) / n_words ELSE 0 END AS stop_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
                CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END AS bullet_line_ratio, CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0 END AS ellipsis_line_ratio,
                CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_ratio FROM s),
        f AS (SELECT *, concat_ws(',', {', '.join(_rule_sql(x) for x in RULES)}) AS failed_rules, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
               base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
    """,
    "op3_warc": """
        WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to, true AS digest_ok FROM g
    """,
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        ), g AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op6_source_mix": rf"""
        WITH t AS (SELECT doc_id, source, len({_WORDS.format(t="coalesce(text, '')")})::BIGINT AS n_tokens FROM documents),
        s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY 1),
        sh AS (SELECT *, tokens / (SELECT sum(tokens) FROM s)::BIGINT AS share FROM s),
        a AS (SELECT min(k) / 1048576.0::DOUBLE AS a FROM range(0, 1048577) AS u(k), (SELECT max(share) / min(share) AS q FROM sh WHERE share > 0) WHERE pow(q, 1 - k / 1048576.0::DOUBLE) <= {MIX_EPOCHS}::DOUBLE),
        v AS (SELECT source, tokens, pow(share, a) / sum(pow(share, a)) OVER () AS weight, floor({MIX_SHARE}::DOUBLE * sum(tokens) OVER ())::DOUBLE AS budget FROM sh, a),
        q AS (SELECT source, tokens, weight, CASE WHEN tokens > 0 THEN floor(weight * budget)::BIGINT ELSE 0 END AS quota FROM v),
        p AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS whole, greatest(1, ceil(tokens / {MIX_BLOCK}))::BIGINT AS n_blocks FROM q),
        d AS (SELECT t.doc_id, t.source, n_tokens, weight, whole, quota - whole * tokens AS rest, {_hash_sql("'7'", "'block'", "coalesce(doc_id::VARCHAR, 'null')")} % n_blocks AS block FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source),
        b AS (SELECT source, block, sum(n_tokens) AS n FROM d GROUP BY 1, 2),
        e AS (SELECT source, block, n, sum(n) OVER (PARTITION BY source ORDER BY {_hash_sql("'7'", "coalesce(source, 'null')", "block::VARCHAR")}, block) AS ends FROM b),
        x AS (SELECT d.*, ends, ends - n AS starts FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.block = e.block),
        y AS (SELECT *, starts + sum(n_tokens) OVER (PARTITION BY source, block ORDER BY {_hash_sql("'7'", "'doc'", "coalesce(doc_id::VARCHAR, 'null')")}, doc_id) AS upto FROM x)
        SELECT doc_id, source, n_tokens, weight, block, (whole + CASE WHEN ends <= rest AND rest > 0 THEN 1 WHEN starts < rest AND ends > rest AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM y
    """,
    "op7_line_dedup": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        s AS (SELECT doc_id, i - 1 AS line_no, u.x, len({_WORDS.format(t='u.x')}) AS words FROM d, unnest(string_split(t, chr(10))) WITH ORDINALITY AS u(x, i) WHERE regexp_matches(u.x, '[^\x20\x09-\x0D]')),
        n AS (SELECT *, row_number() OVER w AS at, sum(words) OVER w AS upto FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        ahead AS (SELECT a.doc_id, a.at AS f, min(b.at) AS l FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.at >= a.at AND b.upto - a.upto + a.words >= 50 GROUP BY 1, 2),
        back AS (SELECT b.doc_id, max(a.at) AS f, b.at AS l FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.at >= a.at AND b.upto - a.upto + a.words >= 50 GROUP BY 1, 3),
        run AS (SELECT * FROM ahead UNION SELECT * FROM back),
        keyed AS (SELECT r.doc_id, r.f, r.l, string_agg(n.x, chr(10) ORDER BY n.at) AS k FROM run r JOIN n ON n.doc_id = r.doc_id AND n.at BETWEEN r.f AND r.l GROUP BY 1, 2, 3),
        later AS (SELECT doc_id, f, l FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, f) > 1),
        gone AS (SELECT DISTINCT n.doc_id, n.line_no FROM later JOIN n ON n.doc_id = later.doc_id AND n.at BETWEEN f AND l),
        g AS (SELECT doc_id, count(*) AS c, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS r, list(line_no) AS ls FROM gone GROUP BY 1)
        SELECT d.doc_id, len({_WORDED.format(t='t')})::BIGINT AS n_lines, coalesce(c, 0) AS n_removed, coalesce(r, '') AS removed,
               sha256(CASE WHEN c IS NULL THEN t ELSE array_to_string(list_filter(string_split(t, chr(10)), lambda x, i: NOT list_contains(ls, i - 1)), chr(10)) END) AS text_sha256
        FROM d LEFT JOIN g USING (doc_id)
    """,
    "op9_jaccard_join": rf"""
        WITH RECURSIVE p AS (SELECT doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        c(node, root) AS (SELECT doc_id, doc_id FROM p UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
        k AS (SELECT a, count(*) AS links FROM e GROUP BY 1)
        SELECT node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, coalesce(any_value(k.links), 0) AS n_links
        FROM c LEFT JOIN n ON n.doc_id = node LEFT JOIN k ON k.a = node GROUP BY 1
    """,
    "op11_embedding_dedup": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        ok AS (SELECT * FROM d WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        l AS (SELECT a.i AS a, b.i AS b FROM ok a JOIN ok b ON a.label = b.label AND a.i <> b.i AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {LEAST_COSINE}::DOUBLE),
        c(node, root) AS (SELECT i, vec_id FROM d UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node),
        m AS (SELECT node, min(root) AS component_id FROM c GROUP BY 1),
        n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN m ON m.node = i LEFT JOIN n ON n.a = i
    """,
    "op12_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= {LEAST_DOCS}),
        size AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
        total AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (total.n + v) AS p FROM g JOIN kept USING (lang) JOIN size USING (lang) JOIN total USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        q AS (SELECT kept.lang, kept.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 1)) // (any_value(z.n) + any_value(v)) AS q FROM kept JOIN c USING (lang, term) JOIN size USING (lang) JOIN (SELECT lang, sum(n) AS n FROM total GROUP BY 1) z USING (lang) GROUP BY 1, 2),
        pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
        every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
    """,
    "op13_filter_audit": rf"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
        k AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
                     + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
        h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM k LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
        o AS (SELECT o, s, (1 << (ascii(o[s]) - 65)) AS own, coalesce(list_sum(list_transform(range(1, s), lambda x: 1 << (ascii(o[x]) - 65))), 0)::BIGINT AS before FROM unnest([{', '.join(f"'{x}'" for x in ORDERS)}]) AS u(o), unnest(range(1, 6)) AS v(s)),
        r AS (SELECT part, o, s, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM h, o GROUP BY 1, 2, 3, 4)
        SELECT part, o AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
    """,
}
