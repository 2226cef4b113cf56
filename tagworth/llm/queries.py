"""One query per operator, over the whole given tables, with its checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, cover_tree, exact_dedup, fill_middle, license_scan, line_dedup, lm_scoring, mixing, near_dedup, quality_kn, quality_rules, sentencepiece_viterbi, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# White space as the contracts define it, for the checking engine.
WS = r"[\x20\x09-\x0D]"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_line_dedup",
    rf"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
    keyed AS (
        SELECT doc_id, pos, line, {LOWER.format(f"regexp_replace(regexp_replace(line, '^{WS}+', ''), '{WS}+$', '')")} AS key FROM lines),
    common AS (
        SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (
        SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped FROM keyed k LEFT JOIN common c ON k.key = c.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op10_exact_dedup",
    rf"""
    WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM norm WINDOW w AS (PARTITION BY t)""",
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    def fold(v: str) -> str:
        return f"({v}) - ({v}) % (1::BIGINT << greatest(length(bin({v})) - 6, 0))"

    rules = quality_rules.RULES
    n = len(rules)
    of = {f: "CASE rule " + " ".join(f"WHEN {i} THEN {getattr(r, f)}" for i, r in enumerate(rules)) + " END" for f in ("percent", "times", "floor")}
    low = "rule IN (" + ", ".join(str(i) for i, r in enumerate(rules) if r.low) + ")"
    return rf"""
    WITH d AS (
        SELECT doc_id, lang, source, coalesce(text, '') AS t,
               list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents),
    win AS (
        SELECT doc_id, array_to_string(list_slice(w, i, i + 7), ' ') AS key, i
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d) x),
    twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS c FROM win) x WHERE c > 1),
    rep AS (
        SELECT doc_id, sum(least(8, i - before)) AS n FROM (
            SELECT doc_id, i, lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) x GROUP BY doc_id),
    m AS (
        SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
               len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[A-Z]{{2,}}'))::BIGINT AS n_shouts,
               len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
               coalesce(rep.n, 0)::BIGINT AS n_repeat_words
        FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
    f AS (
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               [n_symbols * 1000 // greatest(n_words, 1), n_shouts * 1000 // greatest(n_words, 1), n_dup_lines * 1000 // greatest(n_lines, 1),
                n_repeat_words * 1000 // greatest(n_words, 1), word_chars * 100 // greatest(n_words, 1)] AS vals FROM m),
    sk AS (
        SELECT lang, source, rule, {fold('v')} AS v, count(*) AS n
        FROM (SELECT lang, source, unnest(range({n})) AS rule, unnest(vals) AS v FROM f WHERE NOT base_failed) x GROUP BY ALL),
    lv AS (
        SELECT 2 AS level, lang, source, rule, v, n FROM sk
        UNION ALL SELECT 1, lang, NULL, rule, v, sum(n) FROM sk GROUP BY lang, rule, v
        UNION ALL SELECT 0, NULL, NULL, rule, v, sum(n) FROM sk GROUP BY rule, v),
    cum AS (
        SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY v) AS upto,
               sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM lv),
    q AS (
        SELECT level, lang, source, rule, max(total) AS total, min(v) FILTER (WHERE upto * 100 >= total * 50) AS mid,
               min(v) FILTER (WHERE upto * 100 >= total * ({of["percent"]})) AS up, min(v) FILTER (WHERE upto * 100 >= total * (100 - {of["percent"]})) AS down
        FROM cum GROUP BY level, lang, source, rule),
    b AS (
        SELECT *, CASE WHEN {low} THEN down - greatest({of["floor"]}, {of["times"]} * (mid - down)) ELSE -1 END AS lo,
               up + greatest({of["floor"]}, {of["times"]} * (up - mid)) AS hi
        FROM q WHERE level = 0 OR (total >= 50 AND total * (100 - {of["percent"]}) >= {100 * quality_rules.TAIL_DOCS} AND up > mid)),
    g AS (
        SELECT k.lang, k.source, b.rule, max(b.level) AS limit_level, arg_max(b.lo, b.level) AS lo, arg_max(b.hi, b.level) AS hi
        FROM (SELECT DISTINCT lang, source FROM sk) k JOIN b
          ON b.level = 0 OR (b.level = 1 AND b.lang IS NOT DISTINCT FROM k.lang)
          OR (b.level = 2 AND b.lang IS NOT DISTINCT FROM k.lang AND b.source IS NOT DISTINCT FROM k.source) GROUP BY ALL)
    SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, any_value(base_failed) AS base_failed,
           NOT any_value(base_failed) AND coalesce(bool_and(vals[rule + 1] BETWEEN lo AND hi), false) AS kept
    FROM f LEFT JOIN g ON f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source GROUP BY ALL"""


@query("op8_quality_rules", _quality_sql())
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _license_sql() -> str:
    def words(text: str) -> str:
        return f"list_filter(regexp_split_to_array({LOWER.format(text)}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

    values = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in license_scan.NOTICES)
    return rf"""
    WITH t AS (SELECT license, {words('text')} AS w FROM (VALUES {values}) x(license, text)),
    ts AS (SELECT DISTINCT license, array_to_string(list_slice(w, i, i + 4), ' ') AS key
           FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM t) x),
    tn AS (SELECT license, count(*) AS n, CASE WHEN count(*) <= 1 THEN 1 ELSE 1 << length(bin(count(*) - 1)) END AS stride FROM ts GROUP BY license),
    d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
    ds AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS key
           FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) >= 5) x),
    hits AS (SELECT doc_id, license, i, ds.key, n, stride FROM ds JOIN ts ON ds.key = ts.key JOIN tn USING (license)),
    win AS (SELECT doc_id, license, n, stride, key, i // stride AS a FROM hits
            UNION ALL SELECT doc_id, license, n, stride, key, i // stride - 1 FROM hits WHERE i // stride >= 1),
    got AS (SELECT doc_id, license, n, a * stride AS start, count(DISTINCT key) AS found FROM win GROUP BY ALL)
    SELECT doc_id, license, n AS n_template, max(found) AS n_found, max(found) / n AS share, min(start)::BIGINT AS first_window, count(*) AS n_windows
    FROM got WHERE found >= 0.75 * n GROUP BY doc_id, license, n"""


@query("op4_license_scan", _license_sql())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


SWEEPS, ROUNDS, KEEP = 8, 8, 0.5
LANG_SHARES = {"en": 0.45, "fr": 0.2, "de": 0.2, "es": 0.15}
TOPIC_SHARES = {"general": 0.8, "table": 0.1, "contact": 0.06, "legal": 0.04}


def mix_sql(docs: str = "documents") -> str:
    """Common table expressions of the mix; ``mixed`` is the last."""

    def shares(dim: str, table: dict) -> str:
        case = f"CASE {dim} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " ELSE 0.1::DOUBLE END"
        return f"SELECT {dim} AS value, {case} / sum({case}) OVER () AS share FROM (SELECT DISTINCT {dim} FROM cells WHERE tokens > 0) x"

    topics = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(coalesce(text, ''), '{w}')" for w in ws) + f" THEN '{t}'" for t, ws in mixing.TOPICS
    ) + " ELSE 'general' END"
    parts = [
        f"marks AS (SELECT *, {topics} AS topic, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> ''))::BIGINT AS tokens FROM {docs})",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM marks GROUP BY ALL)",
        "total AS (SELECT sum(tokens)::DOUBLE AS tok FROM cells)",
        "t_source AS MATERIALIZED (SELECT value, m / sum(m) OVER () AS share FROM (SELECT source AS value, pow(sum(tokens)::DOUBLE, 0.5::DOUBLE) AS m FROM cells GROUP BY source) x WHERE m > 0)",
        f"t_lang AS MATERIALIZED ({shares('lang', LANG_SHARES)})",
        f"t_topic AS MATERIALIZED ({shares('topic', TOPIC_SHARES)})",
        "w0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS w FROM cells WHERE tokens > 0)",
    ]
    n = 0
    for _ in range(SWEEPS):
        for dim in mixing.DIMS:
            parts.append(
                f"w{n + 1} AS MATERIALIZED (SELECT c.* EXCLUDE (w), c.w * (t.share * (SELECT tok FROM total) / s.s) AS w FROM w{n} c "
                f"JOIN (SELECT {dim} AS v, sum(w) AS s FROM w{n} GROUP BY {dim}) s ON c.{dim} IS NOT DISTINCT FROM s.v "
                f"JOIN t_{dim} t ON c.{dim} IS NOT DISTINCT FROM t.value)"
            )
            n += 1
    parts.append("l0 AS (SELECT 0::DOUBLE AS scale)")
    for i in range(ROUNDS):
        full = f"w * (SELECT scale FROM l{i}) >= tokens"
        parts.append(
            f"l{i + 1} AS MATERIALIZED (SELECT greatest((SELECT scale FROM l{i}), coalesce(({KEEP}::DOUBLE * (SELECT tok FROM total) - "
            f"coalesce(sum(tokens) FILTER (WHERE {full}), 0)) / sum(w) FILTER (WHERE NOT ({full})), 0)) AS scale FROM w{n})"
        )
    parts.append(
        f"mixed AS (SELECT m.*, coalesce(c.w / c.tokens, 0) AS rate, least(1, coalesce(c.w / c.tokens, 0) * (SELECT scale FROM l{ROUNDS})) AS probability, "
        "('0x' || substr(md5(coalesce(m.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496 AS u FROM marks m "
        f"LEFT JOIN w{n} c ON m.source IS NOT DISTINCT FROM c.source AND m.lang IS NOT DISTINCT FROM c.lang AND m.topic = c.topic)"
    )
    return ",\n".join(parts)


@query(
    "op3_mixing",
    f"WITH {mix_sql()}\nSELECT doc_id, source, lang, topic, tokens, round(rate, 6) AS rate, round(probability, 6) AS probability, u < probability AS selected FROM mixed",
)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(
        table(spark, sf_dir, "documents"), alpha=0.5, lang_shares=LANG_SHARES, topic_shares=TOPIC_SHARES, rest=0.1, keep=KEEP, sweeps=SWEEPS
    )
    return out.select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("rate", 6).alias("rate"), F.round("probability", 6).alias("probability"), "selected"
    )


@query(
    "op7_near_dedup",
    rf"""
    WITH RECURSIVE d AS (
        SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '{WS}+'), lambda x: x <> '') AS w FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS key
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) x),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS in_both FROM s a JOIN s b ON a.key = b.key AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * in_both >= 75 * (x.n + y.n - in_both)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
    FROM reach r LEFT JOIN n ON r.a = n.doc_id GROUP BY r.a""",
)
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_dedup(table(spark, sf_dir, "documents"), percent=75)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query(
    "op5_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages),
    r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, n AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
               ((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM r""",
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archived(table(spark, sf_dir, "pages"), min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_kn.quality_scores(docs, labels).select("doc_id", "lang", "perplexity", "z", "kept")


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_viterbi.encoded_and_checked(docs).select("doc_id", "n_tokens", "ids", "round_trip")


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


@query(
    "op13_fill_middle",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
    u AS (
        SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
               ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
    c AS (
        SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (
        SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid,
               coalesce(array_to_string(w[b + 1:n], ''), '') AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
    FROM p""",
)
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    )


@query(
    "op11_phrases",
    rf"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
    g AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS m) x WHERE len(w) >= m),
    f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
    c AS (
        SELECT * FROM f x WHERE m >= 2 AND NOT EXISTS (
            SELECT 1 FROM f y WHERE y.lang = x.lang AND y.m > x.m AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
    k AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM c),
    s AS (
        SELECT k.lang, k.phrase, k.a, k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * k.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
        FROM k JOIN n USING (lang) JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ')
        JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:k.m], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000""",
)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), max_words=5, min_count=100, top=2000)


@query(
    "op12_vector_links",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e,
               embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
               AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT r.a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
    FROM reach r LEFT JOIN n ON r.a = n.a GROUP BY r.a""",
)
def op12_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.vector_links(table(spark, sf_dir, "embeddings"), least=0.9)
