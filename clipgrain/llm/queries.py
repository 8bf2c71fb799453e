"""The corpus operators as queries over the given tables, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgrain.llm import best_fit, collocations, exact_dedup, licenses, merkle_manifest, mixing, packing, topk, url_filter, warc
from clipgrain.llm.common import table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MAX_REPETITION = 1.5


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC archives, audited against a replica in which some records are damaged.

    Damage is a function of the page id: a changed byte, a cut payload, or a lost record.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    flipped = F.overlay("html", F.lit("·"), F.greatest(F.floor(F.length("html") / 2).cast("int"), F.lit(1)), F.lit(1))
    cut = F.expr("substring(html, 1, length(html) div 2)")
    html = F.when(F.col("page_id") % 97 == 13, flipped).when(F.col("page_id") % 211 == 7, cut).otherwise(F.col("html"))
    replica = pages.where(F.col("page_id") % 503 != 3).withColumn("html", html)
    return warc.audit(warc.records(pages), warc.records(replica))


def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipgrain.llm import ngram_join as op

    return op.components(table(spark, sf_dir, "documents"), words=3, similarity=(90, 100))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipgrain.llm import suffix_dedup as op

    return op.remove_repeats(table(spark, sf_dir, "documents"), length=100)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipgrain.llm import quality as op

    return op.classify(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality,
        "op2_warc_fixity": warc_fixity,
        "op3_ngram_join": ngram_join,
        "op4_suffix_dedup": suffix_dedup,
        "op5_license_scan": lambda s, d: licenses.scan(table(s, d, "documents"), runs=True),
        "op6_exact_dedup": lambda s, d: exact_dedup.group_exact(table(s, d, "documents")),
        "op7_url_filter": lambda s, d: url_filter.filter_urls(table(s, d, "pages"), s.createDataFrame(URL_RULES, "host string, path string, verdict string")),
        "op8_packing": lambda s, d: packing.pack(table(s, d, "documents"), tokenizer_path()),
        "op9_exact_topk": lambda s, d: topk.top_k(table(s, d, "embeddings"), F.col("vec_id") % 20 == 0),
        "op10_source_mixing": lambda s, d: mixing.mix(table(s, d, "documents"), max_repetition=MAX_REPETITION),
        "op11_merkle_manifest": lambda s, d: merkle_manifest.proofs(table(s, d, "documents"), merkle_manifest.lowered_text()).drop("lang"),
        "op12_best_fit": lambda s, d: best_fit.pack(table(s, d, "documents"), tokenizer_path()),
        "op13_collocations": lambda s, d: collocations.collocations(table(s, d, "documents")),
        "pipeline": pipeline,
    }


_WS = "[ \\t\\n\\x0B\\f\\r]+"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_license_scan() -> str:
    templates = ", ".join(f"({i}, {_quote(name)}, {_quote(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    normal = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
    WITH t AS (SELECT template, license, {pairs.format("w")} AS have FROM
               (SELECT *, string_split({normal.format("body")}, ' ') AS w FROM (VALUES {templates}) v(template, license, body))),
    lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    units AS (SELECT * FROM lines UNION ALL SELECT doc_id, 0, text FROM documents),
    own AS (SELECT doc_id, line, {pairs.format("w")} AS own FROM (SELECT doc_id, line, string_split({normal.format("body")}, ' ') AS w FROM units)),
    scored AS (SELECT doc_id, line, license, template, 2.0 * len(list_intersect(own, have)) / (len(own) + len(have)) AS dice FROM own, t WHERE len(own) > 0)
    SELECT doc_id, CAST(line AS INTEGER) AS line, license, template, round(dice, 6) AS dice FROM scored WHERE dice >= {licenses.THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, template) = 1"""


def _sql_mix(limit: float) -> str:
    key = "coalesce('s' || source, 'n')"
    order = f"md5('{mixing.SEED}:' || {{}} || ':' || name)"
    return f"""
    WITH r AS (SELECT doc_id, source, {key} AS key, coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, ''))) AS name, CAST(greatest(len(list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda w: w <> '')), 1) AS BIGINT) AS tokens FROM documents),
    s AS (SELECT key, CAST(sum(tokens) AS BIGINT) AS have, CAST(sum(sum(tokens)) OVER () AS DOUBLE) AS total FROM r GROUP BY key),
    a AS (SELECT CASE WHEN max(have) = min(have) THEN 0.0 ELSE greatest(0.0, floor((1 - ln({limit}) / ln(CAST(max(have) AS DOUBLE) / min(have))) * 1e6 + 1e-3) / 1e6) END AS a FROM s),
    p AS (SELECT key, have, pow(have / total, a.a) AS power FROM s, a),
    q AS (SELECT key, have, greatest(have, CAST(round(power * (SELECT max(have / power) FROM p)) AS BIGINT)) AS quota FROM p),
    plan AS (SELECT key, quota // have AS passes, quota % have AS rest, CAST(quota AS DOUBLE) / have AS times FROM q),
    o AS (SELECT r.*, passes, rest, times, {order.format("passes")} AS ord FROM r JOIN plan USING (key)),
    c AS (SELECT *, CASE WHEN rest > 0 AND sum(tokens) OVER (PARTITION BY key ORDER BY ord, name, tokens) <= rest THEN 1 ELSE 0 END AS extra FROM o),
    d AS (SELECT doc_id, source, name, tokens, times, unnest(range(0, CAST(passes + extra AS BIGINT))) AS epoch FROM c)
    SELECT doc_id, source, tokens, CAST(epoch AS INTEGER) AS epoch,
           CAST(least(floor((epoch + CAST(('0x' || substr({order.format("epoch")}, 1, 8)) AS BIGINT) / 4294967296.0) / times * {mixing.BLOCKS}), {mixing.BLOCKS - 1}) AS INTEGER) AS block FROM d"""


def _sql_warc() -> str:
    def side(html: str, where: str) -> str:
        record = f"'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(body, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(body, '') || chr(13) || chr(10) || chr(13) || chr(10)"
        return f"SELECT page_id, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest FROM (SELECT page_id, {record} AS rec FROM (SELECT page_id, url, {html} AS body FROM pages WHERE {where}))"

    half = "CAST(greatest(length(html) // 2, 1) AS BIGINT)"
    damaged = f"CASE WHEN page_id % 97 = 13 THEN substr(html, 1, {half} - 1) || chr(183) || substr(html, {half} + 1) WHEN page_id % 211 = 7 THEN substr(html, 1, length(html) // 2) ELSE html END"
    size = warc.ARCHIVE_RECORDS // 4
    return f"""
    WITH one AS ({side("html", "true")}), two AS ({side(damaged, "page_id % 503 <> 3")}),
    m AS (SELECT *, page_id // {size} AS archive, row_number() OVER w - 1 AS ordinal, CAST(sum(length) OVER w AS BIGINT) - length AS "offset" FROM one WINDOW w AS (PARTITION BY page_id // {size} ORDER BY page_id))
    SELECT CAST(m.archive AS BIGINT) AS archive, CAST(ordinal AS INTEGER) AS ordinal, "offset", m.length, page_id AS record_id,
           CASE WHEN two.digest IS NULL THEN 'missing' WHEN two.length = m.length THEN 'payload' ELSE 'length' END AS kind, m.digest AS digest_first, two.digest AS digest_second
    FROM m LEFT JOIN two USING (page_id) WHERE two.digest IS DISTINCT FROM m.digest"""


def _sql_ngram_join(n: int, num: int, den: int) -> str:
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    return f"""
    WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {shingle})) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM t),
    n AS (SELECT doc_id, len(g) AS n FROM s), e AS (SELECT doc_id, unnest(g) AS x FROM s),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE {den} * k >= {num} * (p.n + q.n - k)),
    u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
    SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m.b, n.doc_id)) AS component_id FROM n LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = n.doc_id"""


def _sql_suffix_dedup(length: int) -> str:
    return f"""
    WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    v AS (SELECT doc_id, o, row_number() OVER (PARTITION BY y ORDER BY doc_id, o) AS nth FROM (SELECT doc_id, o, substr(x, 2 * o + 1, {2 * length}) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {length - 1})) AS o FROM h))),
    i AS (SELECT doc_id, o, CASE WHEN o <= lag(o) OVER w + {length} THEN 0 ELSE 1 END AS new FROM v WHERE nth > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY o)),
    g AS (SELECT doc_id, o, sum(new) OVER (PARTITION BY doc_id ORDER BY o) AS g FROM i),
    p AS (SELECT doc_id, min(o) AS s, max(o) + {length} AS e FROM g GROUP BY doc_id, g),
    q AS (SELECT p.doc_id, s, e, substr(x, 2 * coalesce(lag(e) OVER w, 0) + 1, 2 * (s - coalesce(lag(e) OVER w, 0))) AS piece FROM p JOIN h USING (doc_id) WINDOW w AS (PARTITION BY p.doc_id ORDER BY s)),
    k AS (SELECT doc_id, string_agg(piece, '' ORDER BY s) AS k, max(e) AS e, count(*) AS n, sum(e - s) AS r FROM q GROUP BY doc_id)
    SELECT h.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, '') || substr(x, 2 * coalesce(e, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN k USING (doc_id)"""


def _sql_levels(name: str, nodes: str, levels: int) -> str:
    """Nodes (g, r, h) hashed level by level: each level as (g, r, h, many, before, after)."""
    parts, source = [], nodes
    for k in range(levels + 1):
        near = "ROWS BETWEEN {} {} {}".format
        parts.append(f"""{name}{k} AS (SELECT g, r, h, count(*) OVER (PARTITION BY g) > 1 AS many, coalesce(string_agg(h, '') OVER (PARTITION BY g, r // 8 ORDER BY r {near("UNBOUNDED PRECEDING", "AND", "1 PRECEDING")}), '') AS before,
            coalesce(string_agg(h, '') OVER (PARTITION BY g, r // 8 ORDER BY r {near("1 FOLLOWING", "AND", "UNBOUNDED FOLLOWING")}), '') AS after FROM ({source}))""")
        source = f"SELECT g, r // 8 AS r, CASE WHEN bool_or(many) THEN sha256(string_agg(h, '' ORDER BY r)) ELSE max(h) END AS h FROM {name}{k} GROUP BY ALL"
    return ", ".join(parts)


def _sql_manifest(levels: int = 7, tops: int = 3) -> str:
    """The trees unrolled: enough levels for 8**levels documents a language and 8**tops languages."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END".format
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {field(text)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"
    steps = [*[f"a{k}" for k in range(levels)], *[f"t{k}" for k in range(tops)]]
    joins = " ".join(f"JOIN a{k} ON a{k}.g = l.g AND a{k}.r = l.r // {8**k}" for k in range(levels + 1)) + " JOIN place p ON p.g = l.g " + " ".join(f"JOIN t{k} ON t{k}.r = p.r // {8**k}" for k in range(tops + 1))
    columns = ", ".join(f"{s}.many AS m{i}, {s}.before AS b{i}, {s}.after AS e{i}" for i, s in enumerate(steps))
    folds, last = [], "claimed"
    for i in range(len(steps)):
        folds.append(f"f{i} AS (SELECT *, CASE WHEN m{i} THEN sha256(b{i} || {last} || e{i}) ELSE {last} END AS c{i} FROM {'paths' if not i else f'f{i - 1}'})")
        last = f"c{i}"
    proof = " || ".join(f"CASE WHEN m{i} THEN b{i} || e{i} ELSE '' END" for i in range(len(steps)))
    return f"""
    WITH l0 AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE 's' || lang END AS g, {leaf("text")} AS h, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS claimed FROM documents),
    l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS r FROM l0), {_sql_levels("a", "SELECT g, r, h FROM l", levels)},
    place AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS r FROM a{levels}), {_sql_levels("t", "SELECT 0 AS g, r, h FROM place", tops)},
    paths AS (SELECT doc_id, l.h AS leaf, claimed, p.h AS subroot, t{tops}.h AS root, {columns} FROM l {joins}), {", ".join(folds)}
    SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {last} AS folded_root, {last} = root AS verified FROM f{len(steps) - 1}"""


def _sql_collocations() -> str:
    words = "list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '')"
    phrase = "array_to_string(list_slice(w, i, i + {} - 1), ' ')".format
    a, b = collocations.SCALE, collocations.COVERED
    score = f"CAST(CAST({a} AS HUGEINT) * a * a // (CAST({{}} AS HUGEINT) * {{}}) AS BIGINT)".format
    return f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
    w AS (SELECT lang, {words} AS w FROM p), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
    x AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {phrase("k")})) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM x GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
    c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    two AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r FROM c JOIN f l ON l.lang = c.lang AND l.k = 1 AND l.phrase = w[1] JOIN f r ON r.lang = c.lang AND r.k = 1 AND r.phrase = w[2] WHERE c.k = 2),
    three AS (SELECT c.lang, c.phrase, c.a, w[1] || ' ' || w[2] AS head, w[2] || ' ' || w[3] AS tail, l1.a AS l1, r1.a AS r1, l2.a AS l2, r2.a AS r2 FROM c
        JOIN f l1 ON l1.lang = c.lang AND l1.k = 1 AND l1.phrase = w[1] JOIN f r1 ON r1.lang = c.lang AND r1.k = 2 AND r1.phrase = w[2] || ' ' || w[3]
        JOIN f l2 ON l2.lang = c.lang AND l2.k = 2 AND l2.phrase = w[1] || ' ' || w[2] JOIN f r2 ON r2.lang = c.lang AND r2.k = 1 AND r2.phrase = w[3] WHERE c.k = 3),
    cover AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, head AS phrase, a FROM three UNION ALL SELECT lang, tail, a FROM three) GROUP BY ALL),
    s AS (SELECT two.lang, two.phrase, two.a, l, r, {score("l", "r").replace("* a * a", "* two.a * two.a")} AS score FROM two LEFT JOIN cover USING (lang, phrase) WHERE cover.a IS NULL OR 100 * cover.a < {b} * two.a
        UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM (SELECT *, {score("l1", "r1")} AS s1, {score("l2", "r2")} AS s2 FROM three))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s JOIN total USING (lang) QUALIFY rank <= {collocations.TOP}"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"({_quote(h)}, {_quote(p)}, {_quote(v)})" for h, p, v in URL_RULES)
    return {
        "op2_warc_fixity": _sql_warc(),
        "op3_ngram_join": _sql_ngram_join(3, 90, 100),
        "op4_suffix_dedup": _sql_suffix_dedup(100),
        "op5_license_scan": _sql_license_scan(),
        "op6_exact_dedup": f"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
        "op7_url_filter": f"""
            WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                              coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
            r(rhost, rpath, verdict) AS (VALUES {rules}),
            f AS (SELECT page_id, rhost || rpath AS rule, verdict FROM p JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
                  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) = 1)
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)""",
        "op9_exact_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
            SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) DESC, c.vec_id) AS INTEGER) AS rank,
                   c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20""",
        "op10_source_mixing": _sql_mix(MAX_REPETITION),
        "op11_merkle_manifest": _sql_manifest(),
        "op13_collocations": _sql_collocations(),
    }
