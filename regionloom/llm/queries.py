"""The registered queries of the subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


@query("op1_mixing")
def op1_mixing(spark, sf_dir):
    from regionloom.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    from regionloom.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_line_crf")
def op4_line_crf(spark, sf_dir):
    from regionloom.llm.line_crf import line_field_quality

    rest = F.crc32(F.col("__id").cast("string")) % 4
    scored = line_field_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_where=rest != 2)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", "predicted")


@query("op8_fingerprints")
def op8_fingerprints(spark, sf_dir):
    from regionloom.llm.fingerprints import edits_and_successors

    return edits_and_successors(table(spark, sf_dir, "documents"))


@query("op5_prob_minhash")
def op5_prob_minhash(spark, sf_dir):
    from regionloom.llm.prob_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_context_mixing")
def op3_context_mixing(spark, sf_dir):
    from regionloom.llm.context_mixing import context_mixing

    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    scored = context_mixing(table(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out)


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    from regionloom.llm.suffix_dedup import repeated_strings

    return repeated_strings(table(spark, sf_dir, "documents"))


@query("op7_pieces")
def op7_pieces(spark, sf_dir):
    from regionloom.llm.pieces import decode, encode

    encoded = decode(encode(table(spark, sf_dir, "documents")))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "score",
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


_W = r"[ \t-\r]"
_OP2 = rf"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS content,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
spaced AS (SELECT doc_id, line, trim(regexp_replace(content, '{_W}+', ' ', 'g')) AS s FROM lines),
masked AS (SELECT doc_id, line, s, regexp_replace(s, '[^ \t-\r]*[0-9][^ \t-\r]*', '<*>', 'g') AS m FROM spaced WHERE s <> ''),
words AS (SELECT doc_id, line, s, m, string_split(m, ' ') AS w FROM masked),
parsed AS (SELECT doc_id, line, w,
    CASE WHEN len(w) >= 3 AND trim(replace(m, '<*>', '')) <> '' THEN concat_ws(' ', len(w), w[1], w[2], w[3]) END AS leaf,
    CASE WHEN len(w) >= 3 AND trim(replace(m, '<*>', '')) <> '' THEN m ELSE chr(10) || s END AS own FROM words),
known AS (SELECT DISTINCT leaf, own, w FROM parsed WHERE leaf IS NOT NULL),
sizes AS (SELECT leaf, count(*) AS size FROM known GROUP BY leaf HAVING count(*) > 1),
places AS (SELECT leaf, own, unnest(range(len(w))) AS place, unnest(w) AS word FROM known SEMI JOIN sizes USING (leaf)),
constant AS (SELECT leaf, place, word FROM places JOIN sizes USING (leaf) GROUP BY leaf, place, word, size HAVING 2 * count(*) > size),
wide AS (SELECT leaf, count(*) AS n, count(*) FILTER (place >= 3) AS behind, count(*) FILTER (place >= 3 AND word <> '<*>') AS texts FROM constant GROUP BY leaf),
fitting AS (SELECT p.leaf, p.own FROM places p JOIN constant c ON p.leaf = c.leaf AND p.place = c.place AND p.word = c.word
  JOIN wide ON wide.leaf = p.leaf JOIN known k ON k.leaf = p.leaf AND k.own = p.own
  GROUP BY p.leaf, p.own, wide.n, wide.behind, wide.texts, len(k.w) HAVING count(*) = wide.n AND wide.behind >= 0.7 * (len(k.w) - 3) AND wide.texts > 0),
templates AS (SELECT doc_id, line, CASE WHEN f.own IS NULL THEN 'o' || p.own ELSE 'l' || p.leaf END AS template
  FROM parsed p LEFT JOIN fitting f ON f.own = p.own AND f.leaf = p.leaf),
recurring AS (SELECT template, min(doc_id) AS first FROM templates GROUP BY template HAVING count(DISTINCT doc_id) >= 2),
gone AS (SELECT doc_id, line FROM templates JOIN recurring USING (template) WHERE doc_id <> first),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_dropped,
  coalesce(string_agg(content, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS kept
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept
"""


@query("op2_line_templates", _OP2)
def op2_line_templates(spark, sf_dir):
    from regionloom.llm.line_templates import without_recurring_lines

    kept = without_recurring_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), digest.alias("kept_sha256"))


def _op9() -> str:
    from regionloom.llm.license_texts import NESTED, TEMPLATES
    from regionloom.llm.licenses import CONTAINED, SPDX, SPDX_PATTERN, marked_runs, size_class

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def row(i, t):
        marks = "[" + ", ".join("[" + ", ".join(map(text, runs)) + "]" for runs in marked_runs(t)) + "]"
        return f"({i}, {text(t.license)}, {text(t.text)}, {size_class(t.text)}, {marks}::VARCHAR[][])"

    values = ", ".join(row(i, t) for i, t in enumerate(TEMPLATES))
    rank = "CASE license " + " ".join(f"WHEN {text(name)} THEN {i}" for i, name in enumerate(NESTED)) + " END"
    runs = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))"
    pattern = SPDX_PATTERN
    return rf"""
WITH known AS (SELECT number, license, size_class, required, list_distinct({runs}) AS template FROM (
  SELECT *, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {values}) AS v(number, license, t, size_class, required))),
held AS (SELECT doc_id, {runs} AS s FROM (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents) WHERE len(w) >= 5),
near AS (SELECT doc_id, s, number, license, size_class, template, required FROM held, known WHERE list_has_any(s, template)),
windows AS (SELECT doc_id, license, template, required, a, s[a + 1:a + 2 * size_class] AS win FROM (
  SELECT *, unnest(range(0, len(s), size_class)) AS a FROM near)),
matched AS (SELECT doc_id, license, len(list_intersect(win, template)) / CAST(len(template) AS DOUBLE) AS share,
  a + list_position(list_transform(win, lambda x: list_contains(template, x)), true) - 1 AS first FROM windows
  WHERE len(list_filter(required, lambda r: NOT list_has_any(win, r))) = 0),
tags AS (SELECT doc_id, len(regexp_extract_all(lower(string_split(text, '{SPDX}')[1]), '[\p{{L}}\p{{N}}]+')) AS first,
  unnest(regexp_extract_all(text, '{pattern}', 1)) AS tag FROM documents WHERE contains(text, '{SPDX}')),
named AS (SELECT doc_id, first, unnest(regexp_extract_all(tag, '[A-Za-z0-9.+-]+')) AS license FROM tags),
found AS (SELECT doc_id, license, share, first FROM matched WHERE share >= {CONTAINED}
  UNION ALL SELECT doc_id, license, 1.0::DOUBLE, first FROM named WHERE license NOT IN ('OR', 'AND', 'WITH')),
grouped AS (SELECT doc_id, license, max(share) AS containment, min(first) AS first_word, count(*) AS n_windows, {rank} AS rank FROM found GROUP BY doc_id, license)
SELECT doc_id, license, containment, first_word, n_windows FROM (SELECT *, max(rank) OVER (PARTITION BY doc_id) AS best FROM grouped)
WHERE rank IS NULL OR rank = best
"""


@query("op9_licenses", _op9())
def op9_licenses(spark, sf_dir):
    from regionloom.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


_OP13 = rf"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
failing AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int AS fails
  FROM words JOIN first USING (t) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(string_split('ABCDE', '')) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
places AS (SELECT filter_order, step, unnest(range(1, 6)) AS place FROM orders, (SELECT unnest(range(1, 6)) AS step)),
steps AS (SELECT filter_order, step,
    sum(CASE WHEN place < step THEN 1 << (ascii(filter_order[place]) - 65) ELSE 0 END)::int AS earlier,
    sum(CASE WHEN place = step THEN 1 << (ascii(filter_order[place]) - 65) ELSE 0 END)::int AS own
  FROM places GROUP BY filter_order, step),
counted AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN fails & (earlier | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & own > 0 AND fails & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & own > 0 AND fails & earlier > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & own > 0 AND fails & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & own > 0 AND fails & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant,
  unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM counted
"""


@query("op13_filter_audit", _OP13)
def op13_filter_audit(spark, sf_dir):
    from regionloom.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OP11 = r"""
WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(
    strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL),
crc_bits AS (SELECT b::bigint AS b, list_reduce(list_prepend(b::bigint, range(8)),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS e FROM range(256) AS t(b)),
crc AS (SELECT list(e ORDER BY b) AS table_ FROM crc_bits),
convs AS (SELECT DISTINCT c, c - c % 5 AS base FROM own),
heads AS (SELECT c, base, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(c::varchar) + 1),
    lambda i: ascii(substring(c::varchar, i::int, 1))::bigint)), lambda x, y: xor(table_[(xor(x, y) & 255) + 1], x >> 8)), 4294967295::bigint) % 9 AS h FROM convs, crc),
turns AS (SELECT h.c, o.place, 0 AS part, o.said FROM heads h JOIN own o ON o.c = h.base AND o.place <= h.h
  UNION ALL SELECT h.c, o.place, 1, o.said FROM heads h JOIN own o ON o.c = h.c AND o.place > h.h),
said AS (SELECT c, list(said ORDER BY part, place) AS s FROM turns GROUP BY c),
sequences AS (SELECT c, coalesce(s, []) AS s FROM convs LEFT JOIN said USING (c)),
prefixes AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM sequences),
members AS (SELECT c, d, s[1:d] AS p, d = len(s) AS ends, CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS bytes FROM prefixes),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM members GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
kinds AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k ON k.p = n.p),
below AS (SELECT v.p[1:u] AS p, sum((n_children = 0)::int) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
  FROM kinds v, unnest(range(0, d + 1)) AS x(u) GROUP BY 1)
SELECT k.conv_id, k.d::bigint AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children::bigint AS n_children,
  b.n_leaves::bigint AS n_leaves, b.saved_tokens::bigint AS saved_tokens, k.ends_sha256
FROM kinds k JOIN below b ON b.p = k.p LEFT JOIN nodes p ON k.d > 0 AND p.d = k.d - 1 AND p.p = k.p[1:k.d - 1]
"""


@query("op11_prefix_trie", _OP11)
def op11_prefix_trie(spark, sf_dir):
    from regionloom.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


_OP12 = """
WITH RECURSIVE valid AS (SELECT vec_id, embedding::double[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(m.least_id, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(m.least_id, v.vec_id)) AS kept
FROM embeddings v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
LEFT JOIN (SELECT a, min(b) AS least_id FROM reached GROUP BY a) m ON m.a = v.vec_id
"""


@query("op12_near_vectors", _OP12)
def op12_near_vectors(spark, sf_dir):
    from regionloom.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))
