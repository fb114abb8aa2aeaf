"""SQL of the registered queries, as DuckDB runs it."""

from __future__ import annotations

from citeloom.functions import text


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def decoded(c: str) -> str:
    """SQL that takes entities off a text which has only these."""
    for entity, plain in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&#x27;": "''", "&amp;": "&"}.items():
        c = f"replace({c}, '{entity}', '{plain}')"
    return c


def clean_title(c: str) -> str:
    """SQL of text.clean_title for texts with no entities but a few."""
    c = decoded(f"regexp_replace({c}, '<[^>]*>', '', 'g')")
    return rf"regexp_replace(regexp_replace({c}, '\.(\p{{L}})', '. \1', 'g'), '{SPACES}', ' ', 'g')"


def unaccent(c: str) -> str:
    c = f"translate({c}, '{text.ACCENTED}', '{text.PLAIN}')"
    for letter, plain in text.LIGATURES.items():
        c = f"replace({c}, '{letter}', '{plain}')"
    return c


#: White space, as DuckDB's patterns have it.
SPACES = r"[\x0C\n\r\t\x{00A0} \x{1680}\x{180E}\x{2028}\x{2029}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"
STOPS = _in(text.NAME_STOPS)


def alignment(a: str, b: str) -> str:
    """SQL of similarity.alignment_score: rows of the matrix are folded one by one, the best score so far in front."""
    cell = f"greatest(0, acc[y[1] + 1] + CASE WHEN upper({a}[x[1]]) = upper({b}[y[1]]) THEN 3 ELSE -1 END, acc[y[1] + 2] - 3, r[len(r)] - 3)"
    row = f"list_reduce(list_prepend([list_max(acc), 0], list_transform(range(1, length({b}) + 1), lambda j: [j::int])), lambda r, y: list_append(r, {cell}))"
    fold = f"list_reduce(list_prepend(list_transform(range(length({b}) + 2), lambda z: 0), list_transform(range(1, length({a}) + 1), lambda i: [i::int])), lambda acc, x: {row})"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) > 0 AND length({b}) > 0 THEN list_max({fold})::double / (3 * least(length({a}), length({b}))) END"


def same_token(a: str, b: str) -> str:
    return f"(starts_with({a}, {b}) OR starts_with({b}, {a}) OR ({a}, {b}) IN (('boln', 'boletin'), ('boletin', 'boln'), ('qld', 'queensland'), ('queensland', 'qld')) OR levenshtein({a}, {b}) <= 1)"


def token_lcs(a: str, b: str) -> str:
    """SQL of similarity.token_lcs for two lists of tokens."""
    cell = f"CASE WHEN {same_token(f'{a}[p[1]]', f'{b}[q[1]]')} THEN acc[q[1]] + 1 ELSE greatest(acc[q[1] + 1], r[len(r)]) END"
    row = f"list_reduce(list_prepend([0], list_transform(range(1, len({b}) + 1), lambda j: [j::int])), lambda r, q: list_append(r, {cell}))"
    fold = f"list_reduce(list_prepend(list_transform(range(len({b}) + 1), lambda z: 0), list_transform(range(1, len({a}) + 1), lambda i: [i::int])), lambda acc, p: {row})"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 OR {a} IS NULL OR {b} IS NULL THEN 0.0 ELSE 2 * ({fold})[len({b}) + 1]::double / (len({a}) + len({b})) END"


#: Relations that the queries derive (see relations).
WO = """wo AS (
  SELECT 'urn:o:' || lpad(o_orderkey::varchar, 12, '0') AS _id, CASE o_orderstatus WHEN 'F' THEN 'article-journal' WHEN 'O' THEN 'book' ELSE 'chapter' END AS type,
         'Order ' || o_orderpriority AS title, c_mktsegment AS container_title, month(o_orderdate)::bigint AS volume, o_orderstatus AS issue, o_custkey AS first,
         o_custkey + o_orderkey % 20 AS last, c_name AS family, c_mktsegment AS given, year(o_orderdate)::bigint AS y, month(o_orderdate)::bigint AS m, day(o_orderdate)::bigint AS d,
         o_orderpriority AS source, min('urn:o:' || lpad(o_orderkey::varchar, 12, '0')) OVER (PARTITION BY year(o_orderdate), month(o_orderdate), o_custkey) AS cluster
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
WD = """wd AS (
  SELECT 'doc:' || lpad(doc_id::varchar, 12, '0') AS _id, text AS title, source, lang, n_chars, md5(text) AS doi,
         min('doc:' || lpad(doc_id::varchar, 12, '0')) OVER (PARTITION BY md5(text)) AS cluster
  FROM documents
)"""
#: Part names hold nothing that normalisation changes but case, and words in capitals (types), which it splits.
NK = rf"""raw AS (
  SELECT p_partkey AS id, p_name || ' ' || p_type AS raw, p_brand AS issn FROM part
), nk AS (
  SELECT id, raw, issn, trim(lower(regexp_replace(CASE WHEN regexp_full_match(raw, '[A-Z\s"]+') THEN raw ELSE
         array_to_string(list_transform(string_split(raw, ' '), lambda w: CASE WHEN regexp_full_match(w, '[A-Z]{{2,}}') THEN array_to_string(string_split(w, ''), ' ') ELSE w END), ' ') END, '[^a-zA-Z0-9 ]', '', 'g'))) AS normalized
  FROM raw
), nt AS (
  SELECT *, list_filter(string_split(normalized, ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+')
         AND w NOT IN ({STOPS})) AS t
  FROM nk
), names AS (
  SELECT id, raw, issn, normalized, array_to_string(t, ' ') AS tokens, '' AS series, array_to_string(list_transform(t, lambda w: w[:3]), ' ') AS key_a,
         array_to_string(list_sort(list_transform(t, lambda w: w[:3])), ' ') AS key_b, array_to_string(list_transform(t, lambda w: w[:3])[:3], ' ') AS key_c,
         array_to_string(list_transform(t, lambda w: w[:1]), '') AS key_d
  FROM nt
)"""
#: Names from pages' titles and parts, with their keys, and the runs they form.
NT = rf"""titles AS (
  SELECT page_id AS id, trim({decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS raw, nullif(regexp_extract(url, '://([^/?#]+)', 1), '') AS issn FROM pages
  UNION ALL SELECT p_partkey + 1000000000, concat_ws(' ', CASE WHEN p_partkey % 2 = 0 THEN x || ' ' || y ELSE y || ' ' || x END, x || 'ish', y || 'ics', x || y, y || x, lower(p_type)), p_brand FROM (SELECT *, split_part(p_name, ' ', 1) AS x, split_part(p_name, ' ', 2) AS y FROM part)
), bare AS (
  SELECT id, raw, issn, regexp_replace(regexp_replace({decoded("regexp_replace(raw, '<[^>]*>', '', 'g')")}, '(?i)[d|l][''|’]', '', 'g'), '\.(\p{{L}})', '. \1', 'g') AS t FROM titles
), parted AS (
  SELECT *, CASE WHEN regexp_full_match(t, '[\p{{Lu}}\s"]+') THEN t ELSE
         array_to_string(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), lambda w: CASE WHEN NOT regexp_full_match(w, '[A-Z]{{2,}}') THEN w WHEN length(w) > 20 THEN array_to_string(list_append(string_split(w[:20], ''), w[21:]), ' ') ELSE array_to_string(string_split(w, ''), ' ') END), '') END AS u FROM bare
), nn AS (
  SELECT id, raw, issn, trim(lower(regexp_replace({unaccent(f"regexp_replace(u, '{SPACES}', ' ', 'g')")}, '[^a-zA-Z0-9 ]', '', 'g'))) AS normalized FROM parted
), nw AS (
  SELECT *, list_filter(string_split(normalized, ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({STOPS})) AS t FROM nn
), names AS (
  SELECT id, raw, issn, normalized, t, array_to_string(list_transform(t, lambda w: w[:3]), ' ') AS key_a, array_to_string(list_sort(list_transform(t, lambda w: w[:3])), ' ') AS key_b,
         array_to_string(list_transform(t, lambda w: w[:3])[:3], ' ') AS key_c
  FROM nw
)"""
RUNS = rf"""{NT}, ahead AS (
  SELECT *, lag(t) OVER (ORDER BY key_a, normalized, id) AS b FROM names WHERE key_a <> ''
), likes AS (
  SELECT b, t, {token_lcs('b', 't')} AS lcs FROM (SELECT DISTINCT b, t FROM ahead)
), broken AS (
  SELECT ahead.*, CASE WHEN lcs < 0.5 THEN 1 ELSE 0 END AS k FROM ahead JOIN likes ON ahead.t = likes.t AND ahead.b IS NOT DISTINCT FROM likes.b
), runs AS (
  SELECT id, raw, issn, normalized, t, key_b, key_c, sum(k) OVER (ORDER BY key_a, normalized, id ROWS UNBOUNDED PRECEDING) AS c FROM broken
  UNION ALL SELECT id, raw, issn, normalized, t, key_b, key_c, 1000000 + row_number() OVER () FROM names WHERE key_a = ''
)"""
TOLD = "min(id) AS least, count(*) AS n, min(normalized) AS first, max(normalized) AS last"


def _union(most: int, issn: bool = False) -> str:
    """Clusters of runs, merged by the likeness of their representatives in blocks of up to so many, or by ISSN."""
    linked = " UNION ALL SELECT min(c) OVER (PARTITION BY issn), c FROM runs WHERE issn IS NOT NULL" if issn else ""
    return rf"""{RUNS}, reps AS (
  SELECT DISTINCT ON (c) c, t, key_b, key_c FROM runs ORDER BY c, len(t) DESC, id
), blocks AS (
  SELECT *, count(*) OVER (PARTITION BY kind, key) AS size FROM (SELECT c, t, 'b' AS kind, key_b AS key FROM reps UNION ALL SELECT c, t, 'c', key_c FROM reps) WHERE key <> ''
), pairs AS (
  SELECT DISTINCT x.c AS a, y.c AS b, x.t AS ta, y.t AS tb FROM blocks x JOIN blocks y ON x.kind = y.kind AND x.key = y.key AND x.c < y.c WHERE x.size <= {most}
), links AS (
  SELECT a, b FROM pairs WHERE {token_lcs('ta', 'tb')} >= 0.85{linked}
), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach AS (SELECT DISTINCT c AS s, c AS t FROM runs UNION SELECT reach.s, ways.b FROM reach JOIN ways ON reach.t = ways.a), merged AS (SELECT s, min(t) AS m FROM reach GROUP BY 1)"""


KC = NK + ", kc AS (SELECT *, min(id) OVER (PARTITION BY key_a) AS cluster_id FROM names)"

#: Pairs of works from orders in a block, and whether their fields are alike; titles and containers, of which there are a few, are aligned once.
COMPARED = rf"""{WO}, v AS (SELECT DISTINCT unnest([title, container_title]) AS raw FROM wo), n AS (SELECT raw, lower(regexp_replace(raw, '[^a-zA-Z0-9 ]', '', 'g')) AS v FROM v),
 al AS (SELECT x.raw AS one, y.raw AS two, ({alignment('x.v', 'y.v')} > 0.8)::int AS alike FROM n x, n y),
 q AS (SELECT p._id AS a, q._id AS b, p.title AS ta, q.title AS tb, p.container_title AS ca, q.container_title AS cb, (p.issue = q.issue)::int AS i, (p.last = q.last)::int AS g, (p.m = q.m)::int AS m, (p.d = q.d)::int AS d
   FROM wo p JOIN wo q ON p.y = q.y AND p.volume = q.volume AND p.first = q.first AND p._id < q._id),
 p AS (SELECT q.*, x.alike AS t, y.alike AS c FROM q JOIN al x ON x.one = ta AND x.two = tb JOIN al y ON y.one = ca AND y.two = cb)"""

ORACLES: dict[str, str] = {
    "stats_works_clusters": f"WITH {WD} SELECT 'works' AS name, count(*) AS n FROM wd UNION ALL SELECT 'clusters', count(*) FROM wd WHERE _id = cluster",
    "doi_index": f"WITH {WD} SELECT doi, count(*) AS n FROM wd WHERE doi IS NOT NULL GROUP BY 1",
    "doi_block_pairs": f"WITH {WD} SELECT x._id AS a, y._id AS b FROM wd x JOIN wd y ON x.doi = y.doi AND x._id < y._id",
    "hash_index": f"WITH {WO} SELECT _id, y AS year, volume, first AS page_first FROM wo",
    "hash_block_pairs": f"WITH {WO} SELECT p._id AS a, q._id AS b FROM wo p JOIN wo q ON p.y = q.y AND p.volume = q.volume AND p.first = q.first AND p._id < q._id",
    "letter_counts": f"WITH {WO} SELECT upper(container_title[1]) AS letter, count(*) AS n FROM wo GROUP BY 1",
    "letter_name_counts": f"WITH {WO} SELECT upper(container_title[1]) AS letter, container_title AS name, count(*) AS n FROM wo GROUP BY 1, 2",
    "container_year_page": f"WITH {WO} SELECT _id, container_title AS container, y AS year, first::varchar AS spage FROM wo",
    "cluster_index": f"WITH {WO} SELECT cluster, _id FROM wo",
    "family_letters": f"WITH {WO} SELECT upper(family[1]) AS letter, count(*) AS n FROM wo GROUP BY 1",
    "family_names": f"WITH {WO} SELECT upper(family[1]) AS letter, family, count(*) AS n FROM wo GROUP BY 1, 2",
    "author_letter_rollup": f"WITH {WO} SELECT upper(family[1]) AS letter, family, count(*)::bigint AS n FROM wo GROUP BY 1, 2 UNION ALL SELECT upper(family[1]), NULL, count(*) FROM wo GROUP BY 1",
    "family_year": f"WITH {WO} SELECT family, y AS year, count(*) AS n FROM wo GROUP BY 1, 2",
    "years": f"WITH {WO} SELECT y AS year, count(*) AS n FROM wo GROUP BY 1",
    "title_counts": f"WITH {WO} SELECT title AS value, count(*) AS n FROM wo GROUP BY 1",
    "container_counts": f"WITH {WO} SELECT container_title AS value, count(*) AS n FROM wo GROUP BY 1",
    "family_given": f"WITH {WO} SELECT family, given, count(*) AS n FROM wo GROUP BY 1, 2",
    "nonletter_containers": f"WITH {WO}, v AS (SELECT CASE WHEN issue = 'F' THEN first || '-' || last ELSE container_title END AS value FROM wo) SELECT value[1] AS lead, value FROM v WHERE length(value) > 0 AND lower(value[1]) = upper(value[1])",
    "nonletter_leads": f"WITH {WD} SELECT substr(title, 1, 1) AS lead, title AS value FROM wd WHERE length(title) > 0 AND lower(substr(title, 1, 1)) = upper(substr(title, 1, 1)) AND substr(title, 1, 1) <> 'ß'",
    "nonletter_words": f"WITH {WD}, v AS (SELECT DISTINCT unnest(string_split(title, ' ')) AS value FROM wd) SELECT substr(value, 1, 1) AS lead, value FROM v WHERE length(value) > 0 AND lower(substr(value, 1, 1)) = upper(substr(value, 1, 1)) AND substr(value, 1, 1) <> 'ß'",
    "source_counts": f"WITH {WO} SELECT source, count(*) AS n FROM wo GROUP BY 1",
    "volumes_in_year": f"WITH {WO} SELECT DISTINCT y AS year, volume FROM wo",
    "works_envelope": f"WITH {WO} SELECT y AS outer, cluster, arg_min(_id, ((_id <> cluster)::int)::varchar || _id) AS _id, count(*) AS cluster_size FROM wo GROUP BY 1, 2".replace(" AS outer", ' AS "outer"'),
    "volume_envelope": f"WITH {WO} SELECT first AS \"outer\", cluster, arg_min(_id, ((_id <> cluster)::int)::varchar || _id) AS _id, count(*) AS cluster_size FROM wo WHERE y = 1996 AND volume = 3 GROUP BY 1, 2",
    "family_envelope": f"WITH {WO} SELECT y AS \"outer\", cluster, arg_min(_id, ((_id <> cluster)::int)::varchar || _id) AS _id, count(*) AS cluster_size FROM wo WHERE family = 'Customer#000000007' GROUP BY 1, 2",
    "container_works": f"WITH {WO} SELECT y AS \"outer\", cluster, arg_min(_id, ((_id <> cluster)::int)::varchar || lpad(first::varchar, 20, '0') || _id) AS _id, count(*) AS cluster_size FROM wo WHERE container_title IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2",
    "cluster_members": f"WITH {WD} SELECT cluster, string_agg(_id, ',' ORDER BY _id) AS members FROM wd GROUP BY 1",
    "tier_ladder_pairs": f"""WITH {WD}, k AS (SELECT *, regexp_replace(source, '[^0-9]', '', 'g') AS vol, count(*) OVER (PARTITION BY doi) AS nd FROM wd),
 h AS (SELECT *, max((nd = 1)::int) OVER (PARTITION BY vol, n_chars) AS idle FROM k WHERE vol <> '' AND n_chars IS NOT NULL)
 SELECT a, b, min(tier)::int AS tier FROM (
   SELECT x._id AS a, y._id AS b, 1 AS tier FROM k x JOIN k y ON x.doi = y.doi AND x._id < y._id
   UNION ALL SELECT x._id, y._id, 2 FROM h x JOIN h y ON x.vol = y.vol AND x.n_chars = y.n_chars AND x._id < y._id WHERE x.idle = 1
 ) GROUP BY 1, 2""",
    "work_clusters": f"WITH {WD} SELECT _id, cluster FROM wd",
    "asserted_clusters": f"""WITH RECURSIVE {WO}, f AS (SELECT first AS c, min(_id) AS i FROM wo GROUP BY 1),
 e AS (SELECT p._id AS a, q._id AS b FROM wo p JOIN wo q ON p.y = q.y AND p.volume = q.volume AND p.first = q.first AND p._id < q._id AND p.issue <> q.issue
       UNION ALL SELECT x.i, y.i FROM f x JOIN f y ON x.c = y.c - 1 WHERE x.c % 10 = 0),
 both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach AS (SELECT _id AS s, _id AS t FROM wo UNION SELECT reach.s, both_.b FROM reach JOIN both_ ON reach.t = both_.a)
 SELECT s AS _id, min(t) AS cluster FROM reach GROUP BY 1""",
    "feature_vectors_exact": f"""WITH {COMPARED} SELECT a, b, concat_ws(',', '1,0', t, 1 - t, c, 1 - c, '1,0', i, 1 - i, g, 1 - g, '1,0', m, 1 - m, d, 1 - d, '0,0') AS features FROM p""",
    "match_decisions": f"""WITH {COMPARED} SELECT a, b, (2 + t + c + i + g)::int AS score, (4 - t - c - i - g)::int AS diff, 2 + t + c + i + g >= 3 AND t + c + i + g = 4 AS match FROM p""",
    "levenshtein_feature": """WITH p AS (SELECT DISTINCT p_name AS n FROM part)
 SELECT x.n AS a, y.n AS b, levenshtein(lower(x.n), lower(y.n))::int AS distance, round(1 - levenshtein(lower(x.n), lower(y.n)) / greatest(length(x.n), length(y.n)), 4) AS similarity, CASE WHEN 1 - levenshtein(lower(x.n), lower(y.n)) / greatest(length(x.n), length(y.n)) > 0.9 THEN '1,0' ELSE '0,1' END AS bits
 FROM p x JOIN p y ON string_split(x.n, ' ')[1] = string_split(y.n, ' ')[1] AND x.n < y.n""",
    "comparison_log_last5": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
 SELECT conv_id, string_agg(turn::varchar || ':' || role, ',' ORDER BY turn) AS log FROM r WHERE k <= 5 GROUP BY 1""",
    "queue_head_global": """WITH s AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1)
 SELECT c_custkey AS _id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS visited FROM customer LEFT JOIN s ON user_id = c_custkey ORDER BY visited NULLS FIRST, c_custkey LIMIT 25""",
    "queue_head_by_scope": """WITH s AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1), q AS (SELECT c_custkey AS _id, c_mktsegment AS scope, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS visited FROM customer LEFT JOIN s ON user_id = c_custkey)
 SELECT _id, scope, visited, row_number() OVER (PARTITION BY scope ORDER BY visited NULLS FIRST, _id)::int AS place FROM q QUALIFY place <= 5""",
    "queue_status": f"""WITH {WO}, q AS (SELECT _id, cluster, CASE WHEN d > 3 THEN concat_ws('-', y, lpad(m::varchar, 2, '0'), lpad(d::varchar, 2, '0')) END AS visited FROM wo)
 SELECT _id, visited, _id = cluster AS own, (SELECT count(*) FROM q) AS total FROM q ORDER BY visited NULLS FIRST, _id LIMIT 5""",
    "drain_pass": f"WITH {WO} SELECT _id FROM wo WHERE first <> 7",
    "cited_by": "SELECT l_partkey::varchar AS cluster, 'https://doi.org/' || l_orderkey::varchar AS cited_by FROM lineitem",
    "citation_counts": "SELECT l_partkey::varchar AS cluster, count(*) AS n, count(DISTINCT l_orderkey) AS \"distinct\" FROM lineitem GROUP BY 1",
    "consensus_belief": """WITH v AS (SELECT l_partkey, l_returnflag AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_returnflag) AS i FROM lineitem),
 u AS (SELECT l_partkey, v, min(i) AS f FROM v GROUP BY 1, 2),
 g AS (SELECT l_partkey, list(v ORDER BY f) AS vals FROM u GROUP BY 1),
 b AS (SELECT v.l_partkey, any_value(g.vals) AS vals, count(*) AS n_votes,
              list(list_transform(g.vals, lambda x: (CASE WHEN x = v.v THEN 0.8::double WHEN len(g.vals) > 1 THEN (1 - 0.8::double) / (len(g.vals) - 1) ELSE 0.0::double END)) ORDER BY i) AS steps
       FROM v JOIN g ON v.l_partkey = g.l_partkey GROUP BY v.l_partkey),
 e AS (SELECT *, list_reduce(steps, lambda acc, s: list_transform(list_zip(acc, s), lambda z: round((z[1] * z[2] / list_sum(list_transform(list_zip(acc, s), lambda w: w[1] * w[2])))::decimal(18, 10), 2)::double)) AS belief FROM b)
 SELECT l_partkey, vals[list_position(belief, list_max(belief))] AS winner, len(vals)::int AS n_values, n_votes::int AS n_votes FROM e""",
    "title_keys": f"WITH {NK} SELECT id, raw, normalized, tokens, series, key_a, key_b, key_c, key_d FROM names",
    "series_keys": """SELECT doc_id AS id, 'annals ' || source || ' museum' AS tokens, 'n s; ser ' || (doc_id % 12)::varchar AS series, 'ann ' || source[:3] || ' mus' AS key_a,
 'ann ' || source[:3] || ' mus' AS key_c, 'a' || source[1] || 'm' AS key_d FROM documents""",
    "tokens_normalised": rf"""WITH n AS (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace({unaccent(clean_title('text'))}, '^\s+', ''), '\s+$', ''), '[^a-zA-Z0-9 ]', '', 'g')) AS title FROM documents)
 SELECT doc_id, title, array_to_string(list_filter(string_split(title, ' '), lambda w: w <> '' AND w NOT IN ({STOPS})), ' ') AS tokens FROM n""",
    "slugs": r"""WITH r AS (SELECT DISTINCT p_name || ' ' || p_type AS raw FROM part), s AS (SELECT raw, trim(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(repeat(raw, 5)), '[^a-z0-9]+', '-', 'g'), '-') AS l FROM r)
 SELECT raw, CASE WHEN length(slug) > 80 THEN slug[:80] || '-' || md5(raw)[:6] ELSE slug END AS slug, CASE WHEN length(l) > 80 THEN l[:80] || '-' || md5(repeat(raw, 5))[:6] ELSE l END AS long_slug FROM s""",
    "issn_must_link": f"""WITH RECURSIVE {KC}, c AS (SELECT DISTINCT issn, cluster_id FROM kc), h AS (SELECT *, min(cluster_id) OVER (PARTITION BY issn) AS hub FROM c),
 e AS (SELECT hub AS a, cluster_id AS b FROM h UNION SELECT cluster_id, hub FROM h), reach AS (SELECT DISTINCT cluster_id AS s, cluster_id AS t FROM kc UNION SELECT reach.s, e.b FROM reach JOIN e ON reach.t = e.a),
 m AS (SELECT s, min(t) AS new FROM reach GROUP BY 1) SELECT id, new AS cluster_id FROM kc JOIN m ON s = cluster_id""",
    "cluster_stats": f"WITH {KC}, n AS (SELECT cluster_id, count(*) AS n FROM kc GROUP BY 1) SELECT sum(n)::bigint AS total, count(*) AS clusters, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1) AS multi FROM n",
    "largest_clusters": f"WITH {KC} SELECT cluster_id, count(*) AS n, arg_min(normalized, lpad((100000 - length(normalized))::varchar, 6, '0') || normalized) AS name FROM kc GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 12",
    "issn_purity": f"WITH {KC}, i AS (SELECT issn, count(*) AS n, count(DISTINCT cluster_id) AS k FROM kc GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS issns, count(*) FILTER (k = 1) AS pure FROM i",
    "over_merge": f"""WITH {KC}, i AS (SELECT issn, count(*) AS n, count(DISTINCT cluster_id) AS k FROM kc GROUP BY 1 HAVING count(*) > 1), o AS (SELECT cluster_id FROM kc GROUP BY 1 HAVING count(DISTINCT issn) > 1)
 SELECT count(*) AS journals, count(*) FILTER (k = 1) AS pure, (SELECT count(*) FROM o) AS over_merged FROM i""",
    "journal_groups": f"""WITH RECURSIVE {NK}, s AS (SELECT id, issn, normalized FROM names), e AS (SELECT DISTINCT x.issn AS a, y.issn AS b FROM s x JOIN s y ON x.normalized = y.normalized),
 reach AS (SELECT DISTINCT issn AS s, issn AS t FROM s UNION SELECT reach.s, e.b FROM reach JOIN e ON reach.t = e.a), m AS (SELECT s, min(t) AS journal FROM reach GROUP BY 1)
 SELECT id, journal FROM s JOIN m ON m.s = s.issn""",
    "cluster_spellings": f"WITH {KC} SELECT cluster_id, raw, count(*) AS n, max(issn) AS issn FROM kc GROUP BY 1, 2",
    "container_docs": f"""WITH {KC}, v AS (SELECT cluster_id, raw, count(*) AS n, max(issn) AS issn FROM kc GROUP BY 1, 2),
 d AS (SELECT cluster_id, first(raw ORDER BY n DESC, length(raw) DESC, raw) AS name, string_agg(raw, '|' ORDER BY n DESC, raw) AS variants, array_to_string(list_sort(list_distinct(list(issn))), '|') AS ISSN FROM v GROUP BY 1),
 b AS (SELECT *, 'container:' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM d),
 k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY cluster_id) AS k FROM b)
 SELECT cluster_id, CASE WHEN k = 1 THEN base ELSE base || '-' || k::varchar END AS _id, name, variants, ISSN, false AS junk FROM k""",
    "curation_absorb": f"""WITH {KC}, v AS (SELECT DISTINCT cluster_id, raw FROM kc), c AS (SELECT DISTINCT raw FROM kc WHERE id % 97 = 0)
 SELECT cluster_id, count(c.raw) AS claimed, count(*) AS size FROM v LEFT JOIN c USING (raw) GROUP BY 1 HAVING count(c.raw) > 0""",
    "review_sheet": f"""WITH {RUNS}, v AS (SELECT c AS cluster_id, raw, count(*) AS n, max(issn) AS issn FROM runs WHERE c < 1000000 GROUP BY 1, 2), z AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS size FROM v),
 p AS (SELECT c AS cluster_id, first(raw ORDER BY length(normalized) DESC, normalized, raw) AS rep FROM runs GROUP BY 1),
 r AS (SELECT z.*, rep, dense_rank() OVER (ORDER BY (rep = '')::int, rep, z.cluster_id) AS sheet, row_number() OVER (PARTITION BY z.cluster_id ORDER BY (raw <> rep)::int, n DESC, raw) AS place FROM z JOIN p ON p.cluster_id = z.cluster_id WHERE size >= 2)
 SELECT sheet, place::int AS place, raw, n, issn, CASE WHEN place > 1 THEN '+' ELSE '' END AS flag, (sheet % 2)::int AS band FROM r""",
    "runs_and_breaks": f"WITH {RUNS} SELECT {TOLD} FROM runs GROUP BY c",
    "block_union": f"WITH RECURSIVE {_union(600)} SELECT {TOLD} FROM runs JOIN merged ON s = c GROUP BY m",
    "block_union_uncapped": f"WITH RECURSIVE {_union(1 << 60)} SELECT {TOLD} FROM runs JOIN merged ON s = c GROUP BY m",
    "union_stats": f"WITH RECURSIVE {_union(600, True)}, n AS (SELECT m, count(*) AS n FROM runs JOIN merged ON s = c GROUP BY m) SELECT sum(n)::bigint AS total, count(*) AS clusters, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1) AS multi FROM n",
    "runs_report": f"""WITH {NT}, d AS (SELECT DISTINCT normalized, t, key_a FROM names WHERE key_a <> '' ORDER BY key_a, normalized LIMIT 150),
 l AS (SELECT *, lag(t) OVER (ORDER BY key_a, normalized) AS b, coalesce(lag(key_a) OVER (ORDER BY key_a, normalized), '') AS k FROM d)
 SELECT normalized, round({token_lcs('b', 't')}, 4) AS lcs, round(len(list_filter(range(1, least(length(k), length(key_a)) + 1), lambda i: k[:i] = key_a[:i])) / greatest(length(k), length(key_a)), 4) AS prefix FROM l""",
    "name_alignment": f"""WITH {NT}, n AS (SELECT DISTINCT key_c, normalized AS v FROM names WHERE key_c <> ''), p AS (SELECT x.v AS a, y.v AS b FROM n x JOIN n y ON x.key_c = y.key_c AND x.v < y.v)
 SELECT a, b, round({alignment('a', 'b')}, 6) AS score FROM p""",
    "variant_resolution": f"""WITH {KC}, v AS (SELECT cluster_id, raw, count(*) AS n FROM kc GROUP BY 1, 2),
 b AS (SELECT cluster_id, name, 'container:' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM (SELECT cluster_id, first(raw ORDER BY n DESC, length(raw) DESC, raw) AS name FROM v GROUP BY 1)),
 k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY cluster_id) AS k FROM b)
 SELECT DISTINCT kc.raw AS variant, CASE WHEN k = 1 THEN base ELSE base || '-' || k::varchar END AS _id, name, false AS junk FROM kc JOIN k ON k.cluster_id = kc.cluster_id""",
    "title_search": f"WITH {WD}, t AS (SELECT _id, string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+') AS w FROM wd) SELECT _id FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'of')",
    "search_clusters": f"WITH {WD}, t AS (SELECT *, string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+') AS w FROM wd) SELECT cluster, min(_id) AS _id, count(*) AS cluster_size FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'of') GROUP BY 1",
    "export_ris": f"""WITH {WO} SELECT _id, 'TY  - ' || CASE type WHEN 'article-journal' THEN 'JOUR' WHEN 'book' THEN 'BOOK' ELSE 'CHAP' END || chr(13) || chr(10) || concat_ws(chr(13) || chr(10),
 'AU  - ' || family || ', ' || given, 'PY  - ' || y, 'TI  - ' || title, 'JO  - ' || container_title, 'VL  - ' || volume, 'IS  - ' || issue, 'SP  - ' || first, 'EP  - ' || last, 'ER  - ') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM wo""",
    "export_ris_view": f"""WITH {WO} SELECT _id, concat_ws(chr(10), 'TY  - ' || CASE type WHEN 'article-journal' THEN 'JOUR' WHEN 'chapter' THEN 'CHAP' ELSE 'GEN' END, 'ID  - ' || _id, 'TI  - ' || title, 'AU  - ' || family || ', ' || given,
 'JO  - ' || container_title, 'VL  - ' || volume, 'IS  - ' || issue, 'SP  - ' || first, 'EP  - ' || last, 'Y1  - ' || y, 'ER  - ' || chr(10) || chr(10)) AS record FROM wo""",
    "export_ris_library": f"""WITH {WO} SELECT _id, concat_ws(chr(10), 'TY  - ' || CASE type WHEN 'article-journal' THEN 'JOUR' WHEN 'book' THEN 'BOOK' ELSE 'CHAP' END, 'TI  - ' || title, 'AU  - ' || given || ' ' || family,
 'JO  - ' || container_title, 'VL  - ' || volume, 'IS  - ' || issue, 'SP  - ' || first, 'EP  - ' || last, 'PY  - ' || y || '/' || m || '/' || d || '/', 'ER  - ') || chr(10) AS record FROM wo""",
    "export_bibtex": f"""WITH {WO} SELECT _id, '@' || CASE type WHEN 'article-journal' THEN 'article' WHEN 'book' THEN 'book' ELSE 'incollection' END || '{{' || regexp_replace(_id, '[^A-Za-z0-9]', '', 'g') || ',' || chr(10) || concat_ws(',' || chr(10),
 '  author = {{' || family || ', ' || given || '}}', '  title = {{' || title || '}}', '  journal = {{' || container_title || '}}', '  volume = {{' || volume || '}}', '  number = {{' || issue || '}}',
 '  pages = {{' || first || '--' || last || '}}', '  year = {{' || y || '}}') || chr(10) || '}}' || chr(10) AS record FROM wo""",
    "export_openurl": f"""WITH {WO} SELECT _id, concat_ws('&', 'ctx_ver=Z39.88-2004', CASE WHEN type = 'article-journal' THEN 'rft_val_fmt=info%3Aofi%2Ffmt%3Akev%3Amtx%3Ajournal' END, 'genre=' || CASE type WHEN 'article-journal' THEN 'article' ELSE type END,
 CASE WHEN type = 'article-journal' THEN 'rft.atitle=' || replace(title, ' ', '+') || '&rft.jtitle=' || replace(container_title, ' ', '+') ELSE 'rft.title=' || replace(title, ' ', '+') END,
 'rft.au=' || replace(replace(given || ' ' || family, ' ', '+'), '#', '%23'), 'rft.volume=' || volume, 'rft.issue=' || issue, 'rft.spage=' || first, 'rft.epage=' || last, 'rft.date=' || y) AS record FROM wo""",
    "export_tsv": f"""WITH {WO} SELECT _id, concat_ws(chr(9), _id, type, title, given || ' ' || family, container_title, '', '', volume, issue, first, last, y, '', '', '', '') AS record FROM wo""",
    "citation_strings": f"WITH {WO} SELECT _id, title || '. ' || container_title || ' ' || volume || ': ' || first || '-' || last || '. ' || y AS citation FROM wo",
    "export_order": f"WITH {WO} SELECT _id, row_number() OVER (ORDER BY y, volume, first, _id)::int AS place FROM wo",
    "display_sort": f"WITH {WO} SELECT _id, row_number() OVER (ORDER BY volume, first, _id)::int AS place FROM wo",
    "page_coverage": f"""WITH {WO}, r AS (SELECT _id, first, last, min(first) OVER w AS lo, max(last) OVER w AS hi, count(*) OVER w AS articles FROM wo WINDOW w AS (PARTITION BY y, volume))
 SELECT _id, first, last, lo, hi, articles, floor(round((first - least(1, lo)) * 100 / greatest(hi - least(1, lo), 1), 2))::bigint AS "left", floor(round((last - first) * 100 / greatest(hi - least(1, lo), 1), 2))::bigint AS width FROM r""",
    "page_gaps": f"""WITH {WO}, r AS (SELECT y AS year, volume::varchar AS volume, first, coalesce(max(last) OVER (PARTITION BY y, volume ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM wo)
 SELECT DISTINCT year, volume, seen + 1 AS from_page, first - 1 AS to_page FROM r WHERE first > seen + 1""",
    "abbreviated_pages": f"""WITH {WO}, p AS (SELECT _id, first::varchar AS a, CASE WHEN length(last::varchar) >= 2 THEN right(last::varchar, 2) ELSE last::varchar END AS b FROM wo),
 e AS (SELECT _id, a, CASE WHEN b::bigint < a::bigint AND length(b::bigint::varchar) < length(a) THEN (a[:length(a) - length(b::bigint::varchar)] || b::bigint::varchar)::bigint ELSE b::bigint END AS e FROM p)
 SELECT _id, a || '-' || greatest(a::bigint, e)::varchar AS pages FROM e""",
    "roman_numerals": """SELECT c_custkey, ((CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE 40 END) + 10 * least(3, CASE c_custkey % 40 WHEN 0 THEN 2 ELSE c_custkey % 40 END) + CASE WHEN c_custkey % 3 = 0 THEN 9 ELSE 6 END)::int AS value, c_custkey AS volume FROM customer""",
    "coverage_summary": """WITH c AS (SELECT source AS cid, quality AS matched, n_chars::double AS score FROM labels JOIN documents USING (doc_id)),
 s AS (SELECT cid, list_sort(list(score) FILTER (matched = 1 AND score IS NOT NULL)) AS s, count(*) AS checked, count(*) FILTER (matched = 1) AS matched FROM c GROUP BY 1)
 SELECT cid, checked, matched, checked - matched AS gaps, round(matched * 100 / checked, 1) AS percent, s[1] AS least, s[len(s) // 2 + 1] AS middle, s[len(s)] AS greatest, '2024-01-01' AS latest FROM s""",
    "coverage_lowest": """WITH c AS (SELECT source AS cid, doc_id::varchar AS cluster_id, n_chars::double AS score, lang AS title FROM labels JOIN documents USING (doc_id) WHERE quality = 1)
 SELECT cid, row_number() OVER (PARTITION BY cid ORDER BY score, cluster_id)::int AS place, cluster_id, score, title FROM c QUALIFY place <= 5""",
    "coverage_gaps": """WITH c AS (SELECT source AS cid, doc_id::varchar AS cluster_id, lang AS title FROM labels JOIN documents USING (doc_id) WHERE quality = 0)
 SELECT cid, row_number() OVER (PARTITION BY cid ORDER BY cluster_id)::int AS place, cluster_id, title FROM c QUALIFY place <= 20""",
    "coverage_status": "SELECT CASE WHEN quality = 1 THEN 'in' WHEN quality = 0 THEN 'gap' ELSE 'unk' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "coverage_reconcile": f"""WITH {WO}, c AS (SELECT title || '. ' || container_title || ' ' || volume || ': ' || first || '-' || last || '. ' || y AS q FROM wo)
 SELECT (length(q) % 3 = 0)::int AS matched, count(*) AS n, sum(length(q))::bigint AS chars FROM c GROUP BY 1""",
    "clean_text": f"SELECT doc_id, md5({clean_title('text')}) AS digest FROM documents",
    "bag_of_words": "SELECT p_partkey, array_to_string(list_sort(string_split(p_type || ' ' || p_name, ' ')), ' ') AS bag FROM part",
    "upsert_latest": "SELECT user_id AS _id, arg_max(event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || lpad(event_id::varchar, 12, '0')) AS event_id FROM events GROUP BY 1",
    "id_assignment": """WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"_id":"w' || doc_id || '"}' WHEN 1 THEN '{"id":"' || doc_id || '"}' WHEN 2 THEN '{"id":"pub:' || doc_id || '"}' ELSE '{"id":"x' || doc_id || '"}' END AS text FROM documents)
 SELECT text, CASE doc_id % 4 WHEN 0 THEN 'w' || doc_id WHEN 3 THEN 'x' || doc_id ELSE md5(text) END AS _id FROM r""",
    "prefix_agency": "SELECT s_suppkey, s_nationkey::varchar AS prefix, n_name AS agency FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 5 <> 0",
    "key_range": f"WITH {WO} SELECT _id, y AS year, first::varchar AS spage FROM wo WHERE container_title = 'BUILDING' AND y BETWEEN 1996 AND 1997",
    "flagship": f"""WITH RECURSIVE {WD}, v AS (SELECT DISTINCT source AS v FROM wd), al AS (SELECT x.v AS one, y.v AS two, {alignment('x.v', 'y.v')} > 0.8 AS alike FROM v x, v y),
 e AS (SELECT x._id AS a, y._id AS b FROM wd x JOIN wd y ON x.doi = y.doi AND x._id <> y._id AND x.lang = y.lang JOIN al ON one = x.source AND two = y.source WHERE alike),
 reach AS (SELECT _id AS s, _id AS t FROM wd UNION SELECT reach.s, e.b FROM reach JOIN e ON reach.t = e.a), c AS (SELECT s, min(t) AS least FROM reach GROUP BY 1)
 SELECT 'works' AS name, count(*) AS n FROM wd UNION ALL SELECT 'clusters', count(*) FROM c WHERE s = least""",
}

LOADED = f"WITH {WO} SELECT _id, type, title, container_title, volume::varchar AS volume, issue, first || '-' || last AS page, family, NULL::bigint AS year, 'orders' AS source, '2024-01-01' AS created, _id AS cluster FROM wo"
ORACLES |= {
    "load_csl_lines": LOADED,
    "load_csl_array": LOADED,
    "load_names": "SELECT p_name || ' ' || p_type AS raw, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS issn, count(*) AS n FROM part GROUP BY 1, 2",
    "text_line_references": f"WITH {WO}, c AS (SELECT title || '. ' || container_title || ' ' || volume || ': ' || first || '-' || last || '. ' || y AS u FROM wo) SELECT u AS unstructured, '10.1/x' AS citing, count(*) AS n FROM c GROUP BY 1",
    "jats_article_references": f"""WITH {WO} SELECT 'https://doi.org/10.9/' || first || '#' || _id AS _id, 'article-journal' AS type, family, regexp_replace(regexp_replace(given, '([A-Z])', '\\1 ', 'g'), ' $', '') AS given, title, container_title,
 volume::varchar AS volume, issue, y AS year, first || '-' || last AS page, '10.9/' || first AS citing FROM wo""",
    "html_meta_references": f"WITH {WO} SELECT 'https://doi.org/10.9/x' || first AS parent, (row_number() OVER (PARTITION BY first ORDER BY title || ' &amp; ' || _id) - 1)::int AS row, title || ' & ' || _id AS text FROM wo",
    "route_years": ORACLES["years"],
    "route_author_letters": ORACLES["family_letters"],
    "route_authors": f"WITH {WO} SELECT family, count(*) AS n FROM wo WHERE upper(family[1]) = 'C' GROUP BY 1",
    "route_volumes": f"WITH {WO} SELECT DISTINCT volume FROM wo WHERE y = 1996",
    "route_records": f"WITH {WO} SELECT _id, title, first || '-' || last AS page FROM wo WHERE _id IN ('urn:o:000000000001', 'urn:o:000000000002', 'urn:o:000000000003')",
    "route_works_by_title": ORACLES["container_works"].replace("IN ('BUILDING', 'MACHINERY')", "= 'BUILDING'"),
    "route_search": ORACLES["search_clusters"],
    "route_export": ORACLES["export_ris"] + " WHERE _id IN (SELECT arg_min(_id, ((_id <> cluster)::int)::varchar || _id) FROM wo WHERE y = 1996 AND volume = 3 GROUP BY first, cluster)",
}

NAMED = f"""{KC}, v AS (SELECT cluster_id, raw, count(*) AS n FROM kc GROUP BY 1, 2),
 b AS (SELECT cluster_id, name, k, 'container:' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM (SELECT cluster_id, first(raw ORDER BY n DESC, length(raw) DESC, raw) AS name, count(*) AS k FROM v GROUP BY 1)),
 c AS (SELECT cluster_id, name, k AS variants, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY cluster_id) = 1 THEN base ELSE base || '-' || (row_number() OVER (PARTITION BY base ORDER BY cluster_id))::varchar END AS _id FROM b)"""
FOLD = f"translate(upper(substr(raw, 1, 1)), '{''.join(text.FOLDED.values())}', '{''.join(k * len(v) for k, v in text.FOLDED.items())}')"
ORACLES |= {
    "container_list": f"WITH {NAMED} SELECT upper(name[1]) AS letter, name, variants::int AS variants FROM c",
    "container_manage": f"WITH {NAMED} SELECT '20240101' AS cluster_run, _id FROM c WHERE cluster_id % 3 <> 0",
    "container_variants": f"WITH {NAMED} SELECT v.raw AS variant, _id FROM c JOIN v ON v.cluster_id = c.cluster_id",
    "split_journals": f"WITH {KC} SELECT issn AS journal, count(*) AS n, count(DISTINCT cluster_id) AS clusters FROM kc GROUP BY 1 HAVING count(DISTINCT cluster_id) > 1",
    "merged_journals": f"WITH {KC} SELECT cluster_id, count(*) AS n, count(DISTINCT issn) AS journals FROM kc GROUP BY 1 HAVING count(DISTINCT issn) > 1",
    "short_titles": f"WITH {WO} SELECT container_title AS title, container_title[:4] AS short, count(*) AS n FROM wo GROUP BY 1, 2",
    "simplified": f"WITH {WO} SELECT _id, title, container_title, volume::varchar AS volume, issue, first || '-' || last AS page, y AS year FROM wo",
    "clean_dois": f"WITH {WO} SELECT _id, '10.1/abc.' || first || '-' || last AS doi FROM wo",
    "cluster_graph": f"""WITH {WO} SELECT '"' || _id || '" -> "' || cluster || '";' AS line FROM wo WHERE _id <> cluster""",
    "training_rows": f"""WITH {COMPARED} SELECT concat_ws(chr(9), 1, 0, t, 1 - t, c, 1 - c, 1, 0, i, 1 - i, g, 1 - g, 1, 0, m, 1 - m, d, 1 - d, 0, 0, (2 + t + c + i + g + m + d >= 3 AND t + c + i + g + m + d = 6)::int) AS row, count(*) AS n FROM p GROUP BY 1""",
    "unaccented": f"WITH {WD} SELECT _id, md5({unaccent('title')}) AS digest FROM wd",
    "name_letters": rf"""WITH {NT} SELECT id, {FOLD} AS letter, CASE WHEN length(raw) > 30 THEN substr(raw, 1, 29) ELSE raw END AS short, trim(regexp_replace(raw, '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+', ' ', 'g')) AS line FROM titles""",
    "clean_names": rf"WITH {NT} SELECT id, key_a <> '' AND regexp_matches(raw, '^\s*\p{{L}}') AS clean FROM names",
}

#: The fields of works from orders as votes, in the order of their records.
CR = WO + """, f AS (
  SELECT cluster, _id, unnest(['author', 'title', 'container_title', 'volume', 'issue', 'page', 'year', 'day', 'type']) AS field,
         unnest([given || ' ' || family, title, container_title, volume::varchar, issue, first || '-' || last, y::varchar, d::varchar, type]) AS v
  FROM wo
), o AS (SELECT *, row_number() OVER (PARTITION BY cluster, field ORDER BY _id) AS i FROM f),
 u AS (SELECT cluster, field, v, min(i) AS k FROM o GROUP BY 1, 2, 3), g AS (SELECT cluster, field, list(v ORDER BY k) AS vals FROM u GROUP BY 1, 2),
 b AS (SELECT o.cluster, o.field, any_value(g.vals) AS vals,
              list(list_transform(g.vals, lambda x: (CASE WHEN x = o.v THEN 0.8::double WHEN len(g.vals) > 1 THEN (1 - 0.8::double) / (len(g.vals) - 1) ELSE 0.0::double END)) ORDER BY i) AS steps
       FROM o JOIN g ON o.cluster = g.cluster AND o.field = g.field GROUP BY 1, 2),
 e AS (SELECT *, list_reduce(steps, lambda acc, s: list_transform(list_zip(acc, s), lambda z: round((z[1] * z[2] / list_sum(list_transform(list_zip(acc, s), lambda w: w[1] * w[2])))::decimal(18, 10), 2)::double)) AS belief FROM b),
 w AS (SELECT cluster, field, vals[list_position(belief, list_max(belief))] AS won, len(vals) AS n FROM e), z AS (SELECT cluster, count(*)::int AS n FROM wo GROUP BY 1)"""
#: Titles that hold two words, with what their scores are made of.
BM = WD + r""", t AS (SELECT _id, list_filter(string_split_regex(lower(title), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM wd), n AS (SELECT _id, w, len(w) AS l FROM t WHERE len(w) > 0),
 s AS (SELECT count(*) AS docs, avg(l) AS mean FROM n), q AS (SELECT unnest(['the', 'of']) AS word),
 p AS (SELECT _id, word, l, len(list_filter(w, lambda x: x = word)) AS tf FROM n, q WHERE list_contains(w, word)), d AS (SELECT word, count(*) AS df FROM p GROUP BY 1),
 r AS (SELECT _id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / mean))) AS score, count(*) AS k FROM p JOIN d USING (word), s GROUP BY _id)"""

ORACLES |= {
    "consensus_record": f"""WITH {CR} SELECT w.cluster, any_value(z.n) AS n,
 regexp_replace(max(won) FILTER (field = 'author'), '^(.*) ([^ ]+)$', '\\2, \\1') AS author, max(won) FILTER (field = 'title') AS title, max(won) FILTER (field = 'container_title') AS container_title,
 max(won) FILTER (field = 'volume') AS volume, max(won) FILTER (field = 'issue') AS issue, max(won) FILTER (field = 'page') AS page, (max(won) FILTER (field = 'year'))::bigint AS year,
 (max(won) FILTER (field = 'day'))::bigint AS day, max(won) FILTER (field = 'type') AS type, (max(w.n) FILTER (field = 'page')) > 1 AS page_warning FROM w JOIN z ON z.cluster = w.cluster GROUP BY w.cluster""",
    "title_search_scores": f"WITH {BM} SELECT _id, round(score, 6) AS score FROM r WHERE k = 2 ORDER BY r.score DESC, _id LIMIT 20",
    "html_titles": r"""WITH t AS (SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS t FROM pages)
 SELECT page_id, length(t)::int AS n, regexp_replace(regexp_replace(t, '\.(\p{L})', '. \1', 'g'), '[\x0C\n\r\t ]+', ' ', 'g') AS title FROM t""",
    "html_links": r'''SELECT page_id, len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<a [^>]*href="[^"]'))::int AS n FROM pages''',
}
