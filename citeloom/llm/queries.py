"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import jaccard, media, mixing, packing, pii, quality, suffix, topk, url_filter, warc
from citeloom.llm.common import discard, fresh, table, text_of, write_shared

#: Host, path and kind of the rules.
URL_RULES = (
    url_filter.Rule("com", "/", True),
    url_filter.Rule("example.com", "/en/", False),
    url_filter.Rule("www.example.com", "/en/", True),
    url_filter.Rule("net", "/es/", False),
    url_filter.Rule("net", "/fr/", False),
)


def page_lines(text: F.Column) -> F.Column:
    """A document's lines that have words, as text of a page."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.filter(F.split(safe, "\n"), lambda x: x.rlike(r"\S"))


def page_of(lines: F.Column, digest: F.Column, n_bytes: F.Column) -> F.Column:
    """A document as HTML: a paragraph for each line that has words, and its payload in three places: a figure behind the first paragraph, an image
    behind the middle one, and a figure at the end, each captioned with what stands before it."""
    n = F.size(lines)
    img = lambda alt: F.concat(F.lit('<img src="sha256:'), digest, F.lit('" data-length="'), n_bytes.cast("string"), F.lit('" alt="'), alt, F.lit('">'))
    figure = lambda caption: F.concat(F.lit("<figure>"), img(F.lit("")), F.lit("<figcaption>"), caption, F.lit("</figcaption></figure>"))
    head = lambda i: F.coalesce(F.substr(F.try_element_at(lines, i), F.lit(1), F.lit(60)), F.lit(""))
    half = F.floor(n / 2).cast("int")
    # The places are counted once a document, not in a function of every line.
    paragraphs = lambda at, end: F.array_join(F.transform(F.slice(lines, at, F.greatest(end - at + 1, F.lit(0))), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    middle = F.greatest(half, F.lit(1))
    return F.concat(
        paragraphs(F.lit(1), F.lit(1)),
        F.when(n > 0, figure(head(F.lit(1)))).otherwise(F.lit("")),
        paragraphs(F.lit(2), middle),
        F.when(half > 0, img(head(middle))).otherwise(F.lit("")),
        paragraphs(middle + 1, n),
        figure(F.when(n > 0, head(F.greatest(n, F.lit(1)))).otherwise(F.lit(""))),
    )


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text_of(F.col("text"))
    raw = table(spark, sf_dir, "documents").select("doc_id", t.alias("text"), F.encode(t, "UTF-8").alias("bytes"))
    docs = raw.select("doc_id", "text", F.length("bytes").cast("long").alias("n_bytes"), media.padded(F.col("bytes")).alias("payload"))
    store = media.store_media(docs, "payload")
    # As a table of its own, so that nothing but the join needs its partitioning and Spark may split a hot digest.
    features = write_shared(media.media_features(store), "features")
    discard(store)
    # Ids may be missing or come again: a page is known by its id and its payload, as bytes.
    known = docs.select("doc_id", F.sha2("payload", 256).alias("digest"), "n_bytes", page_lines(F.col("text")).alias("lines"))
    page = F.concat(F.unhex("digest"), F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    pages = media.parse_sequences(known.select(page.alias("page"), page_of(F.col("lines"), F.col("digest"), F.col("n_bytes")).alias("html")), "page", "html")
    # Of texts, digests travel; every item keeps its place.
    pages = write_shared(pages.withColumn("items", F.transform("items", lambda i: i.withField("text", F.unhex(F.sha2(i["text"], 256))))), "pages")
    whole = media.assemble(pages, media.resolve(media.wanted(pages, "page"), features), "page")
    hexed = lambda c: F.lower(F.hex(c))
    shown = F.filter("items", lambda i: i["kind"] == "media")
    last = F.element_at("shown", -1)
    found = whole.select("page", "items", shown.alias("shown")).select("page", "items", "shown", last["found"].alias("f"), last["length"].alias("n_bytes"))
    return found.select(
        F.expr("try_cast(decode(substr(page, 33), 'UTF-8') AS bigint)").alias("doc_id"),
        "n_bytes",
        "f.payload_bytes",
        hexed("f.digest").alias("payload_sha256"),
        "f.tail_crc32",
        "f.media_bytes",
        hexed("f.media_sha").alias("media_sha256"),
        "f.feature",
        F.size("items").cast("long").alias("n_items"),
        F.array_join(F.transform("shown", lambda i: i["position"].cast("string")), ",").alias("positions"),
        F.sha2(F.array_join(F.transform("shown", lambda i: i["caption"]), "\n", ""), 256).alias("captions_sha256"),
        F.sha2(F.array_join(F.transform("items", lambda i: hexed(F.coalesce(i["text"], i["found"]["digest"]))), "\n"), 256).alias("sequence_sha256"),
    )


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"), "doc_id", "text", 100).drop("spans")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_shared(warc.write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html"), "warc", codec="none")
    records = warc.read_archives(archives, payloads=False)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Scores from here on count as good.
QUALITY_FROM = 0.3


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_FROM).cast("int"))


def tokenizer_files() -> dict:
    """Where the vocabulary lies on this machine (it is installed on every executor)."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


PACK_TOKENS = 1024


def packed(docs: DataFrame) -> DataFrame:
    out = packing.pack_documents(docs, "doc_id", "text", **tokenizer_files(), capacity=PACK_TOKENS)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *packing.LEFT)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


#: Weights of the sources by code point, repeating; no document is taken more often than so.
MIX_WEIGHTS, MIX_REPEATS = (5, 2, 1), 3


def mix_targets(patterns: list) -> dict:
    """Each source's size and exact target, where a document has one source."""
    names = sorted((p[0] for p, _ in patterns), key=lambda s: (s is None, s or ""))
    size = {p[0]: n for p, n in patterns}
    exact = mixing.quotas([size[s] for s in names], [MIX_WEIGHTS[i % len(MIX_WEIGHTS)] for i in range(len(names))], MIX_REPEATS)
    return {s: (size[s], t) for s, t in zip(names, exact, strict=True)}


def mixed(docs: DataFrame) -> tuple[DataFrame, dict, tuple[str, str]]:
    """All rows of documents with their size and the words taken; by source, its size and target; the two columns' names."""
    targets: dict = {}

    def quota(patterns: list) -> dict:
        targets.update(mix_targets(patterns))
        return {s: round(t) for s, (_, t) in targets.items()}

    names = tuple(fresh(docs, "mix_size", "mix_taken"))
    how = {"key": "doc_id", "size": mixing.words(F.col("text")), "sources": F.array("source")}
    return mixing.take(docs, mixing.plan_mix(docs, quota=quota, max_repeats=MIX_REPEATS, **how), **how, names=names), targets, names


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, targets, (size, words) = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    sources = spark.createDataFrame([(s, n, float(t)) for s, (n, t) in targets.items()], "name string, source_size long, target double")
    out = taken.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name")))  # bound: the mix's max_patterns
    return out.select("doc_id", F.col(size).alias("size"), "source_size", "target", F.col(words).alias("taken"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, "page_id")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), "doc_id", "text", 5, 80)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["base"])

    def count(kind: str) -> F.Column:
        return F.size(F.filter("pii_spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS[:4]), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii_spans")).alias("spans"), F.array_join(F.transform("pii_spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ints = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return topk.search(ints.filter(F.col("id") % 20 == 0), ints, 20)


QUERIES = {"op1_media": op1_media, "op2_suffix": op2_suffix, "op3_warc": op3_warc, "op4_quality": op4_quality, "op5_packing": op5_packing, "op6_mixing": op6_mixing, "op9_pii": op9_pii, "op7_url_filter": op7_url_filter, "op8_jaccard": op8_jaccard, "op10_topk": op10_topk}

ORACLES = {
    "op3_warc": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b)::bigint AS payload_bytes, sha256(b) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(b)) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM d
""",
    "op2_suffix": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, unnest(list_transform(range(0, greatest(length(h) // 2 - 99, 0)), lambda i: substr(h, 2 * i + 1, 200))) AS s, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS i FROM d
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w
), m AS (
  SELECT doc_id, i AS lo, i + 100 AS hi, CASE WHEN i <= max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts FROM f WHERE k > 1
), n AS (
  SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY lo) AS run FROM m
), runs AS (
  SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM n GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS rest, sum(hi - lo)::bigint AS n_removed, count(*) AS n_spans
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h)::bigint // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op8_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), u AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM u x JOIN u y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM p WHERE 100 * c >= 80 * (na + nb - c)
), reach AS (
  SELECT doc_id AS f, doc_id AS t FROM documents UNION SELECT reach.f, l.b FROM reach JOIN l ON reach.t = l.a
), least AS (
  SELECT f, min(t) AS component_id FROM reach GROUP BY f
)
SELECT doc_id, len(s)::bigint AS n_shingles, component_id FROM s JOIN least ON f = doc_id
""",
    "op7_url_filter": r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT h.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.k = 1
""",
    "op9_pii": r"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), k(kind, ord, rx) AS (
  VALUES ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), ('ip', 2, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
         ('card', 3, '[0-9]([ -]?[0-9])+'), ('phone', 4, '\+[0-9][ ().0-9-]+[0-9]'), ('group', 3, '[0-9]+'), ('iban', 5, '')
), pieces AS (
  SELECT doc_id, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS g FROM raw
  UNION ALL SELECT doc_id, 'ip', regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM raw
  UNION ALL SELECT doc_id, 'card', regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), string_split_regex(t, '[0-9]([ -]?[0-9])+') FROM raw
  UNION ALL SELECT doc_id, 'phone', regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][ ().0-9-]+[0-9]') FROM raw
  UNION ALL SELECT doc_id, 'group', regexp_extract_all(t, '[0-9]+'), string_split_regex(t, '[0-9]+') FROM raw
  UNION ALL SELECT doc_id, 'iban', regexp_extract_all(t, '\b[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)\b'), string_split_regex(t, '\b[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)\b') FROM raw
), unnested AS (
  SELECT doc_id, kind, unnest(m) AS v, unnest(g[:len(m)]) AS gap, unnest(range(len(m))) AS i FROM pieces
), placed AS (
  SELECT doc_id, kind, v, (sum(length(gap) + length(v)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(v))::bigint AS s FROM unnested
), tested AS (
  SELECT doc_id, kind, v, s, s + length(v) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM placed
), checked AS (
  SELECT *, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::int WHEN d[i]::int < 5 THEN d[i]::int * 2 ELSE d[i]::int * 2 - 9 END)) % 10 = 0 AS luhn
  FROM tested WHERE kind <> 'iban' AND NOT (kind IN ('card', 'group') AND length(d) NOT BETWEEN 13 AND 19)
), base AS (
  SELECT doc_id, kind, s, e FROM checked
  WHERE kind = 'email' OR kind = 'phone' AND length(d) BETWEEN 9 AND 15 OR kind = 'card' AND luhn
     OR kind = 'ip' AND len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255')) = 0
), iban AS (
  SELECT doc_id, s, e FROM (SELECT *, replace(v, ' ', '') AS c FROM tested WHERE kind = 'iban')
  WHERE list_reduce(list_prepend(0::bigint, list_transform(string_split(c[5:] || c[:4], ''), lambda c: (CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)::bigint)),
        lambda a, b: (CASE WHEN b > 9 THEN a * 100 + b ELSE a * 10 + b END) % 97) = 1
), cue(kind, prior, rx) AS (
  VALUES ('email', 0.7, 'mail|contact|write to'), ('ip', 0.6, 'ip|host|server|address'), ('card', 0.8, 'card|visa|mastercard|amex|payment|credit'), ('phone', 0.6, 'phone|tel|call|mobile|fax'),
         ('iban', 0.8, 'iban|account|bank|transfer')
), proposed AS (
  SELECT doc_id, kind, s, e, true AS base FROM base
  UNION ALL
  SELECT g.doc_id, 'card', g.s, g.e, false FROM checked g
  WHERE kind = 'group' AND luhn AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = g.doc_id AND b.kind = 'card' AND b.s < g.e AND g.s < b.e)
  UNION ALL SELECT doc_id, 'iban', s, e, false FROM iban
), scored AS (
  SELECT p.*, prior - CASE WHEN p.kind = 'card' AND NOT base THEN 0.15 ELSE 0 END
         + CASE WHEN regexp_matches(lower(substr(t, greatest(s - 40, 0) + 1, least(s, 40))), '\b(' || rx || ')\b') THEN 0.1 ELSE 0 END AS score
  FROM proposed p JOIN cue ON cue.kind = p.kind JOIN raw ON raw.doc_id = p.doc_id
), spans AS (
  SELECT * FROM scored WHERE base OR score >= 0.7
), agg AS (
  SELECT doc_id, count(*) FILTER (base AND spans.kind = 'email') AS n_email, count(*) FILTER (base AND spans.kind = 'ip') AS n_ip,
         count(*) FILTER (base AND spans.kind = 'card') AS n_card, count(*) FILTER (base AND spans.kind = 'phone') AS n_phone,
         string_agg(concat_ws(':', spans.kind, s, e), ',' ORDER BY ord, s) FILTER (base) AS b, string_agg(concat_ws(':', spans.kind, s, e), ',' ORDER BY ord, s) AS a,
         string_agg(printf('%.2f', score::double), ',' ORDER BY ord, s) AS scores
  FROM spans JOIN k ON k.kind = spans.kind GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(scores, '') AS scores
FROM raw LEFT JOIN agg USING (doc_id)
""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::double))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""",
}
